"""Deeply nested records into related flat tables (problem 4).

The JSON text is parsed once to VARIANT and kept in the checkpoint folder. A merged schema is inferred with
`schema_of_variant_agg` (only the schema text reaches the driver; its size follows the number of distinct field names, not
of rows), and every array level is exploded into rows that carry their parent's surrogate key and their ordinal. Where the
schema tells what lies below, no further pass is needed; where a place holds objects in one feed and lists or text in
another, the rows found there are asked for their own schema. This goes on until no place is left, however deep. Rows that
are done pass through the later levels, so all child tables come from one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setaudit.session import cut, with_settings

SENTINEL = "\\u0001end"


@dataclass(frozen=True)
class Kind:
    """A kind of child table: its name, the field names feeds use for its list, and the kinds inside its objects."""

    name: str
    keys: frozenset[str]
    inner: tuple["Kind", ...] = field(default=())


# The names under which the feeds deliver each list, compared in lower case without a leading @ or _.
MACHINE_KINDS = (
    Kind("rom", frozenset({"rom", "roms"})),
    Kind("disk", frozenset({"disk", "disks"})),
    Kind(
        "dipswitch",
        frozenset({"dipswitch", "dipswitches"}),
        (
            Kind("diplocation", frozenset({"diplocation", "diplocations", "location", "locations"})),
            Kind("dipvalue", frozenset({"dipvalue", "dipvalues", "value", "values"})),
        ),
    ),
)


def parsed(c: Column | str) -> Column:
    """The VARIANT of a JSON text, null unless the text as a whole is valid JSON.

    Spark's parser stops after the first value, so the text is wrapped in a list with an end mark: anything left over
    makes the list invalid or longer.
    """
    c = F.col(c) if isinstance(c, str) else c
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"{SENTINEL}"]'))), "$", "array<variant>")
    return let(whole, lambda w: F.when((F.size(w) == 2) & (F.try_variant_get(F.get(w, F.lit(1)), "$", "string") == F.lit("\x01end")), F.get(w, F.lit(0))))


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def let(v: Column, f: Callable[[Column], Column]) -> Column:
    """f(v) with v evaluated once."""
    return F.get(F.transform(F.array(v), lambda x: f(x)), F.lit(0))


def as_items(v: Column) -> Column:
    """The objects of a list however it is written: a JSON list, a sole object, or either as JSON text. The objects of a list
    directly inside stand in its place; others: empty."""
    return let(v, _items)


def _items(v: Column) -> Column:
    plain = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(is_object(v), F.array(v)))
    text = F.try_variant_get(v, "$", "string")
    from_text = F.when(text.rlike(r"^\s*[\[{]"), let(parsed(text), lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.when(is_object(x), F.array(x)))))
    return let(F.coalesce(plain, from_text, no_items()), lambda x: F.when(F.forall(x, is_object), x).otherwise(F.filter(F.flatten(F.transform(x, _spliced)), is_object)))


def _spliced(x: Column) -> Column:
    return F.coalesce(F.when(is_object(x), F.array(x)), F.try_variant_get(x, "$", "array<variant>"), no_items())


def no_items() -> Column:
    return F.array().cast("array<variant>")


def step_path(key: str) -> str:
    return "['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def fields_of(schema: str) -> dict[str, str]:
    """Field names and types of an `OBJECT<...>` schema text; empty for any other type."""
    if not schema.startswith("OBJECT<"):
        return {}
    found, depth, name, begin, i, body = {}, 0, None, 0, 0, schema[7:-1]
    while i < len(body):
        if depth == 0 and name is None:
            if body[i] == "`":
                end = i + 1
                while body[end] != "`" or body[end : end + 2] == "``":
                    end += 2 if body[end : end + 2] == "``" else 1
                name, i = body[i + 1 : end].replace("``", "`"), end + 1
            else:
                end = body.index(":", i)
                name, i = body[i:end], end
            i = begin = body.index(":", i) + 1
            continue
        depth += {"<": 1, ">": -1}.get(body[i], 0)
        if body[i] == "`":
            i = body.index("`", i + 1)
        elif body[i] == "," and depth == 0:
            found[name], name = body[begin:i].strip(), None
            while i + 1 < len(body) and body[i + 1] == " ":
                i += 1
        i += 1
    if name is not None:
        found[name] = body[begin:].strip()
    return found


def plain_name(key: str) -> str:
    return re.sub(r"^[@_]+", "", key).lower()


def element_of(schema: str) -> str:
    """The schema of the objects that `as_items` makes of a value of this schema; empty where only the rows can tell."""
    if schema.startswith("OBJECT<"):
        return schema
    return schema[6:-1] if schema.startswith("ARRAY<OBJECT<") else ""


@dataclass(frozen=True)
class Site:
    """A place whose objects become rows: its path from the record, the kind of its list (None for a list between), the
    nearest kind that holds or is this place, and the schema of its objects (empty where only the rows can tell)."""

    path: str
    kind: Kind | None
    owner: Kind | None
    schema: str


def places(schema: str, site: Site, kinds: tuple[Kind, ...], at: str = "$") -> list[tuple[str, Site]]:
    """(path in an object, site) of all lists that objects of this schema hold: those of the kinds and those between."""
    found = []
    for key, kind_of in fields_of(schema).items():
        path = at + step_path(key)
        kind = next((k for k in (*kinds, *(site.owner.inner if site.owner else ())) if plain_name(key) in k.keys), None)
        listed = re.match(r"(ARRAY<)*(ARRAY<OBJECT<|VARIANT)", kind_of)
        if kind and (listed or kind_of.startswith("OBJECT<") or kind_of == "STRING"):
            found.append((path, Site(site.path + path[1:], kind, kind, element_of(kind_of))))
        elif kind_of.startswith("OBJECT<"):
            found += places(kind_of, site, kinds, path)
        elif listed:
            found.append((path, Site(site.path + path[1:], None, site.owner, element_of(kind_of))))
    return found


def _children(kept: list[int], below: list[tuple[int, int, str, bool]]) -> Column:
    """Rows for the objects of all lists of a row; `below` has (site of the row, site of the list, path, whether the list's parent
    is one that counts places). A row of a list between stands for the row of a kind that holds it."""
    row = lambda c: F.col(f"row.{c}")
    is_kind = row("site").isin(kept) if kept else F.lit(False)
    key, pos = F.when(is_kind, row("key")).otherwise(row("parent_key")), F.when(is_kind, row("pos")).otherwise(row("parent_pos"))
    lists = lambda n: F.array(*(F.struct(F.lit(m).alias("site"), F.lit(path[1:] + "[").alias("path"), F.lit(placed).alias("placed"), F.try_variant_get(row("item"), path, "variant").alias("value")) for k, m, path, placed in below if k == n))
    mine = F.coalesce(*(F.when(row("site") == n, lists(n)) for n in sorted({k for k, *_ in below})))

    def one(of: Column) -> Column:
        return F.transform(as_items(of["value"]), lambda x, i: F.struct(
            of["site"].alias("site"), row("record_id").alias("record_id"), F.concat(row("key"), of["path"], i.cast("string"), F.lit("]")).alias("key"), key.alias("parent_key"),
            F.when(of["placed"], pos).otherwise(F.lit(-1).cast("bigint")).alias("parent_pos"), i.cast("bigint").alias("pos"), x.alias("item"),
        ))

    return F.flatten(F.transform(mine, one))


def flatten_records(df: DataFrame, record_id: str, payload: str, kinds: tuple[Kind, ...] = MACHINE_KINDS) -> DataFrame:
    """(record_id, child, key, parent_key, list_path, parent_pos, pos, item): one row per object of any wanted list.

    `key` is the row's surrogate key (record, path, positions), `parent_key` that of its parent: the nearest object of a
    wanted list that holds it, or the record. `pos` counts the objects of its own list from 0; `parent_pos` is the `pos` of
    the parent if its kind has this kind inside, else -1. `item` is the object as VARIANT. Lists are found at any depth,
    within lists of their own kind too. Payloads that are null, empty or not valid JSON as a whole give no rows; so do
    absent, null or empty lists. Objects with fields missing count. Of a field named twice in one object the last counts.
    Rows with equal `record_id` are flattened each. Other columns of `df` are not read.
    """
    df = with_settings(df, {"spark.sql.variant.allowDuplicateKeys": "true"})
    records = cut(df.select(F.col(record_id).alias("record_id"), parsed(payload).alias("v")).where(F.col("v").isNotNull()))
    rid, none = F.col("record_id").cast("string"), F.lit(-1).cast("bigint")
    root = lambda x, i: F.struct(F.lit(0).alias("site"), F.col("record_id"), F.concat(rid, F.lit("$["), i.cast("string"), F.lit("]")).alias("key"), rid.alias("parent_key"), none.alias("parent_pos"), i.cast("bigint").alias("pos"), x.alias("item"))
    rows = records.select(F.explode(F.transform(as_items(F.col("v")), root)).alias("row"))
    sites, fresh = [Site("$", None, None, "")], [0]
    while fresh:
        told = {n: sites[n].schema for n in fresh}
        if unknown := [n for n in fresh if not sites[n].schema]:
            asked = rows.where(F.col("row.site").isin(unknown)).groupBy("row.site").agg(F.schema_of_variant_agg("row.item").alias("s"))
            told |= {r.site: r.s for r in asked.collect()}
        below = [(n, path, site) for n in fresh for path, site in places(told[n], sites[n], kinds)]
        if not below:
            break
        fresh = list(range(len(sites), len(sites) + len(below)))
        kept = [n for n, s in enumerate(sites) if s.kind]
        placed = lambda n, site: site.kind is None or bool(sites[n].owner and site.kind in sites[n].owner.inner)
        lists = [F.when(F.col("row.site").isin(kept), F.array("row"))] if kept else []
        lists.append(_children(kept, [(n, m, path, placed(n, site)) for m, (n, path, site) in zip(fresh, below)]))
        sites += [site for _, _, site in below]
        rows = rows.select(F.explode(F.flatten(F.array_compact(F.array(*lists)))).alias("row"))
    wanted = [n for n, s in enumerate(sites) if s.kind]
    if not wanted:
        return rows.where("false").select("row.record_id", F.lit("").alias("child"), "row.key", "row.parent_key", F.lit("").alias("list_path"), "row.parent_pos", "row.pos", "row.item")
    told_of = lambda get: F.element_at(F.create_map(*(F.lit(x) for n in wanted for x in (n, get(sites[n])))), F.col("row.site"))
    return rows.where(F.col("row.site").isin(wanted)).select(
        "row.record_id", told_of(lambda s: s.kind.name).alias("child"), "row.key", "row.parent_key", told_of(lambda s: s.path).alias("list_path"), "row.parent_pos", "row.pos", "row.item"
    )


def scalar_fields(items: DataFrame, kind: str) -> DataFrame:
    """One flat table: the rows of a kind, with a string column for each scalar field its objects have in any feed.

    Field names are compared without a leading @ or _ and in lower case; where a row has several spellings of one name
    the first non-null in alphabetical order counts. Nested values stay out, they have tables of their own.
    """
    mine = items.where(F.col("child") == kind)
    schema = mine.agg(F.schema_of_variant_agg("item").alias("s")).first()[0] or "VOID"
    names: dict[str, list[str]] = {}
    for key, kind_of in sorted(fields_of(schema).items()):
        if not kind_of.startswith(("OBJECT<", "ARRAY<")):
            names.setdefault(plain_name(key), []).append(key)
    columns = [F.coalesce(*(F.try_variant_get("item", "$" + step_path(k), "string") for k in keys)).alias(f"f_{n}") for n, keys in names.items()]
    return mine.select("record_id", "key", "parent_key", "parent_pos", "pos", *columns)


def machine_rows(records: DataFrame) -> DataFrame:
    """The machines themselves: (record_id, key, name, description, year, cloneof, sourcefile), one row per valid payload.

    Fields are taken from the first machine object, whether it stands at the top, under `machine` or under
    `body.machine`, sole or as a list; absent ones are null.
    """
    v = parsed("payload")
    top = records.select("record_id", v.alias("v")).where(F.col("v").isNotNull())
    places = [F.try_variant_get("v", p, "variant") for p in ("$.body.machine", "$.machine", "$")]
    machine = F.coalesce(*(F.get(as_items(p), F.lit(0)) for p in places))
    m = top.select("record_id", machine.alias("m"))
    get = lambda n: F.coalesce(*(F.try_variant_get("m", f"$['{x}{n}']", "string") for x in ("", "@", "_"))).alias(n)
    return m.select("record_id", F.col("record_id").cast("string").alias("key"), *(get(n) for n in ("name", "description", "year", "cloneof", "sourcefile")))
