"""Matching a catalogue of sets and items to an inventory, and judging what is found.

Every ranking of copies is an aggregate (`best_*` keep the least tuple per key), so Spark combines it in each input
partition and a content of which a third of all rows are copies costs one row per partition in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setaudit.functions import checksums, names

# The orders in which kinds of location are preferred.
LOCAL_FIRST = ("file", "archive", "remote")
ARCHIVE_FIRST = ("archive", "file", "remote")


def sets_of(game_sets: DataFrame) -> DataFrame:
    """The catalogue's sets, each once however often it was delivered."""
    return game_sets.distinct()


def items_of(set_items: DataFrame) -> DataFrame:
    """Required items, each once, with comparable checksums and a known status."""
    return set_items.distinct().select(
        "set_name", "name", "size", checksums.crc_key("crc32").alias("crc32"), checksums.hash_key("sha1", 40).alias("sha1"),
        checksums.hash_key("md5", 32).alias("md5"), names.dump_status(F.col("status")).alias("status"), "merge",
    )


def copies_of(inventory: DataFrame) -> DataFrame:
    """Inventory rows with comparable checksums."""
    return inventory.select(
        "inv_id", "name", "size", checksums.crc_key("crc32").alias("crc32"), checksums.hash_key("sha1", 40).alias("sha1"), checksums.hash_key("md5", 32).alias("md5"),
        "location_type", "location_path", "location_entry", "last_modified", "source_path",
    )


def kind_rank(order: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(F.col("location_type") == k, i) for i, k in enumerate(order)), F.lit(len(order)))


def best_copy(copies: DataFrame, keys: list[str], order: tuple[str, ...] = LOCAL_FIRST, preferred: tuple[str, ...] = ()) -> DataFrame:
    """keys + (inv_id, location_type, location_path): the best copy per key.

    Copies on a preferred path (in the order given) come first, then by kind of location, then the newest, then by path,
    entry and id, which makes the order total. Rows with a null key are dropped: no checksum is not a checksum.
    """
    wish = F.coalesce(*(F.when(F.col("location_path").contains(p), i) for i, p in enumerate(preferred)), F.lit(len(preferred))) if preferred else F.lit(0)
    age = F.coalesce(-F.col("last_modified"), F.lit(2**62))
    rank = F.struct(wish.alias("wish"), kind_rank(order).alias("kind"), age.alias("age"), "location_path", F.coalesce("location_entry", F.lit("")).alias("entry"), "inv_id", "location_type")
    keyed = copies
    for k in keys:
        keyed = keyed.where(F.col(k).isNotNull())
    return keyed.groupBy(*keys).agg(F.min(rank).alias("m"), F.count("*").alias("copies")).select(*keys, "m.inv_id", "m.location_type", "m.location_path", "copies")


def match_items(items: DataFrame, copies: DataFrame, order: tuple[str, ...] = LOCAL_FIRST) -> DataFrame:
    """Each item with its best copy: by checksum, else (also where the checksum has no copy) by name and size.

    `matched_by` is crc32, name_size or null. Two equality joins against one row per key, never an OR condition.
    """
    by_crc = best_copy(copies, ["crc32"], order).select("crc32", F.col("inv_id").alias("crc_id"))
    named = copies.withColumn("lname", F.lower("name"))
    by_name = best_copy(named, ["lname", "size"], order).select("lname", "size", F.col("inv_id").alias("name_id"))
    out = items.withColumn("lname", F.lower("name")).join(by_crc, "crc32", "left").join(by_name, ["lname", "size"], "left")
    how = F.when(F.col("crc_id").isNotNull(), "crc32").when(F.col("name_id").isNotNull(), "name_size")
    return out.select("set_name", "name", "size", "crc32", "status", how.alias("matched_by"), F.coalesce("crc_id", "name_id").alias("inv_id"))


def available(items: DataFrame, copies: DataFrame) -> DataFrame:
    """Items with a flag whether the inventory has their checksum."""
    have = copies.where("crc32 IS NOT NULL").select("crc32").distinct().withColumn("have", F.lit(True))
    return items.join(have, "crc32", "left").withColumn("have", F.coalesce("have", F.lit(False)))


def validate(items: DataFrame, copies: DataFrame) -> DataFrame:
    """(inv_id, crc32, sha1, size, crc_ok, sha_ok, size_ok, valid): copies against all contents the catalogue expects
    under their name, one row per copy and distinct content.

    An expected content without checksum is invalid; a sha1 counts where both sides have one; a wrong size is told but
    does not make a copy invalid. `crc_ok` is null where only the copy has no checksum, which is not valid either.
    Copies whose name no item has are not validated.
    """
    want = items.select(F.lower("name").alias("lname"), F.col("crc32").alias("c"), F.col("sha1").alias("s"), F.col("size").alias("z")).distinct()
    both = copies.withColumn("lname", F.lower("name")).join(want, "lname")
    crc_ok = F.when(F.col("c").isNull(), False).otherwise(F.col("crc32") == F.col("c"))
    sha_ok = F.col("sha1").isNull() | F.col("s").isNull() | (F.col("sha1") == F.col("s"))
    return both.select("inv_id", F.col("c").alias("crc32"), F.col("s").alias("sha1"), F.col("z").alias("size"), crc_ok.alias("crc_ok"), sha_ok.alias("sha_ok"), (both["size"] == F.col("z")).alias("size_ok"), F.coalesce(crc_ok & sha_ok, F.lit(False)).alias("valid"))


def set_status(sets: DataFrame, found: DataFrame, rule: str) -> DataFrame:
    """(set_name, required, found, status) by one of four named rules. `found` is items with `have` and `status`.

    generic: complete if nothing is missing, items or not; missing if nothing is found. strict: complete needs at least
    one item and no bad dump among those found. index: items without a checksum are ignored, complete needs one found.
    indexed: complete if all items are found and there is one; `have` is then what `match_items` matched, by name and size too.
    """
    counted = found.where("crc32 IS NOT NULL") if rule == "index" else found
    bad = F.col("have") & (F.col("status") == "baddump")
    per = counted.groupBy("set_name").agg(F.count("*").alias("required"), F.count_if("have").alias("found"), F.count_if(bad).alias("bad"))
    per = sets.select("set_name").join(per, "set_name", "left").na.fill(0, ["required", "found", "bad"])
    whole, some, none = F.col("required") == F.col("found"), F.col("found") > 0, F.col("found") == 0
    status = {
        "generic": F.when(whole, "complete").when(none, "missing").otherwise("incomplete"),
        "strict": F.when(none, "missing").when(whole & (F.col("bad") == 0), "complete").otherwise("incomplete"),
        "index": F.when(whole & some, "complete").when(some, "incomplete").otherwise("missing"),
        "indexed": F.when(whole & some, "complete").when(some, "incomplete").otherwise("missing"),
    }[rule]
    return per.select("set_name", "required", "found", status.alias("status"))


def archive_entries(copies: DataFrame) -> DataFrame:
    """(stem, entry, crc32): what archives hold, by the archive's cleaned name; of entries of one name the least crc32."""
    a = copies.where("location_type = 'archive'").select(names.clean_set_name(names.stem(F.col("location_path"))).alias("stem"), F.coalesce("location_entry", "name").alias("entry"), "crc32")
    return a.groupBy("stem", "entry").agg(F.min("crc32").alias("crc32"))


def set_status_direct(sets: DataFrame, items: DataFrame, copies: DataFrame) -> DataFrame:
    """(set_name, required, found, broken, status): archives judged as they lie, each by the set it is named after.

    An item is found if an entry bears its name, and broken if both have a checksum and these differ. A set with a broken
    item is broken, one without missing and broken items complete, others incomplete. A set of no archive that a loose file
    is named after is incomplete with one item found; a set of neither is missing. Several archives of one name are one.
    """
    entries = archive_entries(copies)
    keyed = items.select(F.lower("set_name").alias("stem"), "set_name", F.col("name").alias("entry"), F.col("crc32").alias("want"))
    each = keyed.join(entries.select("stem", "entry", "crc32", F.lit(True).alias("hit")), ["stem", "entry"], "left")
    per = each.groupBy("set_name").agg(F.count("*").alias("required"), F.count("hit").alias("found"), F.count_if(F.col("hit") & (F.col("want") != F.col("crc32"))).alias("broken"))
    lie = entries.select("stem").distinct().withColumn("archive", F.lit(True))
    loose = copies.where("location_type = 'file'").select(F.lower(names.stem(F.col("location_path"))).alias("stem")).distinct().withColumn("loose", F.lit(True))
    all_ = sets.select("set_name", F.lower("set_name").alias("stem")).join(per, "set_name", "left").na.fill(0, ["required", "found", "broken"]).join(lie, "stem", "left").join(loose, "stem", "left")
    status = (
        F.when(F.col("archive"), F.when(F.col("broken") > 0, "broken").when(F.col("found") == F.col("required"), "complete").otherwise("incomplete"))
        .when(F.col("loose"), "incomplete").otherwise("missing")
    )
    found = F.when(F.col("archive"), F.col("found")).when(F.col("loose"), F.lit(1)).otherwise(F.lit(0))
    return all_.select("set_name", "required", found.cast("bigint").alias("found"), "broken", status.alias("status"))


def hash_matches(copies: DataFrame, items: DataFrame) -> DataFrame:
    """(inv_id, set_name, name, matches): copies against the items of their name by every value an item states: checksums
    without regard to case, and the size."""
    want = items.select("set_name", "name", F.lower("name").alias("lname"), *(F.col(c).alias(f"want_{c}") for c in ("size", "crc32", "sha1", "md5")))
    both = copies.select("inv_id", F.lower("name").alias("lname"), "size", "crc32", "sha1", "md5").join(want, "lname")
    same = F.col("size").eqNullSafe(F.col("want_size"))
    for c in ("crc32", "sha1", "md5"):
        same = same & (F.col(f"want_{c}").isNull() | F.col(c).eqNullSafe(F.col(f"want_{c}")))
    return both.select("inv_id", "set_name", "name", same.alias("matches"))


def validation_errors(copies: DataFrame, items: DataFrame) -> DataFrame:
    """(inv_id, set_name, errors): a scanned copy against the items of its name, with the list of what is wrong: a wrong
    size, crc32 or sha1, the latter two where the item states them."""
    want = items.select("set_name", F.lower("name").alias("lname"), *(F.col(c).alias(f"want_{c}") for c in ("size", "crc32", "sha1")))
    both = copies.select("inv_id", F.lower("name").alias("lname"), "size", "crc32", "sha1").join(want, "lname")
    said = [F.when(~F.col("size").eqNullSafe(F.col("want_size")), "size")]
    said += [F.when(F.col(f"want_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"want_{c}")), c) for c in ("crc32", "sha1")]
    return both.select("inv_id", "set_name", F.array_join(F.array_compact(F.array(*said)), ",").alias("errors"))


def parent_clone_groups(sets: DataFrame) -> DataFrame:
    """(parent, clones, n): each parent with its clones in order; parents the catalogue lacks are left out."""
    clones = sets.where("clone_of IS NOT NULL").select(F.col("clone_of").alias("parent"), "set_name")
    grouped = clones.groupBy("parent").agg(F.array_sort(F.collect_set("set_name")).alias("c"))
    return grouped.join(sets.select(F.col("set_name").alias("parent")), "parent", "left_semi").select("parent", F.array_join("c", ",").alias("clones"), F.size("c").alias("n"))


def alternatives(sets: DataFrame) -> DataFrame:
    """(set_name, alternative): a clone's parent, and its other clones."""
    c = sets.where("clone_of IS NOT NULL").select("set_name", "clone_of")
    parent = c.join(sets.select(F.col("set_name").alias("clone_of")), "clone_of", "left_semi").select("set_name", F.col("clone_of").alias("alternative"))
    siblings = c.join(c.withColumnRenamed("set_name", "alternative"), "clone_of").where("set_name <> alternative").select("set_name", "alternative")
    return parent.unionAll(siblings)


def totals() -> list[Column]:
    return [F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("complete", "incomplete", "missing"))]
