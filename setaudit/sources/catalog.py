"""Catalogue documents (XML, SQLite) as tables, and the formats they come in."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setaudit.functions.names import dump_status
from setaudit.sources.files import head

_S = T.StringType()


def _part(*names: str, **inner: T.DataType) -> T.ArrayType:
    """Repeated elements with these attributes and inner elements."""
    return T.ArrayType(T.StructType([T.StructField(f"_{n}", _S) for n in names] + [T.StructField(n, t) for n, t in inner.items()]))


_ROM = _part("name", "size", "crc", "sha1", "sha256", "md5", "status", "merge", "region", "offset", "date", "optional", "bios")
_DISK = _part("name", "sha1", "md5", "status", "merge", "index", "region", "writable")
_GAME_FIELDS = ("name", "cloneof", "romof", "sampleof", "sourcefile", "isbios", "isdevice", "ismechanical", "runnable", "description", "year", "manufacturer")
GAME = T.StructType(
    [T.StructField(f"_{n}", _S) for n in _GAME_FIELDS]
    + [T.StructField(n, _S) for n in ("description", "year", "manufacturer", "category")]
    + [T.StructField("rom", _ROM), T.StructField("disk", _DISK), T.StructField("sample", _part("name")), T.StructField("device_ref", _part("name")), T.StructField("biosset", _part("name", "description", "default"))]
)
HARDWARE = {
    "chip": _part("name", "tag", "type", "clock"),
    "display": _part("tag", "type", "rotate", "flipx", "width", "height", "refresh", "pixclock", "htotal", "hbend", "hbstart", "vtotal", "vbend", "vbstart"),
    "sound": _part("channels"),
    "input": _part("service", "tilt", "players", "coins", control=_part("type", "player", "buttons", "ways", "minimum", "maximum", "sensitivity", "keydelta", "reverse")),
    "dipswitch": _part("name", "tag", "mask", diplocation=_part("name", "number", "inverted"), dipvalue=_part("name", "value", "default")),
    "driver": _part("status", "emulation", "color", "sound", "graphic", "cocktail", "savestate", "palettesize", "requiresartwork", "unofficial", "nosoundhardware", "incomplete"),
    "feature": _part("type", "status", "overall"),
}
#: Attributes deviceref_0, deviceref_1, ... of a machine: as many as this are read.
DEVICE_ATTRIBUTES = 64
MACHINE = T.StructType(GAME.fields + [T.StructField(f"_deviceref_{i}", _S) for i in range(DEVICE_ATTRIBUTES)] + [T.StructField(n, t) for n, t in HARDWARE.items()])
HEADER = T.StructType([T.StructField(n, _S) for n in ("name", "description", "version", "author", "date", "comment", "url", "homepage")])


@dataclass(frozen=True)
class Format:
    """How documents are told and read: the element that is one set, its schema, a test of the first 4 KiB, and, for other
    kinds of documents, a reader and a writer of one's own."""

    name: str
    row_tag: str
    schema: T.StructType
    told: Callable[[str], bool]
    reader: Callable[[SparkSession, str], DataFrame] | None = None
    validator: Callable[..., DataFrame] | None = None


FORMATS: dict[str, Format] = {}


def register(form: Format) -> None:
    FORMATS[form.name] = form


def unregister(name: str) -> None:
    FORMATS.pop(name, None)


def available() -> list[str]:
    return sorted(FORMATS)


def handler(name: str) -> Format:
    if name not in FORMATS:
        raise ValueError(f"unknown format {name}; there are {', '.join(available())}")
    return FORMATS[name]


def _datafile(*marks: str) -> Callable[[str], bool]:
    return lambda text: "<datafile" in text and any(m in text.lower() for m in marks)


register(Format("nointro", "game", GAME, _datafile("no-intro")))
register(Format("redump", "game", GAME, _datafile("redump")))
register(Format("logiqx", "game", GAME, lambda t: "<datafile" in t or ("<!DOCTYPE datafile" in t) or "<game" in t))
register(Format("logiqx_machines", "machine", GAME, lambda t: "<datafile" in t and "<machine" in t and "<game" not in t))
register(Format("machines", "machine", MACHINE, lambda t: "<mame" in t or ("<machine" in t and "<game" not in t)))
#: The order of detection: the first format that knows a document by its beginning. A datafile of machine elements is no game file.
DETECTION = ["nointro", "redump", "logiqx_machines", "logiqx", "machines"]


def detect(path: str) -> str:
    """The format of a document, from its first 4096 bytes."""
    text = head(path, 4096).decode("utf-8", "replace")
    for name in [*DETECTION, *(n for n in FORMATS if n not in DETECTION)]:
        if name in FORMATS and FORMATS[name].told(text):
            return name
    raise ValueError(f"no format knows {path}")


def _yes(c: str) -> Column:
    return F.coalesce(F.lower(c).isin("yes", "true", "1"), F.lit(False))


def read_sets(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """Sets of a document, nested parts as arrays. The reader splits large files at set elements.

    Machines also have their hardware (`chip`, `display`, `sound`, `input`, `dipswitch`, `driver`, `feature`), and devices
    named by attributes. Elements without a name are left out; a description falls back to the name.
    """
    f = handler(form or detect(path))
    if f.reader:
        return f.reader(spark, path)
    raw = spark.read.format("xml").option("rowTag", f.row_tag).schema(f.schema).load(path)
    refs = F.coalesce(F.transform("device_ref", lambda d: d["_name"]), F.array().cast("array<string>"))
    if "_deviceref_0" in f.schema.names:
        refs = F.concat(refs, F.array_compact(F.array(*(F.col(f"_deviceref_{i}") for i in range(DEVICE_ATTRIBUTES)))))
    hardware = [n for n in HARDWARE if n in f.schema.names]
    either = lambda n: F.coalesce(n, f"_{n}").alias(n)
    return raw.where(F.col("_name").isNotNull()).select(
        F.col("_name").alias("set_name"), F.coalesce("description", "_description", "_name").alias("description"), either("year"), either("manufacturer"), "category",
        F.col("_cloneof").alias("clone_of"), F.col("_romof").alias("rom_of"), F.col("_sampleof").alias("sample_of"), F.col("_sourcefile").alias("source_file"),
        _yes("_isbios").alias("is_bios"), _yes("_isdevice").alias("is_device"), _yes("_ismechanical").alias("is_mechanical"), (F.coalesce("_runnable", F.lit("yes")) != "no").alias("runnable"),
        refs.alias("device_refs"), "rom", "disk", "sample", "biosset", *hardware,
    )


def items(sets: DataFrame) -> DataFrame:
    """One row per ROM of a set with its place; those without a name or a whole number as size are left out."""
    r = sets.select("set_name", F.posexplode("rom").alias("item_ord", "r"))
    get = lambda n: F.col(f"r._{n}")
    size = F.expr("try_cast(r._size AS BIGINT)")
    return r.where(get("name").isNotNull() & size.isNotNull()).select(
        "set_name", "item_ord", get("name").alias("name"), size.alias("size"), F.lower(get("crc")).alias("crc32"), F.lower(get("sha1")).alias("sha1"), F.lower(get("md5")).alias("md5"),
        dump_status(get("status")).alias("status"), get("merge").alias("merge"), get("region").alias("region"), get("offset").alias("offset"),
    )


def parts(sets: DataFrame, name: str) -> DataFrame:
    """One row per element of a nested part with its place: disk, sample, biosset, or any of the hardware; attributes as columns."""
    kind = sets.schema[name].dataType.elementType
    e = sets.select("set_name", F.posexplode(name).alias("ord", "e"))
    return e.select("set_name", "ord", *(F.col(f"e.{f.name}").alias(f.name.lstrip("_")) for f in kind.fields))


def header(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """The one-row header of a document. Where it has none, that is an error if `required`; else the attributes of the root
    element speak: its `build` is the name, its `debug` the description."""
    rows = spark.read.format("xml").option("rowTag", "header").schema(HEADER).load(path).limit(1)
    if not rows.isEmpty():
        return rows
    if required:
        raise ValueError(f"{path} has no header")
    root = re.search(r"<(?:mame|datafile)\b([^>]*)>", head(path, 65536).decode("utf-8", "replace"))
    said = dict(re.findall(r'(\w+)\s*=\s*"([^"]*)"', root[1])) if root else {}
    return spark.createDataFrame([(said.get("build", "Unknown"), said.get("debug", ""), said.get("version"), None, None, None, None, None)], HEADER)


def read_sqlite(spark: SparkSession, path: str, table: str = "machines", batch: int = 100_000) -> DataFrame:
    """(set_name, description, year, manufacturer) of a SQLite file's table, a local file by nature: read in ranges of its row
    numbers, each by one task."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
        have = {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')}
    fields = [n if n in have else "NULL" for n in ("name", "description", "year", "manufacturer")]
    schema = "set_name string, description string, year string, manufacturer string"
    if low is None:
        return spark.createDataFrame([], schema)

    def read(frames):
        import pandas as pd

        for pdf in frames:
            for start in pdf["start"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    rows = db.execute(f'SELECT {", ".join(fields)} FROM "{table}" WHERE rowid BETWEEN ? AND ? AND name IS NOT NULL', (int(start), int(start) + batch - 1)).fetchall()
                yield pd.DataFrame([(n, d or n, None if y is None else str(y), m) for n, d, y, m in rows], columns=["set_name", "description", "year", "manufacturer"])

    return spark.range(low, high + 1, batch).select(F.col("id").alias("start")).mapInPandas(read, schema)


def cache_key(path: str, modified: int) -> str:
    """A folder name for a parsed document: its path with signs made plain, at most 200 characters, and its time."""
    return f"{re.sub(r'[/: ]', '_', path)[-200:]}_{modified}"


def read_cached(spark: SparkSession, path: str, cache: str, modified: int, form: str | None = None) -> DataFrame:
    """`read_sets`, kept as Parquet in a folder by path and time of the document; older ones of the same path are deleted, and
    one that cannot be read is made anew."""
    jvm, key = spark._jvm, cache_key(path, modified)
    at = jvm.org.apache.hadoop.fs.Path(cache)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    prefix = key.rsplit("_", 1)[0]
    for s in fs.listStatus(at) if fs.exists(at) else []:
        name = s.getPath().getName()
        if name.rsplit("_", 1)[0] == prefix and name != key:
            fs.delete(s.getPath(), True)
    target = f"{cache.rstrip('/')}/{key}"
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")):
        read_sets(spark, path, form).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
