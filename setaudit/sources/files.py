"""Directories and archives as inventory rows.

Listings come from Spark's file source without contents. Contents are opened where they lie, on the executors, by range:
of an archive only its directory is read, of a loose file four MiB at a time, so no file is too large.
"""

from __future__ import annotations

import hashlib
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setaudit.functions.names import ARCHIVES, base_name, extension

CHUNK = 4 * 1024 * 1024
# Extensions taken without looking, never taken, and the first bytes (hex) of known contents with their offsets.
TAKEN = (
    "zip 7z rar chd rom bin img iso nes sfc smc gb gbc gba nds 3ds n64 z64 v64 smd md gen gg sms 32x scd pbp cso a26 a52 a78 lnx jag pce vb ws wsc ngp ngc"
).split()
SKIPPED = "txt md json xml html css js pdf doc docx xls xlsx jpg jpeg png gif bmp mp3 mp4 avi mov mkv log bak tmp swp lock".split()
MAGIC = (
    (0, "4E45531A"), (0x104, "CEED6666"), (0, "80371240"), (0, "37804012"), (0, "40123780"), (0, "50532D58"), (0x100, "53454741"), (0x101, "53454741"), (0x200, "53454741"),
    (0x1F0, "0000000000000000AABB04"), (0, "78"), (1, "415441524937383030"), (0, "4C594E58"), (0x1FF0, "40000000"), (0x100, "4E454F2D47454F"),
)
OTHER = ("25504446", "89504E47", "FFD8FF", "47494638", "7F454C46", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE")
BOMS = ("EFBBBF", "FEFF", "FFFE")
SAMPLE = 8192
LISTED = "path string, modificationTime timestamp, length bigint"
HASHES = "crc32 string, md5 string, sha1 string, sha256 string"
ENTRY = "path string, entry string, size bigint, crc32 string, last_modified bigint, error string"


def located(path: str) -> tuple[Any, str]:
    """The Arrow file system of a path, and the path in it. Paths are as Spark lists them, with blanks and all; bare ones are local."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme = path.split("/")[0]
    if ":" not in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file:":
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe="/:@[]?=&"))


def open_path(path: str) -> BinaryIO:
    """A seekable stream of a path of any file system that Arrow knows."""
    system, inner = located(path)
    return system.open_input_file(inner)


def head(path: str, size: int) -> bytes:
    with open_path(path) as f:
        return f.read(size)


def chunks(f: BinaryIO) -> Iterator[bytes]:
    while block := f.read(CHUNK):
        yield block


def scan(spark: SparkSession, folder: str, recursive: bool = True, only: tuple[str, ...] | None = None) -> DataFrame:
    """(path, modificationTime, length, ext, is_archive): files in order of path, hidden ones left out; `only` is a list of
    extensions to keep. A listing without recursion has the folder's own files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).drop("content")
    inside = F.substring_index("path", folder.rstrip("/") + "/", -1)
    visible = files.where(~F.concat(F.lit("/"), inside).rlike(r"/\."))
    if not recursive:
        visible = visible.where(~inside.contains("/"))
    out = visible.withColumn("ext", extension(F.col("path"))).withColumn("is_archive", F.col("ext").isin(*ARCHIVES, "rar", "chd"))
    return (out.where(F.col("ext").isin(*only)) if only else out).orderBy("path")


def with_content(files: DataFrame, schema: str, read: Callable[[str], list[tuple]]) -> DataFrame:
    """(path, *schema) of a listing, from a function of the path that opens what it needs; errors are its own to report."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", *(c.split()[0] for c in schema.split(", "))]
        for pdf in frames:
            yield pd.DataFrame([(p, *r) for p in pdf["path"] for r in read(p)], columns=names)

    return files.select("path").mapInPandas(each, f"path string, {schema}")


def looks_like_content(sample: Column, ext: Column) -> Column:
    """Whether a file belongs into an inventory: by extension, else by its first bytes: known signatures yes; text (a mark, or
    over 95 of 100 characters printable) and known documents, pictures and programs no; else by the share of distinct bytes."""
    known = F.lit(False)
    for offset, magic in MAGIC:
        known = known | (F.hex(F.substring(sample, offset + 1, len(magic) // 2)) == magic)
    first = F.hex(F.substring(sample, 1, 4))
    starts = lambda ms: F.coalesce(*(F.when(first.startswith(m), True) for m in ms), F.lit(False))
    text = F.decode(F.substring(sample, 1, 1024), "ISO-8859-1")
    plain = F.length(F.regexp_replace(text, r"[^\x09\x0a\x0d\x20-\x7e]", "")) > 0.95 * F.length(text)
    size = F.octet_length(sample)
    spread = F.size(F.array_distinct(F.regexp_extract_all(F.hex(sample), F.lit("(..)"), F.lit(1)))) / F.least(size, F.lit(256))
    return (
        F.when(ext.isin(*TAKEN), True).when(ext.isin(*SKIPPED) | (size == 0), False).when(known, True)
        .when(starts(BOMS) | plain | starts(OTHER), False).otherwise(spread > 0.1)
    )


def indexable(files: DataFrame) -> DataFrame:
    """The files of a listing that belong into an inventory; contents are looked at only where the extension tells nothing."""
    sure = files.where(F.col("ext").isin(*TAKEN))
    asked = files.where(~F.col("ext").isin(*TAKEN) & ~F.col("ext").isin(*SKIPPED))

    def sample(path: str) -> list[tuple]:
        try:
            return [(head(path, SAMPLE),)]
        except OSError:
            return []

    samples = with_content(asked, "sample binary", sample)
    yes = asked.join(samples, "path").where(looks_like_content(F.col("sample"), F.col("ext"))).drop("sample")
    return sure.unionByName(yes.select(*sure.columns))


def hashes(files: DataFrame) -> DataFrame:
    """(path, crc32, md5, sha1, sha256, error): all four in one reading of each file, however large."""

    def read(path: str) -> list[tuple]:
        try:
            crc, rest = 0, [hashlib.md5(), hashlib.sha1(), hashlib.sha256()]
            with open_path(path) as f:
                for block in chunks(f):
                    crc = zlib.crc32(block, crc)
                    for h in rest:
                        h.update(block)
            return [(f"{crc:08x}", *(h.hexdigest() for h in rest), None)]
        except OSError as e:
            return [(None, None, None, None, str(e))]

    return with_content(files, HASHES + ", error string", read)


def same_files(hashed: DataFrame, by: str = "sha1") -> DataFrame:
    """(hash, files, first_path): contents that more than one scanned file has."""
    return hashed.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("hash")).agg(F.count("*").alias("files"), F.min("path").alias("first_path")).where("files > 1")


def dos_seconds(date_time: tuple[int, ...]) -> int | None:
    """Epoch seconds of an archive's local date (two-second steps from 1980, taken as UTC); null for an impossible one."""
    try:
        return int(pd.Timestamp(*date_time, tz="UTC").timestamp())
    except ValueError:
        return None


def wanted_entry(name: str) -> bool:
    """Names that begin with a dot and readme.txt are no entries of an inventory, in any folder of an archive."""
    last = name.rsplit("/", 1)[-1].lower()
    return bool(last) and not last.startswith(".") and last != "readme.txt"


def entries(archives: DataFrame) -> DataFrame:
    """(path, entry, size, crc32, last_modified, error): archive directories, read from their end; an unreadable archive is one row with an error."""

    def read(path: str) -> list[tuple]:
        try:
            with open_path(path) as f, zipfile.ZipFile(f) as z:
                return [(i.filename, i.file_size, f"{i.CRC:08x}", dos_seconds(i.date_time), None) for i in z.infolist() if not i.is_dir() and wanted_entry(i.filename)]
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
            return [(None, None, None, None, str(e))]

    return with_content(archives, ENTRY.split(", ", 1)[1], read)


def extract(archives: DataFrame, contents: bool = True) -> DataFrame:
    """(path, entry, size, crc32, md5, sha1, content, error): every entry unpacked, stored or deflated; others and broken ones are
    rows with an error. Without `contents` only the checksums stay, and no entry is held as a whole."""

    def read(path: str) -> list[tuple]:
        out: list[tuple] = []
        try:
            with open_path(path) as f, zipfile.ZipFile(f) as z:
                for i in z.infolist():
                    if i.is_dir() or not wanted_entry(i.filename):
                        continue
                    if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                        out.append((i.filename, i.file_size, None, None, None, None, f"compression {i.compress_type}"))
                        continue
                    try:
                        crc, size, md5, sha1, kept = 0, 0, hashlib.md5(), hashlib.sha1(), []
                        with z.open(i) as e:
                            for block in chunks(e):
                                crc, size = zlib.crc32(block, crc), size + len(block)
                                md5.update(block)
                                sha1.update(block)
                                if contents:
                                    kept.append(block)
                        out.append((i.filename, size, f"{crc:08x}", md5.hexdigest(), sha1.hexdigest(), b"".join(kept) if contents else None, None))
                    except (zipfile.BadZipFile, zlib.error, OSError, RuntimeError) as e:
                        out.append((i.filename, i.file_size, None, None, None, None, str(e)))
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            out.append((None, None, None, None, None, None, str(e)))
        return out

    return with_content(archives, "entry string, size bigint, crc32 string, md5 string, sha1 string, content binary, error string", read)


def scanned_entries(archives: DataFrame, items: DataFrame) -> DataFrame:
    """(path, set_name, entry, errors): unpacked entries against the items of the set that the archive is named after.

    `errors` lists size, crc32, sha1 where they differ from what the item states. Entries that cannot be unpacked are left out,
    as are those no item is named like.
    """
    from setaudit.functions.names import clean_set_name, stem

    got = extract(archives, contents=False).where("error IS NULL").withColumn("_set", clean_set_name(stem(F.col("path"))))
    want = items.select("set_name", F.lower("set_name").alias("_set"), F.col("name").alias("entry"), *(F.col(c).alias(f"want_{c}") for c in ("size", "crc32", "sha1")))
    both = got.join(want, ["_set", "entry"])
    said = [F.when(F.col(f"want_{c}").isNotNull() & (F.col(c) != F.col(f"want_{c}")), c) for c in ("size", "crc32", "sha1")]
    return both.select("path", "set_name", "entry", F.array_join(F.array_compact(F.array(*said)), ",").alias("errors"))


def inventory(spark: SparkSession, folder: str, hashed: bool = True) -> DataFrame:
    """Inventory rows of a folder: loose files with all checksums (none with `hashed=False`), and archive entries."""
    files = indexable(scan(spark, folder))
    null = lambda t: F.lit(None).cast(t)
    loose = files.where("NOT is_archive")
    sums = hashes(loose) if hashed else loose.select("path", *(null("string").alias(c) for c in ("crc32", "md5", "sha1", "sha256", "error")))
    rows = loose.join(sums, "path").select(
        base_name(F.col("path")).alias("name"), F.col("length").alias("size"), "crc32", "sha1", "md5", F.lit("file").alias("location_type"),
        F.col("path").alias("location_path"), null("string").alias("location_entry"), F.unix_timestamp("modificationTime").alias("last_modified"), "error",
    )
    packed = entries(files.where(F.col("ext") == "zip")).select(
        F.coalesce(base_name(F.col("entry")), base_name(F.col("path"))).alias("name"), "size", "crc32", null("string").alias("sha1"), null("string").alias("md5"), F.lit("archive").alias("location_type"),
        F.col("path").alias("location_path"), F.col("entry").alias("location_entry"), "last_modified", "error",
    )
    return rows.unionByName(packed).withColumn("source_path", F.lit(folder))


PLACE = ("location_path", "location_entry")


def upsert(old: DataFrame, new: DataFrame, newest: tuple[str, ...] = ()) -> DataFrame:
    """Old and new rows, one per place (path and entry; a null entry equals a null entry): a new one replaces an old one.
    Among the new rows of one place the greatest by `newest`, then by all columns, counts."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*PLACE, *newest, "_new")]
    order = [F.desc("_new"), *(F.col(c).desc_nulls_last() for c in newest), *(F.col(c).desc_nulls_last() for c in rest)]
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*PLACE).orderBy(*order))).where("_r = 1").drop("_r", "_new")


def stale(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Index rows whose file a fresh listing no longer has."""
    return index.join(listing.select(F.col("path").alias("location_path")).distinct(), "location_path", "left_anti")


def changed_places(old: DataFrame, new: DataFrame) -> DataFrame:
    """(location_path, change): places added or removed between two scans."""
    a, b = old.select("location_path").distinct(), new.select("location_path").distinct()
    return b.join(a, "location_path", "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, "location_path", "left_anti").withColumn("change", F.lit("removed")))


#: Archive handlers by extension: functions from a listing to rows as `entries` and `extract` give them. 7z and CUE/BIN have none.
ARCHIVE_HANDLERS: dict[str, dict[str, Callable[..., Any]]] = {"zip": {"list": entries, "extract": extract}}
