"""Names, paths, folders and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words cleaned off names, units, folder characters, extensions.
EXTRAS = ("Proto", "Beta", "Demo", "Sample", "Alt", "Hack")
UNITS = ("B", "KB", "MB", "GB", "TB")
ARCHIVES = ("zip", "7z")
STYLES = ("flat", "manufacturer", "year", "genre", "alphabet", "parent_clone", "status", "custom")
# What is cut off a title: remarks in round and square brackets, and a version.
REMARKS, VERSION = (r"\s*\([^)]+\)", r"\s*\[[^\]]+\]"), r"\s+(v|V|rev|Rev|REV)\s*[\d.]+[a-zA-Z]?"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")


def clean_set_name(c: Column) -> Column:
    """Lower case, trimmed, without .zip and .7z wherever they stand."""
    return F.trim(F.lower(F.replace(F.replace(c, F.lit(".zip"), F.lit("")), F.lit(".7z"), F.lit(""))))


def clean_title(c: Column, regions: bool = True, versions: bool = True, extras: bool = True) -> Column:
    """A file title without bracketed remarks, version numbers and words for unfinished editions."""
    if regions:
        for pattern in REMARKS:
            c = F.regexp_replace(c, pattern, "")
    if versions:
        c = F.regexp_replace(c, VERSION, "")
    for word in EXTRAS if extras else ():
        c = F.regexp_replace(c, rf"(?i)\s+\(?{word}\)?", "")
    return F.trim(c)


def safe_folder(c: Column) -> Column:
    return F.regexp_replace(c, r'[/\\?%*|"<>:]', "_")


def folder_for(style: str, custom: Column | None = None) -> Column:
    """The folder a set is filed in, from columns manufacturer, year, category, set_name, clone_of; `custom` is a column of one's own."""
    first = F.upper(F.substring("set_name", 1, 1))
    if style == "custom":
        return safe_folder(F.coalesce(custom, F.lit("Unknown")))
    if style == "genre":
        return safe_folder(F.coalesce("category", F.lit("Unknown")))
    return {
        "flat": F.lit(""),
        "manufacturer": safe_folder(F.coalesce("manufacturer", F.lit("Unknown"))),
        "year": F.coalesce("year", F.lit("Unknown")),
        "alphabet": F.when(first.rlike("^[A-Z]$"), first).otherwise("#"),
        "parent_clone": F.when(F.col("clone_of").isNull(), "Parents").otherwise("Clones"),
        "status": F.lit("Unknown"),
    }[style]


def display_location(kind: Column, path: Column, entry: Column, mark: str = "#") -> Column:
    return F.when((kind == "archive") & entry.isNotNull(), F.concat(path, F.lit(mark), entry)).otherwise(path)


def format_bytes(c: Column) -> Column:
    out = F.format_string("%.2f TB", c / float(1024**4))
    for i in (3, 2, 1, 0):
        out = F.when(c < 1024 ** (i + 1), F.format_string(f"%.2f {UNITS[i]}", c / float(1024**i))).otherwise(out)
    return out


def percent(part: Column, whole: Column) -> Column:
    """100 x part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def escape_xml(c: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(plain), F.lit(name))
    return c


def query_kind(c: Column) -> Column:
    return F.when(c.rlike("^[0-9A-Fa-f]{8}$"), "crc32").otherwise("name")


def dump_status(c: Column) -> Column:
    """good, baddump (also written bad), nodump or verified; anything else counts as good."""
    return F.when(F.lower(c).isin("baddump", "nodump", "verified"), F.lower(c)).when(F.lower(c) == "bad", "baddump").otherwise("good")


def parse_number(c: Column) -> Column:
    """A whole number written in decimal or, after 0x, in hexadecimal digits; null for anything else."""
    x = F.lower(F.trim(c))
    return F.when(x.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(x, 3, 15), 16, 10).cast("bigint")).when(x.rlike(r"^-?\d{1,18}$"), x.cast("bigint"))


def parse_bool(c: Column) -> Column:
    """yes, true and 1 in any case; everything else, null too, is no."""
    return F.coalesce(F.lower(F.trim(c)).isin("yes", "true", "1"), F.lit(False))


def percent_text(share: Column) -> Column:
    """A share as text, `12.5%`; null as 0.0%."""
    return F.format_string("%.1f%%", F.coalesce(share, F.lit(0.0)) * 100.0)


def bytes_in(c: Column, style: str = "decimal") -> Column:
    """A size for readers: decimal (kB, MB), binary (KiB, MiB) or file (as decimal, whole numbers below a million)."""
    step, units = (1024.0, ("bytes", "KiB", "MiB", "GiB", "TiB")) if style == "binary" else (1000.0, ("bytes", "kB", "MB", "GB", "TB"))
    out = F.format_string(f"%.1f {units[4]}", c / step**4)
    for i in (3, 2, 1):
        shape = "%.0f" if style == "file" and i == 1 else "%.1f"
        out = F.when(c < step ** (i + 1), F.format_string(f"{shape} {units[i]}", c / step**i)).otherwise(out)
    return F.when(c < step, F.format_string("%d bytes", c.cast("bigint"))).otherwise(out)


def health_sign(health: Column) -> Column:
    """good from 90, fair from 70, poor from 50, else bad."""
    return F.when(health >= 90, "good").when(health >= 70, "fair").when(health >= 50, "poor").otherwise("bad")


def dos_time(date: Column, time: Column) -> Column:
    """The timestamp of an archive's packed date and time (two-second steps from 1980); null for an impossible one."""
    part = lambda c, shift, mask: F.shiftright(c.cast("int"), shift).bitwiseAND(F.lit(mask))
    return F.try_make_timestamp(part(date, 9, 127) + 1980, part(date, 5, 15), part(date, 0, 31), part(time, 11, 31), part(time, 5, 63), (part(time, 0, 31) * 2).cast("decimal(8,6)"))


def dos_parts(at: Column) -> Column:
    """(date, time) of a timestamp as an archive packs them."""
    date = (F.year(at) - 1980) * 512 + F.month(at) * 32 + F.dayofmonth(at)
    return F.struct(date.alias("date"), (F.hour(at) * 2048 + F.minute(at) * 32 + F.floor(F.second(at) / 2)).cast("int").alias("time"))


def is_old(seconds: Column, now: Column, hours: int = 24) -> Column:
    """Whether an epoch time lies more than a day (or so many hours) before another."""
    return now - seconds > hours * 3600
