"""Checksum columns: one spelling per value, so equality joins and pushes down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def crc_key(c: Column | str) -> Column:
    """Eight lower-case digits of a crc32 however written (0x, case, lost zeros); null for none, zero or anything else."""
    digits = F.regexp_extract(F.lower(F.trim(_col(c))), "^(?:0x)?([0-9a-f]{1,8})$", 1)
    return F.nullif(F.lpad(F.nullif(digits, F.lit("")), 8, "0"), F.lit("00000000"))


def hash_key(c: Column | str, digits: int) -> Column:
    """A hash of `digits` hexadecimal digits in lower case; null unless complete and not zero."""
    x = F.lower(F.trim(_col(c)))
    return F.when(x.rlike(f"^[0-9a-f]{{{digits}}}$") & ~x.rlike("^0+$"), x)


def crc32_hex(content: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(_col(content)))), 8, "0")


def all_hashes(content: Column | str) -> Column:
    """crc32, md5, sha1 and sha256 of a binary or string column, in one projection."""
    c = _col(content)
    return F.struct(crc32_hex(c).alias("crc32"), F.md5(c).alias("md5"), F.sha1(c).alias("sha1"), F.sha2(c, 256).alias("sha256"))


def composite_key(crc: Column | str, size: Column | str) -> Column:
    return F.concat_ws("_", F.lower(_col(crc)), _col(size).cast("string"))
