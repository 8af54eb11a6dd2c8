"""Best representative of each group of duplicate inventory rows (problem 2).

Rows of one dump agree in size and complete sha1, or in size and crc32 value without differing sha1. As a row has one
crc32 and one sha1, no iteration is needed: all rows are first reduced to one candidate row per distinct
(size, crc32, sha1), pre-aggregated in every input partition, so a content that holds a third of all rows is a handful
of rows before anything is shuffled. Candidates that lack a sha1 then take the sha1 of their (size, crc32) where it has
exactly one, and the candidates of a group are ranked per field by window ordering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: where a copy lies, best first.
LOCATION_ORDER = ("file", "archive", "remote")
HEX8, HEX40 = "^[0-9a-f]{8}$", "^[0-9a-f]{40}$"
OUTER = r"(?U)^\s+|\s+$"


def bare(c: str) -> Column:
    """Lower case, without outer white space."""
    return F.lower(F.regexp_replace(F.col(c), OUTER, ""))


def crc_value(c: str) -> Column:
    """The value of a crc32 however written: 0x in front, either case, leading zeros lost. Anything else, and 0: null."""
    hexa = F.regexp_extract(bare(c), "^(?:0x)?([0-9a-f]{1,8})h?$", 1)
    return F.nullif(F.lpad(F.nullif(hexa, F.lit("")), 8, "0"), F.lit("00000000"))


def complete_sha1(c: str) -> Column:
    """The sha1 if it has forty hexadecimal digits that are not all zeros, else null."""
    x = bare(c)
    return F.when(x.rlike(HEX40) & ~x.rlike("^0+$"), x)


def candidates(inventory: DataFrame) -> DataFrame:
    """One row per distinct (size, crc, sha): the number of rows and, for each field, the best row that can supply it."""
    valid = F.when((F.col("last_modified") > 0) & (F.col("last_modified") <= F.unix_micros(F.col("indexed_at").cast("timestamp")) / 1_000_000), F.col("last_modified"))
    rank = F.coalesce(*(F.when(F.col("location_type") == t, i) for i, t in enumerate(LOCATION_ORDER)), F.lit(len(LOCATION_ORDER)))
    place = F.when(F.col("location_path").isNotNull(), F.struct(rank.alias("rank"), F.coalesce(-valid, F.lit(2**62)).alias("age"), F.col("inv_id")))
    full = bare("crc32")
    rows = inventory.where(F.col("inv_id").isNotNull()).select(
        "inv_id", "size", crc_value("crc32").alias("crc"), complete_sha1("sha1").alias("sha"),
        F.when(full.rlike(HEX8) & crc_value("crc32").isNotNull(), F.col("inv_id")).alias("crc_id"),
        F.when(valid.isNotNull(), F.struct((-valid).alias("age"), F.col("inv_id"))).alias("seen"), place.alias("place"),
    )
    return (
        rows.where(F.col("crc").isNotNull() | F.col("sha").isNotNull())
        .groupBy("size", "crc", "sha")
        .agg(
            F.count("*").alias("n"), F.min("inv_id").alias("first"), F.min("crc_id").alias("crc_id"),
            F.min(F.when(F.col("sha").isNotNull(), F.col("inv_id"))).alias("sha_id"), F.min("seen").alias("seen"), F.min("place").alias("place"),
        )
    )


def survivors(inventory: DataFrame) -> DataFrame:
    """(group_id, field, inv_id): which row supplies each field of the surviving record of each group of two or more.

    `group_id` is the group's smallest `inv_id`. crc32 comes from a row with eight hexadecimal digits, sha1 from one with
    forty, last_modified is the latest valid one, location prefers file, archive, remote (other types last), then the
    latest valid time, rows without one last. Ties go to the smallest `inv_id`. A field no row can supply has no row.
    A checksum that is null, empty, a placeholder or zero is none; a row without both, or without `inv_id`, is in no
    group. Null sizes agree with each other. Where the rows of one (size, crc32) have several sha1, those without one
    agree with none in particular and form a group of their own. Columns not named here are not read.
    """
    made = candidates(inventory)
    # a candidate without a crc32 stands alone here, so contents known by sha1 only do not meet in one partition
    of_crc = Window.partitionBy("size", "crc", F.when(F.col("crc").isNull(), F.col("sha")))
    known = F.count("sha").over(of_crc)
    sha = F.coalesce("sha", F.when(F.col("crc").isNotNull() & (known == 1), F.max("sha").over(of_crc)))
    keyed = made.withColumn("dump", F.coalesce(F.concat(F.lit("s"), sha), F.concat(F.lit("c"), F.col("crc"))))
    group = Window.partitionBy("size", "dump")
    best = lambda c: F.row_number().over(group.orderBy(F.col(c).asc_nulls_last(), "first"))
    fields = {"crc32": ("crc_id", F.col("crc_id")), "sha1": ("sha_id", F.col("sha_id")), "last_modified": ("seen", F.col("seen.inv_id")), "location": ("place", F.col("place.inv_id"))}
    ranked = keyed.select(
        F.sum("n").over(group).alias("rows"), F.min("first").over(group).alias("group_id"),
        F.array(*(F.struct(F.lit(name).alias("field"), best(c).alias("rank"), supplier.alias("inv_id")) for name, (c, supplier) in fields.items())).alias("f"),
    )
    wide = ranked.where("rows > 1").select("group_id", F.explode(F.filter("f", lambda x: (x.rank == 1) & x.inv_id.isNotNull())).alias("f"))
    return wide.select("group_id", "f.field", "f.inv_id")


def surviving_records(inventory: DataFrame) -> DataFrame:
    """One built record per group: (group_id, crc32, sha1, last_modified, location_type, location_path, location_entry).

    Each value is that of the row `survivors` names for it. The names are joined back to the inventory by `inv_id`, each
    row at most four times.
    """
    chosen = survivors(inventory)
    values = inventory.select("inv_id", "crc32", "sha1", "last_modified", "location_type", "location_path", "location_entry")
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    return chosen.join(values, "inv_id").groupBy("group_id").agg(
        F.lower(F.trim(pick("crc32", "crc32"))).alias("crc32"), F.lower(F.trim(pick("sha1", "sha1"))).alias("sha1"), pick("last_modified", "last_modified").alias("last_modified"),
        *(pick("location", c).alias(c) for c in ("location_type", "location_path", "location_entry")),
    )
