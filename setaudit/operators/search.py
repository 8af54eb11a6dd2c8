"""Searching the inventory and the catalogue. A search takes one value, or a table of values asked at once (one equality join)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shown_first() -> list[Column]:
    """The order of search results: by kind of location, the newest first."""
    return [F.col("location_type").asc(), F.col("last_modified").desc_nulls_last(), F.col("inv_id").asc()]


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def by_crc(copies: DataFrame, asked: DataFrame | str) -> DataFrame:
    """Copies of one checksum in order, or of all in `asked` (columns asked, query) with their `place` in the order of each."""
    if isinstance(asked, str):
        return copies.where(F.col("crc32") == asked.strip().lower()).orderBy(*shown_first())
    both = copies.join(asked.where("query IS NOT NULL"), F.col("crc32") == F.col("query"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(*shown_first())))


def by_name(copies: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Copies whose name is like the pattern (% and _), without regard to case, by name and kind of location."""
    return _limited(copies.where(F.col("name").ilike(pattern)).orderBy("name", "location_type", "inv_id"), limit)


def exact(copies: DataFrame, asked: DataFrame, column: str) -> DataFrame:
    """Each row of `asked` with every copy that has its value of the column, case aside; null asks for nothing."""
    found = copies.select(F.lower(column).alias("_key"), "inv_id")
    return asked.withColumn("_key", F.lower(column)).join(found, "_key").drop("_key")


def by_size(copies: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Copies within inclusive bounds, either of which may be left out, by size. Rows without a size are in no bounds."""
    for bound, test in ((least, lambda: F.col("size") >= least), (most, lambda: F.col("size") <= most)):
        if bound is not None:
            copies = copies.where(test())
    return copies.orderBy("size", "inv_id")


def game(sets: DataFrame, name: str) -> DataFrame:
    """The set of exactly this name."""
    return sets.where(F.col("set_name") == name).limit(1)


def games_by_crc(items: DataFrame, asked: DataFrame | str) -> DataFrame:
    """Sets that have any item of a checksum, or of those in `asked` (column query; its others are kept)."""
    if isinstance(asked, str):
        return items.where(F.col("crc32") == asked.strip().lower()).select("set_name").distinct()
    return items.select("set_name", "crc32").join(asked, F.col("crc32") == F.col("query")).drop("crc32", "query").distinct()


def clones_of(sets: DataFrame, parents: DataFrame | str) -> DataFrame:
    """(asked_for, set_name): the clones of one parent or of all in `parents` (its first column)."""
    clones = sets.where("clone_of IS NOT NULL").select(F.col("clone_of").alias("asked_for"), "set_name")
    if isinstance(parents, str):
        return clones.where(F.col("asked_for") == parents)
    return clones.join(parents.select(F.col(parents.columns[0]).alias("asked_for")).distinct(), "asked_for", "left_semi")


def clones_of_absent(sets: DataFrame) -> DataFrame:
    """(asked_for, set_name): clones of parents that the catalogue does not have."""
    clones = sets.where("clone_of IS NOT NULL").select(F.col("clone_of").alias("asked_for"), "set_name")
    return clones.join(sets.select(F.col("set_name").alias("asked_for")), "asked_for", "left_anti")


def rom_info(copies: DataFrame) -> DataFrame:
    """(crc32, name, size, copies, duplicate): one record per checksum; name and size of the copy shown first. The places of
    its copies are rows of `duplicate_places` or `by_crc`: a list of them would grow with a content's copies."""
    row = F.struct("location_type", F.coalesce(-F.col("last_modified"), F.lit(2**62)).alias("age"), "inv_id", "name", "size")
    per = copies.where("crc32 IS NOT NULL").groupBy("crc32").agg(F.min(row).alias("first"), F.count("*").alias("copies"))
    return per.select("crc32", "first.name", "first.size", "copies", (F.col("copies") > 1).alias("duplicate"))


def duplicate_places(copies: DataFrame) -> DataFrame:
    """(crc32, copies, place, inv_id): every copy of contents that have more than one, a row each."""
    many = copies.where("crc32 IS NOT NULL").groupBy("crc32").agg(F.count("*").alias("copies")).where("copies > 1")
    place = F.concat("location_path", F.coalesce(F.concat(F.lit("::"), "location_entry"), F.lit("")))
    return copies.join(many, "crc32").select("crc32", "copies", place.alias("place"), "inv_id")


def grouped(found: DataFrame) -> DataFrame:
    """(key, copies, name): search results by checksum (`unknown` for none), in the order of their first name."""
    return found.groupBy(F.coalesce("crc32", F.lit("unknown")).alias("key")).agg(F.count("*").alias("copies"), F.min("name").alias("name")).orderBy("name", "key")
