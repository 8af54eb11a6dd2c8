"""What a rebuilt collection would hold, by style, and which sets to rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.operators import graph


def split_plan(items: DataFrame) -> DataFrame:
    """Each set holds only what it does not share with its parent."""
    return items.where("merge IS NULL").select(F.col("set_name").alias("archive"), "name", "size", "crc32")


def merged_plan(sets: DataFrame, items: DataFrame) -> DataFrame:
    """A parent holds its own and its clones' items, shared ones once under the parent's name; clones have no archive."""
    of = sets.select("set_name", F.coalesce("clone_of", "set_name").alias("archive"))
    return items.join(of, "set_name").select("archive", F.coalesce("merge", "name").alias("name"), "size", "crc32").distinct()


def non_merged_plan(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Each set holds all it needs, dependencies included, each name once per source."""
    return graph.required_items(sets, items).select(F.col("root").alias("archive"), "name", "source")


def decisions(status: DataFrame, sets: DataFrame, items: DataFrame, allow_incomplete: bool = False, allow_bad: bool = False, allow_not_working: bool = False) -> DataFrame:
    """(set_name, decision): rebuild, or why not: not_working, bad_dumps, missing, incomplete."""
    bad = items.where(F.col("status").isin("baddump", "nodump")).select("set_name").distinct().withColumn("bad", F.lit(True))
    all_ = status.join(sets.select("set_name", "runnable"), "set_name").join(bad, "set_name", "left")
    no = F.lit(False)
    why = (
        F.when(no if allow_not_working else ~F.col("runnable"), "not_working")
        .when(no if allow_bad else F.col("bad").isNotNull(), "bad_dumps")
        .when((F.col("found") > 0) & ((F.col("status") == "complete") | F.lit(allow_incomplete)), "rebuild")
        .when(F.col("found") == 0, "missing")
        .otherwise("incomplete")
    )
    return all_.select("set_name", why.alias("decision"))
