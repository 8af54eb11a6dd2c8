"""What changed between consecutive full snapshots of a table (problem 1).

Each snapshot is unpivoted into cells (key, field, value) with a sign: a snapshot's cells count +1 in the step that
ends with it and -1 in the step that begins with it, and every key adds one presence marker. Summed per cell, equal
cells cancel. What stays classifies the key: a presence sum of +1 is added, -1 removed, and 0 with value cells left
over is changed, the fields of those cells being the changed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setaudit.functions.text import blank_to_null, numbers_in, squeeze

MARK = "\x00row"


def latest_rows(df: DataFrame, stream: str, version: str, key: str, fields: dict[str, Column], delivered: str) -> DataFrame:
    """One row for each (stream, version, key): that delivered last; ties go to the greatest field values, nulls least.

    The aggregate combines within each input partition first, so a key that was delivered over and over costs one
    shuffled row per partition. Rows without a key after trimming are kept under the key they have (null is a key).
    """
    order = F.struct(F.col(delivered).alias("at"), *(e.alias(n) for n, e in fields.items()))
    return (
        df.groupBy(F.col(stream).alias("stream"), F.col(version).alias("version"), squeeze(key).alias("key"))
        .agg(F.max(order).alias("m"))
        .select("stream", "version", "key", *(F.col(f"m.{n}").alias(n) for n in fields))
    )


def steps(df: DataFrame, stream: str, version: str) -> DataFrame:
    """The snapshots of each stream in order: (stream, version, ord, last).

    Versions compare by the numbers in them from left to right; equal numbers compare as text. The rows are the
    distinct (stream, version) pairs, of which a hot stream has no more than others have.
    """
    pairs = df.groupBy(F.col(stream).alias("stream"), F.col(version).alias("version")).agg(F.lit(1).alias("one"))
    by = Window.partitionBy("stream")
    return pairs.withColumn("ord", F.row_number().over(by.orderBy(numbers_in("version"), "version"))).withColumn("last", F.max("ord").over(by)).drop("one")


def snapshot_changes(df: DataFrame, stream: str, version: str, key: str, fields: dict[str, Column], delivered: str) -> DataFrame:
    """(stream, version, key, diff, fields): one row per key that differs between a version and the one before it.

    `version` is the later one; `diff` is added, removed or changed; `fields` names the changed fields (null unless
    changed). The first version of a stream has no rows. An empty table gives no rows. Columns of `df` that are not
    named are never read, so their names cannot clash.

    Shuffles: one for the latest rows (pre-aggregated), one on (stream, key) that serves both remaining aggregates; the
    small list of versions joins by broadcast where Spark finds it small and by a skew-aware join otherwise.
    """
    rows = latest_rows(df, stream, version, key, fields, delivered)
    at = steps(df, stream, version)
    rows = rows.join(at.withColumnsRenamed({"stream": "s2", "version": "v2"}), F.col("stream").eqNullSafe(F.col("s2")) & F.col("version").eqNullSafe(F.col("v2"))).drop("s2", "v2")
    values = [F.struct(F.lit(MARK).alias("field"), F.lit(None).cast("string").alias("value")), *(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in fields)]
    signs = F.filter(
        F.array(
            F.struct(F.col("ord").alias("step"), F.lit(1).alias("sign")),
            F.struct((F.col("ord") + 1).alias("step"), F.lit(-1).alias("sign")),
        ),
        lambda s: (s.step > 1) & (s.step <= F.col("last")),
    )
    cells = rows.repartition("stream", "key").select("stream", "key", F.explode(signs).alias("s"), F.array(*values).alias("cells")).select("stream", "key", "s.step", "s.sign", F.explode("cells").alias("c"))
    left = cells.groupBy("stream", "key", "step", "c.field", "c.value").agg(F.sum("sign").alias("total")).where("total <> 0")
    found = left.groupBy("stream", "key", "step").agg(
        F.sum(F.when(F.col("field") == MARK, F.col("total"))).alias("present"),
        F.array_sort(F.collect_set(F.when(F.col("field") != MARK, F.col("field")))).alias("touched"),
    )
    diff = F.when(F.col("present") > 0, "added").when(F.col("present") < 0, "removed").otherwise("changed")
    named = found.select("stream", "key", "step", diff.alias("diff"), F.when(F.col("present").isNull(), F.col("touched")).alias("fields"))
    to = at.select(F.col("stream").alias("s2"), "version", F.col("ord"))
    return named.join(to, named.stream.eqNullSafe(to.s2) & (F.col("step") == F.col("ord"))).select("stream", "version", "key", "diff", "fields")


def dat_changes(games: DataFrame) -> DataFrame:
    """`snapshot_changes` of the No-Intro DATs: games by `name`, compared by `description` with null equal to empty."""
    return snapshot_changes(games, "dat_name", "version", "name", {"description": blank_to_null(squeeze("description"))}, "delivered_at")
