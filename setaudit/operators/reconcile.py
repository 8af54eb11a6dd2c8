"""Differences between two copies of a table (problem 5).

Each row becomes an element (key, row hash). Keys are split into buckets, and each bucket has an invertible Bloom lookup
table: an element adds its count, key and hash to three cells. Rows of the first copy count +1 and of the second -1, so
what both hold cancels while the tables are built, in one pre-aggregated sum per cell. Peeling a bucket (take a cell
that holds a single element, subtract it from its other cells, go on) gives the keys that differ. Only rows of those
keys are then fetched from both sides and compared field by field. A bucket with more differences than its cells can
hold does not peel; all its rows are fetched and compared instead, so the result is exact in either case.

Sums of parts, not XOR, are kept: an element that one copy holds twice is still found (its count is then -2).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setaudit.session import cut

CELLS = "cnt bigint, key_hi bigint, key_lo bigint, hash_hi bigint, hash_lo bigint, check bigint"
LOW = 0xFFFFFFFF

# The primes of the public hash XXH64, and the seed Spark's xxhash64 begins with.
PRIME_1, PRIME_2, PRIME_3, PRIME_4, PRIME_5, SEED = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 42


def xxhash64_of_long(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of one bigint column, for an int64 array."""
    with np.errstate(over="ignore"):
        turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
        p1, p2, p3, p4 = (np.uint64(p) for p in (PRIME_1, PRIME_2, PRIME_3, PRIME_4))
        h = np.uint64((SEED + PRIME_5 + 8) & (2**64 - 1)) ^ (turn(x.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def row_hash(key: Column, fields: list[Column]) -> Column:
    """64 bits over the key and all fields, null told apart from any value."""
    return F.xxhash64(key, *(x for f in fields for x in (f.isNull(), f)))


def buckets_of(left: DataFrame, right: DataFrame, key: str, bucket_keys: int) -> Column:
    """The bucket of `k`: ranges of keys where keys lie close, so files in key order combine before the shuffle; else as many
    buckets as hold `bucket_keys` keys each, by hash. Only the least and greatest key and the number of rows are asked for."""
    k = F.col(key).cast("bigint")
    one = left.select(k.alias("k")).unionAll(right.select(k.alias("k"))).agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("k").alias("n")).first()
    if one.n == 0 or (one.high - one.low) / one.n <= 4:
        return F.floor(F.col("k") / bucket_keys)
    return F.pmod(F.xxhash64("k"), F.lit(max(1, one.n // bucket_keys)))


def elements(df: DataFrame, key: str, fields: dict[str, Column], sign: int, bucket: Column) -> DataFrame:
    k = F.col(key).cast("bigint")
    return df.where(k.isNotNull()).select(k.alias("k"), row_hash(k, list(fields.values())).alias("h"), F.lit(sign).alias("sign")).withColumn("bucket", bucket)


def lookup_tables(rows: DataFrame, third: int) -> DataFrame:
    """The cells (bucket, cell, sums) of the bucket tables; a bucket has three parts of `third` cells each."""
    place = [F.lit(i * third) + F.shiftrightunsigned("h", 21 * i).bitwiseAND(F.lit(0x1FFFFF)) % third for i in range(3)]
    spread = rows.withColumn("c", F.xxhash64(F.col("k").bitwiseXOR(F.col("h"))).bitwiseAND(F.lit(LOW))).select("bucket", "k", "h", "c", "sign", F.explode(F.array(*place)).alias("cell"))
    part = lambda x: F.sum(x * F.col("sign"))
    return spread.groupBy("bucket", "cell").agg(
        F.sum("sign").alias("cnt"),
        part(F.shiftright("k", 32)).alias("key_hi"),
        part(F.col("k").bitwiseAND(F.lit(LOW))).alias("key_lo"),
        part(F.shiftright("h", 32)).alias("hash_hi"),
        part(F.col("h").bitwiseAND(F.lit(LOW))).alias("hash_lo"),
        part(F.col("c")).alias("check"),
    )


def peel(cells: np.ndarray, sums: np.ndarray, third: int) -> tuple[np.ndarray, bool]:
    """Distinct keys that differ in one bucket, and whether the table came out empty. sums: the six columns of CELLS."""
    table = np.zeros((3 * third, 6), np.int64)
    table[cells] = sums
    keys: list[np.ndarray] = []
    while True:
        at = np.flatnonzero(table[:, 0])
        t = table[at]
        n = t[:, 0]
        even = ~((t % n[:, None]).any(axis=1)) if len(at) else np.zeros(0, bool)
        at, t, n = at[even], t[even], n[even]
        if not len(at):
            break
        one = t // n[:, None]
        with np.errstate(over="ignore"):
            k, h = (one[:, 1] << 32) + one[:, 2], (one[:, 3] << 32) + one[:, 4]
        places = np.stack([i * third + ((h.view(np.uint64) >> np.uint64(21 * i)) & np.uint64(0x1FFFFF)).astype(np.int64) % third for i in range(3)], 1)
        pure = ((xxhash64_of_long(k ^ h) & LOW) == one[:, 5]) & (one[:, 2] >= 0) & (one[:, 2] <= LOW) & (places == at[:, None]).any(axis=1)
        if not pure.any():
            break
        k, h, t, places = k[pure], h[pure], t[pure], places[pure]
        _, first = np.unique(np.stack([k, h], 1), axis=0, return_index=True)
        keys.append(k[first])
        for i in range(3):
            np.subtract.at(table, places[first, i], t[first])
    return (np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)), not table.any()


def differing_keys(cells: DataFrame, third: int) -> DataFrame:
    """(bucket, key): each key that the peeled tables reveal; a bucket that did not peel gives one row without a key."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, whole = peel(pdf["cell"].to_numpy(), pdf[["cnt", "key_hi", "key_lo", "hash_hi", "hash_lo", "check"]].to_numpy(np.int64), third)
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[0], "key": pd.array(keys if whole else [None], dtype="Int64")})

    return cells.where("cnt <> 0 OR key_hi <> 0 OR key_lo <> 0 OR hash_hi <> 0 OR hash_lo <> 0 OR check <> 0").groupBy("bucket").applyInPandas(one, "bucket bigint, key bigint")


def fetch(df: DataFrame, key: str, fields: dict[str, Column], latest: str | None, found: DataFrame, bucket: Column, n_keys: int, n_buckets: int, broadcast_rows: int) -> DataFrame:
    """(k, v): of each wanted key the row that counts, v holding the compared fields."""
    k = F.col(key).cast("bigint")
    rows = df.select(k.alias("k"), *(F.col(c).alias("at") for c in [latest] if c), F.struct(*(e.alias(n) for n, e in fields.items())).alias("v"))
    wanted = found.where("key IS NOT NULL").select(F.col("key").alias("k"))
    small = (lambda d, n: F.broadcast(d) if n <= broadcast_rows else d)
    if n_buckets:
        whole = found.where("key IS NULL").select("bucket")
        tagged = rows.withColumn("bucket", bucket)
        part = tagged.join(small(whole, n_buckets), "bucket", "left_semi").drop("bucket")
        rest = tagged.join(small(whole, n_buckets), "bucket", "left_anti").drop("bucket")
        rows = part.unionByName(rest.join(small(wanted, n_keys), "k", "left_semi"))
    else:
        rows = rows.join(small(wanted, n_keys), "k", "left_semi")
    order = F.struct(*(F.col("at") for _ in [latest] if latest), F.col("v"))
    return rows.groupBy("k").agg(F.max(order).alias("m")).select("k", "m.v")


def differences(
    left: DataFrame, right: DataFrame, key: str, fields: dict[str, Column], left_latest: str | None = None, right_latest: str | None = None,
    missing_right: str = "missing_in_copy", missing_left: str = "missing_in_inventory", bucket_keys: int = 8192, cells_per_key: float = 0.15, broadcast_rows: int = 200_000,
) -> DataFrame:
    """(key, diff, left_value, right_value): one row per difference between two copies of a table with a bigint key.

    `diff` is `missing_right`/`missing_left` for a key one side lacks, else the name of a field whose values differ;
    null differs from any value and equals null. `fields` maps names to the expressions compared. Where a side holds a
    key more than once, the row with the greatest `*_latest` counts (ties: the greatest field values). Rows without a
    key cannot be matched and are left out. Empty tables are fine on either side. Columns not named are never read.

    bucket_keys: key values per table, see `buckets_of`. cells_per_key: cells a table has per key value; about four fifths
    of the cells can be peeled, more differences take the exact path. broadcast_rows: up to so many differing keys (some 20
    MB as a hash table) are broadcast; more are joined by shuffle.
    """
    third = max(8, int(bucket_keys * cells_per_key / 3))
    bucket = buckets_of(left, right, key, bucket_keys)
    both = elements(left, key, fields, 1, bucket).unionAll(elements(right, key, fields, -1, bucket))
    found = cut(differing_keys(lookup_tables(both, third), third))
    counts = found.agg(F.count("key").alias("keys"), F.count_if(F.col("key").isNull()).alias("buckets")).first()
    a, b = (
        fetch(df, key, fields, latest, found, bucket, counts["keys"], counts["buckets"], broadcast_rows)
        for df, latest in ((left, left_latest), (right, right_latest))
    )
    names = list(fields)
    pair = a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), "k", "full")
    text = lambda side, n: F.col(f"{side}.{n}").cast("string")
    out = lambda name, l, r: F.struct(F.lit(name).alias("diff"), l.alias("left_value"), r.alias("right_value"))  # noqa: E731,E741
    none = F.lit(None).cast("string")
    cases = [F.when(F.col("b").isNull(), out(missing_right, none, none)), F.when(F.col("a").isNull(), out(missing_left, none, none))]
    cases += [F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")), out(n, text("a", n), text("b", n))) for n in names]
    return pair.select(F.col("k").alias("key"), F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("d")).select("key", "d.*")


def inventory_differences(inventory: DataFrame, copy: DataFrame) -> DataFrame:
    """`differences` of the two inventories: name and size exactly, crc32 without case and with null equal to empty."""
    fields = {"name": F.col("name"), "size": F.col("size"), "crc32": F.coalesce(F.lower("crc32"), F.lit(""))}
    return differences(inventory, copy, "inv_id", fields, right_latest="copied_at").withColumnRenamed("key", "inv_id")
