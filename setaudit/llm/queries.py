"""The queries of this subpackage and their SQL twins; see the modules for what cannot be said in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from setaudit.llm import leakage, spellings, survivors, tokenize, truncation
from setaudit.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "inventory"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.surviving_records(table(spark, sf_dir, "inventory"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.same_names(table(spark, sf_dir, "nointro_games"), "manufacturer").toDF("manufacturer_a", "manufacturer_b")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verified stretch, those with a few edits included."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"))


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_by_source(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_records, p3_found, p6_ids, p7_found, p7_stretches, p8_found, p8_sources)}

_GROUPS = """
WITH r AS (
  SELECT *, CASE WHEN regexp_matches(lower(trim(crc32)), '^(0x)?[0-9a-f]{1,8}$') THEN nullif(lpad(regexp_replace(lower(trim(crc32)), '^0x', ''), 8, '0'), '00000000') END AS c,
         CASE WHEN regexp_matches(lower(trim(sha1)), '^[0-9a-f]{40}$') AND NOT regexp_matches(trim(sha1), '^0+$') THEN lower(trim(sha1)) END AS s,
         CASE WHEN last_modified > 0 AND last_modified <= epoch_us(indexed_at) / 1000000.0 THEN last_modified END AS lm,
         CASE location_type WHEN 'file' THEN 0 WHEN 'archive' THEN 1 WHEN 'remote' THEN 2 ELSE 3 END AS lr
  FROM inventory),
m AS (SELECT size, c, count(DISTINCT s) AS k, max(s) AS one FROM r WHERE c IS NOT NULL GROUP BY size, c),
g AS (SELECT r.*, CASE WHEN r.s IS NOT NULL THEN 's' || r.s WHEN m.k = 1 THEN 's' || m.one ELSE 'c' || r.c END AS dump
      FROM r LEFT JOIN m ON r.size IS NOT DISTINCT FROM m.size AND r.c = m.c WHERE r.c IS NOT NULL OR r.s IS NOT NULL),
w AS (
  SELECT *, min(inv_id) OVER p AS group_id, count(*) OVER p AS n,
         row_number() OVER (PARTITION BY size, dump ORDER BY (c IS NOT NULL AND regexp_matches(lower(trim(crc32)), '^[0-9a-f]{8}$')) DESC, inv_id) AS r_crc,
         row_number() OVER (PARTITION BY size, dump ORDER BY (s IS NOT NULL) DESC, inv_id) AS r_sha,
         row_number() OVER (PARTITION BY size, dump ORDER BY lm DESC NULLS LAST, inv_id) AS r_lm,
         row_number() OVER (PARTITION BY size, dump ORDER BY lr, lm DESC NULLS LAST, inv_id) AS r_loc
  FROM g WINDOW p AS (PARTITION BY size, dump)),
f AS (
  SELECT group_id, 'crc32' AS field, inv_id FROM w WHERE n > 1 AND r_crc = 1 AND c IS NOT NULL AND regexp_matches(lower(trim(crc32)), '^[0-9a-f]{8}$')
  UNION ALL SELECT group_id, 'sha1', inv_id FROM w WHERE n > 1 AND r_sha = 1 AND s IS NOT NULL
  UNION ALL SELECT group_id, 'last_modified', inv_id FROM w WHERE n > 1 AND r_lm = 1 AND lm IS NOT NULL
  UNION ALL SELECT group_id, 'location', inv_id FROM w WHERE n > 1 AND r_loc = 1)
"""

# The runs of twelve words of every item text, looked up among those of every document.
_RUNS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM (SELECT item_id, passage AS t FROM eval_items UNION ALL SELECT item_id, question FROM eval_items) WHERE t IS NOT NULL),
dr AS (SELECT doc_id, list_aggregate(w[k:k+11], 'string_agg', ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
ir AS (SELECT DISTINCT item_id, list_aggregate(w[k:k+11], 'string_agg', ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
"""

SQL = {
    "p7_found": _RUNS + "SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)",
    "p2_found": _GROUPS + "SELECT group_id, field, inv_id FROM f",
    "p2_records": _GROUPS
    + """
SELECT f.group_id, lower(trim(max(CASE WHEN field = 'crc32' THEN i.crc32 END))) AS crc32, lower(trim(max(CASE WHEN field = 'sha1' THEN i.sha1 END))) AS sha1,
       max(CASE WHEN field = 'last_modified' THEN i.last_modified END) AS last_modified, max(CASE WHEN field = 'location' THEN i.location_type END) AS location_type,
       max(CASE WHEN field = 'location' THEN i.location_path END) AS location_path, max(CASE WHEN field = 'location' THEN i.location_entry END) AS location_entry
FROM f JOIN inventory i USING (inv_id) GROUP BY f.group_id""",
}
