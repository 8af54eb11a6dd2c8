"""The queries p1, p4 and p5: snapshot changes, nested records, differences between copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setaudit.operators import nested, reconcile, snapshots
from setaudit.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snapshots.dat_changes(table(spark, sf_dir, "nointro_games"))
    return found.select(F.col("stream").alias("dat_name"), "version", F.col("key").alias("name"), "diff")


def p1_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by DAT and version, compared in every descriptive column: how many games each change touches."""
    games = table(spark, sf_dir, "nointro_games")
    text = {n: snapshots.blank_to_null(snapshots.squeeze(n)) for n in ("description", "manufacturer", "year", "category", "serial", "revision", "region", "language")}
    found = snapshots.snapshot_changes(games, "dat_name", "version", "name", text, "delivered_at")
    return found.groupBy(F.col("stream").alias("dat_name"), "version", "diff").agg(F.count("*").alias("games"), F.coalesce(F.sum(F.when(F.size("fields") > 0, F.size("fields"))), F.lit(0)).alias("field_changes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.flatten_records(table(spark, sf_dir, "machine_records"), "record_id", "payload")
    return rows.select("record_id", "child", "parent_pos", "pos")


def p4_roms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.flatten_records(table(spark, sf_dir, "machine_records"), "record_id", "payload", nested.MACHINE_KINDS[:1])
    return nested.scalar_fields(rows, "rom")


def _p4_kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return nested.scalar_fields(nested.flatten_records(table(spark, sf_dir, "machine_records"), "record_id", "payload"), kind)


def p4_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4_kind(spark, sf_dir, "disk")


def p4_dipswitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4_kind(spark, sf_dir, "dipswitch")


def p4_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4_kind(spark, sf_dir, "diplocation")


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4_kind(spark, sf_dir, "dipvalue")


def p4_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.machine_rows(table(spark, sf_dir, "machine_records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconcile.inventory_differences(table(spark, sf_dir, "inventory"), table(spark, sf_dir, "inventory_copy"))
    return found.select("inv_id", "diff")


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences with the values on both sides."""
    return reconcile.inventory_differences(table(spark, sf_dir, "inventory"), table(spark, sf_dir, "inventory_copy"))


QUERIES = {f.__name__: f for f in (p1_found, p1_fields, p4_found, p4_roms, p4_disks, p4_dipswitches, p4_locations, p4_values, p4_machines, p5_found, p5_values)}

_SNAPSHOTS = r"""
WITH norm AS (
  SELECT dat_name, version, delivered_at, trim(regexp_replace(name, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g')) AS name,
         {fields}
  FROM nointro_games),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dat_name, version, name ORDER BY delivered_at DESC, {order}) AS rn FROM norm) WHERE rn = 1),
steps AS (SELECT dat_name, version, row_number() OVER (PARTITION BY dat_name ORDER BY [CAST(x AS HUGEINT) FOR x IN regexp_extract_all(version, '[0-9]+')], version) AS ord FROM (SELECT DISTINCT dat_name, version FROM norm)),
rows_at AS (SELECT l.*, s.ord FROM latest l JOIN steps s ON l.dat_name = s.dat_name AND l.version = s.version),
pairs AS (SELECT a.dat_name, a.version AS old_version, b.version, b.ord FROM steps a JOIN steps b ON a.dat_name = b.dat_name AND b.ord = a.ord + 1),
olds AS (SELECT p.dat_name, p.version AS to_version, r.* EXCLUDE (dat_name, version) FROM pairs p JOIN rows_at r ON r.dat_name = p.dat_name AND r.version = p.old_version),
news AS (SELECT p.dat_name, p.version AS to_version, r.* EXCLUDE (dat_name, version) FROM pairs p JOIN rows_at r ON r.dat_name = p.dat_name AND r.version = p.version)
"""


def _clean(column: str) -> str:
    return rf"nullif(trim(regexp_replace({column}, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g')), '') AS {column}"


_FIELDS = ("description", "manufacturer", "year", "category", "serial", "revision", "region", "language")
_EIGHT = " + ".join(f"(o.{n} IS DISTINCT FROM n.{n})::INT" for n in _FIELDS)
_INVENTORIES = """
WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY inv_id ORDER BY copied_at DESC, name DESC NULLS LAST, size DESC NULLS LAST, coalesce(lower(crc32), '') DESC) AS rn FROM inventory_copy) WHERE rn = 1),
j AS (SELECT coalesce(a.inv_id, b.inv_id) AS inv_id, a.inv_id AS ai, b.inv_id AS bi, a.name AS an, b.name AS bn, a.size AS asz, b.size AS bs,
             coalesce(lower(a.crc32), '') AS ac, coalesce(lower(b.crc32), '') AS bc
      FROM inventory a FULL JOIN b ON a.inv_id = b.inv_id),
d AS (
  SELECT inv_id, 'missing_in_copy' AS diff, NULL AS left_value, NULL AS right_value FROM j WHERE bi IS NULL
  UNION ALL SELECT inv_id, 'missing_in_inventory', NULL, NULL FROM j WHERE ai IS NULL
  UNION ALL SELECT inv_id, 'name', an, bn FROM j WHERE ai IS NOT NULL AND bi IS NOT NULL AND an IS DISTINCT FROM bn
  UNION ALL SELECT inv_id, 'size', CAST(asz AS VARCHAR), CAST(bs AS VARCHAR) FROM j WHERE ai IS NOT NULL AND bi IS NOT NULL AND asz IS DISTINCT FROM bs
  UNION ALL SELECT inv_id, 'crc32', ac, bc FROM j WHERE ai IS NOT NULL AND bi IS NOT NULL AND ac <> bc)
"""

_TREE = r"""
WITH j AS (SELECT record_id, payload FROM machine_records WHERE json_valid(payload)),
n0 AS (SELECT record_id, '0:' || t.id AS id, '0:' || t.parent AS parent, t.type, t.key, t.atom FROM j, json_tree(j.payload) t),
n AS (
  SELECT record_id, id, parent, type, key FROM n0
  UNION ALL SELECT n0.record_id, n0.id || ':' || t.id, coalesce(n0.id || ':' || t.parent, n0.parent), t.type, coalesce(t.key, n0.key)
  FROM n0, json_tree(CASE WHEN json_valid(n0.atom->>'$') THEN n0.atom->>'$' END) t WHERE n0.type = 'VARCHAR' AND regexp_matches(n0.atom->>'$', '^\s*[\[{]')),
k AS (SELECT *, CASE lower(regexp_replace(key, '^[@_]+', '')) WHEN 'rom' THEN 'rom' WHEN 'roms' THEN 'rom' WHEN 'disk' THEN 'disk' WHEN 'disks' THEN 'disk' WHEN 'dipswitch' THEN 'dipswitch' WHEN 'dipswitches' THEN 'dipswitch'
  WHEN 'diplocation' THEN 'diplocation' WHEN 'diplocations' THEN 'diplocation' WHEN 'location' THEN 'diplocation' WHEN 'locations' THEN 'diplocation'
  WHEN 'dipvalue' THEN 'dipvalue' WHEN 'dipvalues' THEN 'dipvalue' WHEN 'value' THEN 'dipvalue' WHEN 'values' THEN 'dipvalue' END AS child FROM n),
o AS (
  SELECT record_id, id, parent AS holder, child, 0 AS pos FROM k WHERE type = 'OBJECT' AND child IS NOT NULL
  UNION ALL SELECT x.record_id, x.id, l.parent, l.child, row_number() OVER (PARTITION BY x.record_id, x.parent ORDER BY CAST(x.key AS INT)) - 1
  FROM k x JOIN k l ON x.record_id = l.record_id AND x.parent = l.id WHERE x.type = 'OBJECT' AND l.type = 'ARRAY' AND l.child IS NOT NULL)
"""

SQL = {
    "p4_found": _TREE
    + """
SELECT o.record_id, o.child, CASE WHEN o.child IN ('diplocation', 'dipvalue') THEN d.pos ELSE -1 END AS parent_pos, o.pos
FROM o LEFT JOIN o d ON d.record_id = o.record_id AND d.id = o.holder AND d.child = 'dipswitch' WHERE o.child NOT IN ('diplocation', 'dipvalue') OR d.id IS NOT NULL""",
    "p4_machines": """
WITH j AS (SELECT record_id, CAST(payload AS JSON) AS v FROM machine_records WHERE json_valid(payload)),
p AS (SELECT record_id, unnest([v->'$.body.machine', v->'$.machine', v]) AS m, unnest([1, 2, 3]) AS k FROM j),
f AS (SELECT record_id, k, CASE WHEN json_type(m) = 'ARRAY' THEN [x FOR x IN CAST(m AS JSON[]) IF json_type(x) = 'OBJECT'][1] WHEN json_type(m) = 'OBJECT' THEN m END AS m FROM p),
b AS (SELECT record_id, arg_min(m, k) AS m FROM f WHERE m IS NOT NULL GROUP BY record_id)
SELECT record_id, CAST(record_id AS VARCHAR) AS key, """
    + ", ".join(f"""coalesce(m->>'$.{n}', m->>'$."@{n}"', m->>'$."_{n}"') AS {n}""" for n in ("name", "description", "year", "cloneof", "sourcefile"))
    + " FROM j LEFT JOIN b USING (record_id)",
    "p1_found": _SNAPSHOTS.format(fields=_clean("description"), order="description DESC NULLS LAST")
    + """
SELECT coalesce(o.dat_name, n.dat_name) AS dat_name, coalesce(o.to_version, n.to_version) AS version, coalesce(o.name, n.name) AS name,
       CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS diff
FROM olds o FULL JOIN news n ON o.dat_name = n.dat_name AND o.to_version = n.to_version AND o.name = n.name
WHERE o.name IS NULL OR n.name IS NULL OR o.description IS DISTINCT FROM n.description""",
    "p1_fields": _SNAPSHOTS.format(fields=", ".join(map(_clean, _FIELDS)), order=", ".join(f"{n} DESC NULLS LAST" for n in _FIELDS))
    + f"""
, d AS (
SELECT coalesce(o.dat_name, n.dat_name) AS dat_name, coalesce(o.to_version, n.to_version) AS version,
       CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS diff,
       CASE WHEN o.name IS NOT NULL AND n.name IS NOT NULL THEN {_EIGHT} ELSE 0 END AS k
FROM olds o FULL JOIN news n ON o.dat_name = n.dat_name AND o.to_version = n.to_version AND o.name = n.name
WHERE o.name IS NULL OR n.name IS NULL OR {_EIGHT} > 0)
SELECT dat_name, version, diff, count(*) AS games, CAST(sum(k) AS BIGINT) AS field_changes FROM d GROUP BY ALL""",
    "p5_found": _INVENTORIES + "SELECT inv_id, diff FROM d",
    "p5_values": _INVENTORIES + "SELECT * FROM d",
}
