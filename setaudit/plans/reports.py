"""Queries of reports and plans, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.functions import names
from setaudit.operators import audit, rebuild, reports, search
from setaudit.plans.audit import _BEST, _CLEAN, Tables, query
from setaudit.sinks import documents
from setaudit.sources import files

_CATEGORY = "CASE WHEN is_bios THEN 'BIOS' WHEN is_device THEN 'Device' WHEN clone_of IS NOT NULL THEN 'Clone' ELSE 'Parent' END"
_DECISION = "CASE WHEN NOT s.runnable THEN 'not_working' WHEN s.set_name IN (SELECT set_name FROM items WHERE status IN ('baddump', 'nodump')) THEN 'bad_dumps' WHEN found > 0 THEN 'rebuild' ELSE 'missing' END"
_OUT = f"""
, ent AS (SELECT DISTINCT {_CLEAN} AS stem, coalesce(location_entry, name) AS entry FROM inv WHERE location_type = 'archive'),
ready AS (SELECT w.set_name, count(e.entry) = count(*) AS complete FROM (SELECT DISTINCT set_name, name FROM items) w LEFT JOIN ent e ON lower(w.set_name) = e.stem AND w.name = e.entry WHERE lower(w.set_name) IN (SELECT stem FROM ent) GROUP BY w.set_name),
dec AS (SELECT st.set_name, {_DECISION} AS decision FROM st JOIN sets s ON st.set_name = s.set_name)"""
_RUN = _OUT + """
, d AS (SELECT dec.set_name, CASE WHEN decision = 'rebuild' AND coalesce(complete, false) THEN 'up_to_date' ELSE decision END AS decision FROM dec LEFT JOIN ready ON dec.set_name = ready.set_name),
per_item AS (SELECT set_name, count(*) AS items, count(*) FILTER (have) AS available FROM found GROUP BY set_name),
rc AS (SELECT decision, count(*) AS sets, coalesce(sum(items), 0)::BIGINT AS items, coalesce(sum(available), 0)::BIGINT AS available, coalesce(sum(items - available), 0)::BIGINT AS missing_items FROM d LEFT JOIN per_item p ON d.set_name = p.set_name GROUP BY decision)"""


@query("SELECT status, count(*) AS sets, sum(found)::BIGINT AS found_items, sum(required - found)::BIGINT AS missing_items, sum(required)::BIGINT AS total_items, CASE WHEN sum(required) > 0 THEN sum(found) * 100.0 / sum(required) ELSE 0.0 END AS percent FROM st GROUP BY status")
def audit_counts(t: Tables) -> DataFrame:
    return reports.audit_counts(t.status())


@query("SELECT st.set_name, st.status, coalesce(string_agg(DISTINCT CASE WHEN NOT have THEN name END, ',' ORDER BY CASE WHEN NOT have THEN name END), '') AS missing, coalesce(string_agg(DISTINCT CASE WHEN have AND f.status = 'baddump' THEN name END, ',' ORDER BY CASE WHEN have AND f.status = 'baddump' THEN name END), '') AS bad FROM st LEFT JOIN found f ON st.set_name = f.set_name GROUP BY st.set_name, st.status")
def audit_details(t: Tables) -> DataFrame:
    return reports.audit_details(t.status(), t.found)


@query("SELECT * FROM (SELECT status, set_name, row_number() OVER (PARTITION BY status ORDER BY set_name) AS place FROM st) WHERE place <= 10")
def first_sets_of_status(t: Tables) -> DataFrame:
    return reports.first_of_each(t.status().select("status", "set_name"), "status", [F.col("set_name").asc()], 10)


_MISSING = f"""
, fam AS (SELECT *, coalesce(clone_of, set_name) AS family, {_CATEGORY} AS category FROM sets),
lack AS (SELECT set_name, count(*) AS required, count(*) FILTER (NOT have) AS missing, coalesce(sum(size) FILTER (NOT have), 0)::BIGINT AS missing_size FROM found GROUP BY set_name),
alt AS (SELECT family, count(*) AS alternatives FROM fam JOIN lack ON fam.set_name = lack.set_name WHERE missing = 0 GROUP BY family),
rep AS (SELECT fam.set_name, description, year, manufacturer, category, required, missing, missing_size, coalesce(alternatives, 0) AS alternatives FROM fam JOIN lack ON fam.set_name = lack.set_name LEFT JOIN alt ON fam.family = alt.family WHERE missing > 0)"""


@query(_MISSING + " SELECT * FROM rep ORDER BY missing DESC, set_name")
def missing_report(t: Tables) -> DataFrame:
    return reports.missing_report(t.sets, t.found, "missing_count")


@query(_MISSING + " SELECT * FROM rep WHERE category IN ('Clone', 'Parent') ORDER BY year NULLS LAST, set_name")
def missing_report_by_year(t: Tables) -> DataFrame:
    return reports.missing_report(t.sets, t.found, "year", ("Clone", "Parent"))


@query(_MISSING + " SELECT category, count(*) AS sets, sum(missing)::BIGINT AS missing, sum(missing_size)::BIGINT AS missing_size FROM rep GROUP BY category ORDER BY category")
def missing_by_category(t: Tables) -> DataFrame:
    return reports.missing_report(t.sets, t.found).groupBy("category").agg(F.count("*").alias("sets"), F.sum("missing").alias("missing"), F.sum("missing_size").alias("missing_size")).orderBy("category")


@query("""
, iss AS (SELECT 'critical' AS severity, s.set_name, 'incomplete BIOS' AS issue FROM sets s JOIN st ON s.set_name = st.set_name WHERE is_bios AND status <> 'complete'
  UNION ALL SELECT 'warning', s.set_name, 'clone without parent' FROM sets s JOIN st ON s.set_name = st.set_name WHERE clone_of IS NOT NULL AND status = 'complete' AND clone_of NOT IN (SELECT set_name FROM st WHERE found > 0)
  UNION ALL SELECT 'info', set_name, 'does not run' FROM sets WHERE NOT runnable)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY set_name) AS place FROM iss) WHERE place <= 5""")
def first_issues(t: Tables) -> DataFrame:
    return reports.first_of_each(reports.issues(t.status(), t.sets), "severity", [F.col("set_name").asc()], 5)


def _decisions(t: Tables) -> DataFrame:
    return rebuild.decisions(t.status(), t.sets, t.items, allow_incomplete=True)


@query(_OUT + " SELECT set_name, complete FROM ready")
def output_complete(t: Tables) -> DataFrame:
    return reports.output_complete(t.items, t.copies)


@query(_RUN + " SELECT * FROM rc")
def rebuild_counts(t: Tables) -> DataFrame:
    return reports.rebuild_counts(_decisions(t), t.found, reports.output_complete(t.items, t.copies))


@query(_RUN + " SELECT *, CASE WHEN rebuilt + failed > 0 THEN rebuilt * 100.0 / (rebuilt + failed) ELSE 0.0 END AS success FROM (SELECT coalesce(sum(sets) FILTER (decision = 'rebuild'), 0)::BIGINT AS rebuilt, coalesce(sum(sets) FILTER (decision NOT IN ('rebuild', 'missing')), 0)::BIGINT AS skipped, coalesce(sum(sets) FILTER (decision = 'missing'), 0)::BIGINT AS failed, coalesce(sum(available) FILTER (decision = 'rebuild'), 0)::BIGINT AS items FROM rc)")
def rebuild_results(t: Tables) -> DataFrame:
    return reports.rebuild_results(reports.rebuild_counts(_decisions(t), t.found, reports.output_complete(t.items, t.copies)))


_MATCH = ", bc AS (" + _BEST.format(keys="crc32", order="lr", where="crc32 IS NOT NULL") + "), nm AS (SELECT *, lower(name) AS lname FROM inv), bn AS (" + _BEST.format(keys="lname, size", order="lr", where="lname IS NOT NULL AND size IS NOT NULL").replace("FROM inv ", "FROM nm ") + ")"


@query(_MATCH + f" SELECT DISTINCT i.set_name AS archive, i.name, v.inv_id, v.location_type, v.location_path, v.location_entry FROM items i JOIN (SELECT st.set_name FROM st JOIN sets s ON st.set_name = s.set_name WHERE {_DECISION} = 'rebuild') d ON i.set_name = d.set_name LEFT JOIN bc ON i.crc32 = bc.crc32 LEFT JOIN bn ON lower(i.name) = bn.lname AND i.size = bn.size JOIN inv v ON v.inv_id = coalesce(bc.inv_id, bn.inv_id)")
def rebuild_sources(t: Tables) -> DataFrame:
    return reports.rebuild_sources(_decisions(t), t.items, t.copies)


@query(_MATCH + ", bo AS (" + _BEST.format(keys="lname", order="lr", where="lname IS NOT NULL").replace("FROM inv ", "FROM nm ") + """)
SELECT i.set_name, i.name, i.size, i.crc32, CASE WHEN i.crc32 IS NOT NULL THEN CASE WHEN bc.inv_id IS NOT NULL THEN 'crc32' END WHEN bn.inv_id IS NOT NULL THEN 'name_size' WHEN bo.inv_id IS NOT NULL THEN 'name' END AS matched_by,
       CASE WHEN i.crc32 IS NOT NULL THEN bc.inv_id ELSE coalesce(bn.inv_id, bo.inv_id) END AS inv_id
FROM items i LEFT JOIN bc ON i.crc32 = bc.crc32 LEFT JOIN bn ON lower(i.name) = bn.lname AND i.size = bn.size LEFT JOIN bo ON lower(i.name) = bo.lname""")
def match_without_fallback(t: Tables) -> DataFrame:
    return reports.match_without_fallback(t.items, t.copies)


_TITLE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\s*\([^)]+\)', '', 'g'), '\s*\[[^\]]+\]', '', 'g'), '\s+(v|V|rev|Rev|REV)\s*[\d.]+[a-zA-Z]?', '', 'g'), '\s+\(?Proto\)?', '', 'gi'), '\s+\(?Beta\)?', '', 'gi'), '\s+\(?Demo\)?', '', 'gi'), '\s+\(?Sample\)?', '', 'gi'), '\s+\(?Alt\)?', '', 'gi'), '\s+\(?Hack\)?', '', 'gi'))"""
_STEM = r"regexp_replace(regexp_extract({}, '[^/]*$'), '(.)\.[^.]*$', '\1')"


@query(f"""
, src AS (SELECT DISTINCT location_path AS source FROM inv WHERE location_type = 'file'),
p AS (SELECT source, regexp_replace(source, '[^/]*$', '') || {_TITLE.format(_STEM.format('source'))} || regexp_extract(source, '[^/](\\.[^./]*)$', 1) AS target FROM src)
SELECT p.source, p.target, CASE WHEN p.source = p.target THEN 'keep' WHEN e.source IS NOT NULL OR row_number() OVER (PARTITION BY p.target ORDER BY p.source) > 1 THEN 'skip' ELSE 'rename' END AS action FROM p LEFT JOIN src e ON p.target = e.source""")
def clean_names_plan(t: Tables) -> DataFrame:
    return reports.clean_names_plan(t.copies)


@query(f"""
, a AS (SELECT DISTINCT location_path AS source FROM inv WHERE location_type IN ('archive', 'file')),
p AS (SELECT source, '/sorted/' || CASE WHEN regexp_matches(upper(set_name[1]), '^[A-Z]$') THEN upper(set_name[1]) ELSE '#' END || '/' || regexp_extract(source, '[^/]*$') AS target FROM a JOIN sets ON {_CLEAN.replace('location_path', 'source')} = lower(set_name))
SELECT source, target, CASE WHEN source = target THEN 'keep' WHEN row_number() OVER (PARTITION BY target ORDER BY source) > 1 THEN 'skip' ELSE 'move' END AS action FROM p""")
def organize_plan(t: Tables) -> DataFrame:
    return reports.organize_plan(t.sets, t.copies, "alphabet", "/sorted")


@query(", b AS (" + _BEST.format(keys="crc32, size", order="ar", where="crc32 IS NOT NULL AND size IS NOT NULL") + ") SELECT b.inv_id, b.location_path AS source, '/merged/' || v.name AS target, CASE WHEN row_number() OVER (PARTITION BY lower(v.name) ORDER BY b.inv_id) > 1 THEN 'collision' ELSE 'copy' END AS action FROM b JOIN inv v ON b.inv_id = v.inv_id")
def consolidate_plan(t: Tables) -> DataFrame:
    return reports.consolidate_plan(t.copies, "/merged")


@query("SELECT count(*) AS sources, sum(rom_count)::BIGINT AS roms, sum(total_size)::BIGINT AS size FROM scan_sources", base=False)
def source_count(t: Tables) -> DataFrame:
    return t.sources.agg(F.count("*").alias("sources"), F.sum("rom_count").alias("roms"), F.sum("total_size").alias("size"))


@query("SELECT sha1 AS hash, count(*) AS files, min(location_path) AS first_path FROM inv WHERE location_type = 'file' AND sha1 IS NOT NULL GROUP BY sha1 HAVING count(*) > 1")
def file_hash_duplicates(t: Tables) -> DataFrame:
    return files.same_files(t.copies.where("location_type = 'file'").withColumnRenamed("location_path", "path"))


@query("SELECT crc32, count(*) OVER (PARTITION BY crc32) AS copies, location_path || coalesce('::' || location_entry, '') AS place, inv_id FROM inv WHERE crc32 IN (SELECT crc32 FROM inv WHERE crc32 IS NOT NULL GROUP BY crc32 HAVING count(*) > 1)")
def duplicate_places(t: Tables) -> DataFrame:
    return search.duplicate_places(t.copies)


@query("SELECT inv_id, name, size, crc32, location_path, location_entry FROM (SELECT *, row_number() OVER (PARTITION BY location_path, location_entry ORDER BY inv_id % 2 DESC, inv_id DESC) AS r FROM inv) WHERE r = 1")
def upserted(t: Tables) -> DataFrame:
    """The rows of odd ids put into those of even ids, each replacing what lies at its place."""
    even = F.col("inv_id") % 2 == 0
    return files.upsert(t.copies.where(even), t.copies.where(~even), ("inv_id",)).select("inv_id", "name", "size", "crc32", "location_path", "location_entry")


@query("""
, a AS (SELECT DISTINCT location_path FROM inv WHERE last_modified % 3 <> 0), b AS (SELECT DISTINCT location_path FROM inv WHERE last_modified % 3 <> 1)
SELECT location_path, 'added' AS change FROM b WHERE location_path NOT IN (SELECT location_path FROM a) UNION ALL SELECT location_path, 'removed' FROM a WHERE location_path NOT IN (SELECT location_path FROM b)""")
def changed_places(t: Tables) -> DataFrame:
    """What a later scan adds and removes; the two scans are the rows by their times."""
    return files.changed_places(t.copies.where("last_modified % 3 <> 0"), t.copies.where("last_modified % 3 <> 1"))


@query("SELECT st.status, st.set_name, coalesce(string_agg(DISTINCT CASE WHEN NOT have THEN name END, ',' ORDER BY CASE WHEN NOT have THEN name END), '') AS missing FROM st LEFT JOIN found f ON st.set_name = f.set_name WHERE st.status <> 'complete' GROUP BY st.status, st.set_name")
def analysis_round_trip(t: Tables) -> DataFrame:
    """The sets to rebuild, read back from the lines of an exported analysis."""
    return documents.to_rebuild(documents.analysis_lines(reports.audit_details(t.status(), t.found)))


@query("SELECT inv_id, CASE WHEN size < 1000 THEN printf('%d bytes', size) WHEN size < 1000000 THEN printf('%.1f kB', round(size / 1e3, 1)) WHEN size < 1000000000 THEN printf('%.1f MB', round(size / 1e6, 1)) ELSE printf('%.1f GB', round(size / 1e9, 1)) END AS text, CASE WHEN last_modified < 0 THEN false ELSE epoch(indexed_at)::BIGINT - last_modified > 86400 END AS old FROM inventory WHERE size IS NOT NULL AND size < 1000000000000 AND last_modified IS NOT NULL AND last_modified >= 0", base=False)
def size_and_age_texts(t: Tables) -> DataFrame:
    i = t.raw("inventory").where("size IS NOT NULL AND size < 1000000000000 AND last_modified IS NOT NULL AND last_modified >= 0")
    return i.select("inv_id", names.bytes_in(F.col("size")).alias("text"), names.is_old(F.col("last_modified"), F.unix_timestamp("indexed_at")).alias("old"))
