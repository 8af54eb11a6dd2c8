"""Queries over the catalogue and the inventory, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setaudit.functions import checksums, names
from setaudit.operators import audit, graph, rebuild, reports, search
from setaudit.session import table
from setaudit.sinks import documents
from setaudit.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_CRC = "nullif(lpad(nullif(regexp_extract(lower(trim(crc32)), '^(?:0x)?([0-9a-f]{1,8})$', 1), ''), 8, '0'), '00000000')"
_SHA = "CASE WHEN regexp_matches(lower(trim(sha1)), '^[0-9a-f]{40}$') AND NOT regexp_matches(trim(sha1), '^0+$') THEN lower(trim(sha1)) END"
_MD5 = "CASE WHEN regexp_matches(lower(trim(md5)), '^[0-9a-f]{32}$') AND NOT regexp_matches(trim(md5), '^0+$') THEN lower(trim(md5)) END"
_BASE = f"""
WITH RECURSIVE sets AS (SELECT DISTINCT * FROM game_sets),
items AS (SELECT set_name, name, size, {_CRC} AS crc32, {_SHA} AS sha1, {_MD5} AS md5, CASE WHEN lower(status) IN ('baddump', 'nodump', 'verified') THEN lower(status) WHEN lower(status) = 'bad' THEN 'baddump' ELSE 'good' END AS status, merge FROM (SELECT DISTINCT * FROM set_items)),
inv AS (SELECT inv_id, name, size, {_CRC} AS crc32, {_SHA} AS sha1, {_MD5} AS md5, location_type, location_path, location_entry, last_modified, source_path,
               CASE location_type WHEN 'file' THEN 0 WHEN 'archive' THEN 1 WHEN 'remote' THEN 2 ELSE 3 END AS lr, CASE location_type WHEN 'archive' THEN 0 WHEN 'file' THEN 1 WHEN 'remote' THEN 2 ELSE 3 END AS ar FROM inventory),
have AS (SELECT DISTINCT crc32 FROM inv WHERE crc32 IS NOT NULL),
found AS (SELECT i.*, h.crc32 IS NOT NULL AS have FROM items i LEFT JOIN have h ON i.crc32 = h.crc32),
per AS (SELECT s.set_name, count(f.name) AS required, count(f.name) FILTER (have) AS found, count(f.name) FILTER (have AND status = 'baddump') AS bad FROM sets s LEFT JOIN found f ON s.set_name = f.set_name GROUP BY s.set_name),
pix AS (SELECT s.set_name, count(f.name) AS required, count(f.name) FILTER (have) AS found FROM sets s LEFT JOIN (SELECT * FROM found WHERE crc32 IS NOT NULL) f ON s.set_name = f.set_name GROUP BY s.set_name),
st AS (SELECT set_name, required, found, CASE WHEN required = found AND found > 0 THEN 'complete' WHEN found > 0 THEN 'incomplete' ELSE 'missing' END AS status FROM pix),
edges AS (SELECT DISTINCT * FROM (SELECT set_name AS src, bios_set AS dst, 'bios' AS kind FROM sets WHERE bios_set IS NOT NULL
  UNION ALL SELECT d.src, d.dst, 'device' FROM (SELECT set_name AS src, unnest(device_refs) AS dst FROM sets) d WHERE d.dst IN (SELECT set_name FROM sets WHERE is_device)
  UNION ALL SELECT set_name, rom_of, 'parent' FROM sets WHERE rom_of IS NOT NULL)),
clos(root, node, depth) USING KEY (root, node) AS (SELECT DISTINCT src, dst, 1 FROM edges WHERE src <> dst
  UNION SELECT w.root, e.dst, min(w.depth) + 1 FROM clos w JOIN edges e ON w.node = e.src LEFT JOIN recurring.clos r ON r.root = w.root AND r.node = e.dst WHERE r.root IS NULL AND w.root <> e.dst GROUP BY w.root, e.dst)
"""
_RANK = "ORDER BY {order}, coalesce(-last_modified, 4611686018427387904), location_path, coalesce(location_entry, ''), inv_id"


def query(sql: str | None, base: bool = True) -> Callable:
    def add(f: Callable[["Tables"], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = (_BASE if base else "") + sql
        return f

    return add


class Tables:
    """The tables of one folder as the operators take them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    sets = property(lambda s: audit.sets_of(s.raw("game_sets")))
    items = property(lambda s: audit.items_of(s.raw("set_items")))
    copies = property(lambda s: audit.copies_of(s.raw("inventory")))
    sources = property(lambda s: s.raw("scan_sources"))
    found = property(lambda s: audit.available(s.items, s.copies))

    def status(self, rule: str = "index") -> DataFrame:
        return audit.set_status(self.sets, self.found, rule)


# ---- status of sets -------------------------------------------------------------------------------------------------


@query("SELECT set_name, required, found, status FROM st")
def set_status_index(t: Tables) -> DataFrame:
    return t.status()


@query("SELECT set_name, required, found, CASE WHEN required = found THEN 'complete' WHEN found = 0 THEN 'missing' ELSE 'incomplete' END AS status FROM per")
def set_status_generic(t: Tables) -> DataFrame:
    return t.status("generic")


@query("SELECT set_name, required, found, CASE WHEN found = 0 THEN 'missing' WHEN required = found AND bad = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM per")
def set_status_strict(t: Tables) -> DataFrame:
    return t.status("strict")


_CLEAN = "trim(replace(replace(lower(regexp_replace(regexp_extract(location_path, '[^/]*$'), '(.)\\.[^.]*$', '\\1')), '.zip', ''), '.7z', ''))"


@query(
    f"""
, ent AS (SELECT {_CLEAN} AS stem, coalesce(location_entry, name) AS entry, min(crc32) AS crc32 FROM inv WHERE location_type = 'archive' GROUP BY 1, 2),
dir AS (SELECT i.set_name, count(*) AS required, count(e.entry) AS found, count(*) FILTER (i.crc32 <> e.crc32) AS broken FROM items i LEFT JOIN ent e ON lower(i.set_name) = e.stem AND i.name = e.entry GROUP BY i.set_name),
lo AS (SELECT DISTINCT lower(regexp_replace(regexp_extract(location_path, '[^/]*$'), '(.)\\.[^.]*$', '\\1')) AS stem FROM inv WHERE location_type = 'file')
SELECT s.set_name, coalesce(d.required, 0) AS required, CASE WHEN a.stem IS NOT NULL THEN coalesce(d.found, 0) WHEN lo.stem IS NOT NULL THEN 1 ELSE 0 END AS found, coalesce(d.broken, 0) AS broken,
       CASE WHEN a.stem IS NULL THEN CASE WHEN lo.stem IS NULL THEN 'missing' ELSE 'incomplete' END WHEN coalesce(d.broken, 0) > 0 THEN 'broken' WHEN coalesce(d.found, 0) = coalesce(d.required, 0) THEN 'complete' ELSE 'incomplete' END AS status
FROM sets s LEFT JOIN dir d ON s.set_name = d.set_name LEFT JOIN (SELECT DISTINCT stem FROM ent) a ON lower(s.set_name) = a.stem LEFT JOIN lo ON lower(s.set_name) = lo.stem"""
)
def set_status_direct(t: Tables) -> DataFrame:
    return audit.set_status_direct(t.sets, t.items, t.copies)


@query(
    """
, nms AS (SELECT DISTINCT lower(name) AS lname, size FROM inv),
hit AS (SELECT i.set_name, h.crc32 IS NOT NULL OR n.lname IS NOT NULL AS have FROM items i LEFT JOIN have h ON i.crc32 = h.crc32 LEFT JOIN nms n ON lower(i.name) = n.lname AND i.size = n.size),
c AS (SELECT s.set_name, count(hit.have) AS required, count(*) FILTER (hit.have) AS found FROM sets s LEFT JOIN hit ON s.set_name = hit.set_name GROUP BY s.set_name)
SELECT set_name, required, found, CASE WHEN required = found AND found > 0 THEN 'complete' WHEN found > 0 THEN 'incomplete' ELSE 'missing' END AS status FROM c"""
)
def set_status_indexed(t: Tables) -> DataFrame:
    matched = audit.match_items(t.items, t.copies).withColumn("have", F.col("matched_by").isNotNull())
    return audit.set_status(t.sets, matched, "indexed")


@query("SELECT set_name, name, size, crc32 FROM found WHERE NOT have")
def missing_items(t: Tables) -> DataFrame:
    return t.found.where("NOT have").select("set_name", "name", "size", "crc32")


@query("SELECT set_name FROM sets WHERE set_name NOT IN (SELECT set_name FROM st WHERE status <> 'missing')")
def missing_sets(t: Tables) -> DataFrame:
    return t.sets.join(t.status().where("status <> 'missing'"), "set_name", "left_anti").select("set_name")


@query("SELECT inv_id, location_path FROM inv WHERE crc32 IS NULL OR crc32 NOT IN (SELECT crc32 FROM items WHERE crc32 IS NOT NULL)")
def unknown_files(t: Tables) -> DataFrame:
    return t.copies.join(t.items.select("crc32"), "crc32", "left_anti").select("inv_id", "location_path")


@query("SELECT c.set_name, c.clone_of FROM sets c JOIN st ON c.set_name = st.set_name WHERE st.status = 'complete' AND c.clone_of IS NOT NULL AND c.clone_of NOT IN (SELECT set_name FROM st WHERE found > 0)")
def orphan_clones(t: Tables) -> DataFrame:
    st = t.status()
    clones = t.sets.where("clone_of IS NOT NULL").join(st.where("status = 'complete'").select("set_name"), "set_name", "left_semi")
    return clones.join(st.where("found > 0").select(F.col("set_name").alias("clone_of")), "clone_of", "left_anti").select("set_name", "clone_of")


# ---- statistics -----------------------------------------------------------------------------------------------------


def _one(t: Tables) -> DataFrame:
    f = t.found
    sized = f.agg(F.count("*").alias("items"), F.count_if("have").alias("found_items"), F.sum("size").alias("total_size"), F.coalesce(F.sum(F.when(~F.col("have"), F.col("size"))), F.lit(0)).alias("missing_size"))
    return t.status().agg(*audit.totals()).join(sized, F.lit(True))


@query("SELECT a.*, b.*, total_size - missing_size AS collection_size FROM (SELECT count(*) AS total, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'incomplete') AS incomplete, count(*) FILTER (status = 'missing') AS missing FROM st) a, (SELECT count(*) AS items, count(*) FILTER (have) AS found_items, sum(size)::BIGINT AS total_size, coalesce(sum(size) FILTER (NOT have), 0)::BIGINT AS missing_size FROM found) b")
def stats_overall(t: Tables) -> DataFrame:
    return _one(t).withColumn("collection_size", F.col("total_size") - F.col("missing_size"))


def _by(t: Tables, column: str) -> DataFrame:
    st = t.status()
    return st.join(t.sets.select("set_name", column), "set_name").where(F.col(column).isNotNull()).groupBy(column).agg(*audit.totals())


_BY = "SELECT s.{0}, count(*) AS total, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'incomplete') AS incomplete, count(*) FILTER (status = 'missing') AS missing FROM sets s JOIN st ON s.set_name = st.set_name WHERE s.{0} IS NOT NULL GROUP BY s.{0}"


@query(_BY.format("year"))
def stats_by_year(t: Tables) -> DataFrame:
    return _by(t, "year")


@query(_BY.format("manufacturer"))
def stats_by_manufacturer(t: Tables) -> DataFrame:
    return _by(t, "manufacturer")


@query(_BY.format("manufacturer") + " ORDER BY total DESC, manufacturer LIMIT 10")
def top_manufacturers(t: Tables) -> DataFrame:
    return _by(t, "manufacturer").orderBy(F.desc("total"), "manufacturer").limit(10)


@query("SELECT * FROM (" + _BY.format("year") + " ORDER BY year DESC LIMIT 20) ORDER BY year")
def last_years(t: Tables) -> DataFrame:
    return _by(t, "year").orderBy(F.desc("year")).limit(20).orderBy("year")


@query("SELECT CASE WHEN is_bios THEN 'BIOS' WHEN is_device THEN 'Device' WHEN clone_of IS NOT NULL THEN 'Clone' ELSE 'Parent' END AS category, count(*) AS total, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'incomplete') AS incomplete, count(*) FILTER (status = 'missing') AS missing FROM sets s JOIN st ON s.set_name = st.set_name GROUP BY 1")
def stats_by_category(t: Tables) -> DataFrame:
    st = t.status()
    category = F.when(F.col("is_bios"), "BIOS").when(F.col("is_device"), "Device").when(F.col("clone_of").isNotNull(), "Clone").otherwise("Parent")
    return st.join(t.sets, "set_name").groupBy(category.alias("category")).agg(*audit.totals())


@query("""
, iss AS (SELECT count(*) FILTER (s.is_bios AND st.status <> 'complete') AS critical, count(*) FILTER (s.clone_of IS NOT NULL AND st.status = 'complete' AND p.set_name IS NULL) AS warning, count(*) FILTER (NOT s.runnable) AS info
  FROM sets s JOIN st ON s.set_name = st.set_name LEFT JOIN (SELECT set_name FROM st WHERE found > 0) p ON s.clone_of = p.set_name)
SELECT critical, warning, info, 100.0 * c / n AS completion, greatest(0.0, least(100.0, 100.0 * c / n - 10 * critical - 5 * warning - info)) AS health FROM iss, (SELECT count(*) FILTER (status = 'complete') AS c, count(*) AS n FROM st)""")
def health_score(t: Tables) -> DataFrame:
    st = t.status()
    parents = st.where("found > 0").select(F.col("set_name").alias("p"))
    all_ = st.join(t.sets, "set_name").join(parents, F.col("clone_of") == F.col("p"), "left")
    one = all_.agg(
        F.count_if(F.col("is_bios") & (F.col("status") != "complete")).alias("critical"), F.count_if(F.col("clone_of").isNotNull() & (F.col("status") == "complete") & F.col("p").isNull()).alias("warning"),
        F.count_if(~F.col("runnable")).alias("info"), names.percent(F.count_if(F.col("status") == "complete"), F.count("*")).alias("completion"),
    )
    return one.withColumn("health", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.expr("completion - 10 * critical - 5 * warning - info"))))


@query("SELECT s.set_name, count(*) AS missing FROM sets s JOIN found f ON s.set_name = f.set_name WHERE NOT have AND s.clone_of IS NOT NULL GROUP BY s.set_name ORDER BY missing DESC, s.set_name LIMIT 10")
def missing_report_clones(t: Tables) -> DataFrame:
    clones = t.sets.where("clone_of IS NOT NULL").select("set_name")
    return t.found.where("NOT have").join(clones, "set_name", "left_semi").groupBy("set_name").agg(F.count("*").alias("missing")).orderBy(F.desc("missing"), "set_name").limit(10)


# ---- search ---------------------------------------------------------------------------------------------------------


@query("SELECT q.inv_id AS asked, v.inv_id, v.name, v.location_type, row_number() OVER (PARTITION BY q.inv_id ORDER BY v.location_type, v.last_modified DESC NULLS LAST, v.inv_id) AS place FROM inv q JOIN inv v ON q.crc32 = v.crc32 WHERE q.inv_id % 50 = 0")
def find_by_crc(t: Tables) -> DataFrame:
    """The copies of the checksums of every row whose id is divisible by 50, in the order of a search."""
    asked = t.copies.where("inv_id % 50 = 0").select(F.col("inv_id").alias("asked"), F.col("crc32").alias("query"))
    return search.by_crc(t.copies, asked).select("asked", "inv_id", "name", "location_type", "place")


@query("SELECT v.crc32, first(name ORDER BY location_type, last_modified DESC NULLS LAST, inv_id) AS name, first(size ORDER BY location_type, last_modified DESC NULLS LAST, inv_id) AS size, count(*) AS copies, count(*) > 1 AS duplicate FROM inv v WHERE crc32 IS NOT NULL GROUP BY v.crc32")
def rom_info(t: Tables) -> DataFrame:
    return search.rom_info(t.copies)


@query("SELECT inv_id, name, location_type FROM inv WHERE name ILIKE '%ba%.bin' ORDER BY name, location_type, inv_id LIMIT 100")
def find_by_name_like(t: Tables) -> DataFrame:
    return search.by_name(t.copies, "%ba%.bin", limit=100).select("inv_id", "name", "location_type")


@query("SELECT q.set_name, q.name, count(*) AS copies FROM items q JOIN inv v ON lower(q.name) = lower(v.name) GROUP BY q.set_name, q.name")
def find_by_exact_name(t: Tables) -> DataFrame:
    return search.exact(t.copies, t.items.select("set_name", "name"), "name").groupBy("set_name", "name").agg(F.count("*").alias("copies"))


@query("SELECT inv_id, size FROM inv WHERE size BETWEEN 1000 AND 20000 ORDER BY size, inv_id")
def find_by_size_range(t: Tables) -> DataFrame:
    return search.by_size(t.copies, 1000, 20000).select("inv_id", "size")


@query("SELECT inv_id, size FROM inv WHERE size >= 1000000 ORDER BY size, inv_id")
def find_by_least_size(t: Tables) -> DataFrame:
    return search.by_size(t.copies, least=1_000_000).select("inv_id", "size")


@query("SELECT DISTINCT i.set_name, q.set_name AS asked_for FROM items i JOIN (SELECT DISTINCT set_name, crc32 FROM items WHERE crc32 IS NOT NULL AND crc32 LIKE '%00') q ON i.crc32 = q.crc32")
def find_games_by_crc(t: Tables) -> DataFrame:
    """The sets that hold any content of another set, for all contents whose checksum ends in 00."""
    asked = t.items.where(F.col("crc32").endswith("00")).select(F.col("set_name").alias("asked_for"), F.col("crc32").alias("query")).distinct()
    return search.games_by_crc(t.items, asked).select("set_name", "asked_for")


@query("SELECT clone_of AS asked_for, set_name FROM sets WHERE clone_of IS NOT NULL")
def clones_of(t: Tables) -> DataFrame:
    return search.clones_of(t.sets, t.sets.select(F.col("set_name").alias("p"))).unionByName(search.clones_of_absent(t.sets))


@query("SELECT coalesce(crc32, 'unknown') AS key, count(*) AS copies, min(name) AS name FROM inv WHERE name ILIKE '%ba%' GROUP BY 1 ORDER BY name, key")
def search_grouped(t: Tables) -> DataFrame:
    return search.grouped(search.by_name(t.copies, "%ba%"))


@query("SELECT set_name, description FROM sets WHERE contains(lower(description), 'quest')")
def search_description(t: Tables) -> DataFrame:
    return t.sets.where(F.contains(F.lower("description"), F.lit("quest"))).select("set_name", "description")


@query("SELECT DISTINCT set_name FROM items WHERE crc32 IN (SELECT crc32 FROM items GROUP BY crc32 HAVING count(DISTINCT set_name) > 2)")
def sets_sharing_crc(t: Tables) -> DataFrame:
    shared = t.items.where("crc32 IS NOT NULL").groupBy("crc32").agg(F.count_distinct("set_name").alias("n")).where("n > 2").select("crc32")
    return t.items.join(shared, "crc32", "left_semi").select("set_name").distinct()


@query("SELECT set_name, clone_of IS NULL AS is_parent FROM sets")
def parents_and_clones(t: Tables) -> DataFrame:
    return t.sets.select("set_name", F.col("clone_of").isNull().alias("is_parent"))


@query("SELECT set_name FROM sets WHERE runnable AND set_name NOT IN (SELECT set_name FROM items WHERE status IN ('baddump', 'nodump'))")
def working_good_sets(t: Tables) -> DataFrame:
    return t.sets.where("runnable").join(t.items.where(F.col("status").isin("baddump", "nodump")), "set_name", "left_anti").select("set_name")


@query("SELECT inv_id FROM inv WHERE source_path <> '/mnt/vault/roms2'")
def without_output_dir(t: Tables) -> DataFrame:
    return t.copies.where("source_path <> '/mnt/vault/roms2'").select("inv_id")


@query("SELECT set_name FROM sets WHERE clone_of IS NULL AND NOT contains(lower(set_name), 'bios') AND NOT starts_with(set_name, 'device_') AND NOT is_bios AND NOT is_device")
def fixdat_sets(t: Tables) -> DataFrame:
    return t.sets.where("clone_of IS NULL AND NOT contains(lower(set_name), 'bios') AND NOT startswith(set_name, 'device_') AND NOT is_bios AND NOT is_device").select("set_name")


@query("SELECT set_name, CASE WHEN is_bios THEN 'bios' ELSE 'device' END AS kind FROM sets WHERE is_bios OR is_device")
def bios_and_devices(t: Tables) -> DataFrame:
    return t.sets.where("is_bios OR is_device").select("set_name", F.when(F.col("is_bios"), "bios").otherwise("device").alias("kind"))


@query("SELECT name, CASE WHEN regexp_matches(name, '^[0-9A-Fa-f]{8}$') THEN 'crc32' ELSE 'name' END AS kind FROM (SELECT DISTINCT name FROM inv)")
def query_kinds(t: Tables) -> DataFrame:
    return t.copies.select("name").distinct().withColumn("kind", names.query_kind(F.col("name")))


@query("SELECT path, last_scan, rom_count, total_size FROM scan_sources ORDER BY path", base=False)
def list_sources(t: Tables) -> DataFrame:
    return t.sources.select("path", "last_scan", "rom_count", "total_size").orderBy("path")


# ---- duplicates and index -------------------------------------------------------------------------------------------


@query("SELECT count(*) AS roms, coalesce(sum(size), 0)::BIGINT AS total_size, count(DISTINCT crc32) AS unique_crc, (SELECT count(*) FROM (SELECT crc32 FROM inv WHERE crc32 IS NOT NULL GROUP BY crc32 HAVING count(*) > 1)) AS duplicate_groups, (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM inv WHERE crc32 IS NOT NULL GROUP BY crc32)) AS extra_copies FROM inv")
def index_totals(t: Tables) -> DataFrame:
    groups = t.copies.where("crc32 IS NOT NULL").groupBy("crc32").agg(F.count("*").alias("n"))
    g = groups.agg(F.count("*").alias("unique_crc"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("extra_copies"))
    return t.copies.agg(F.count("*").alias("roms"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size")).join(g, F.lit(True))


@query("SELECT crc32, size, count(*) AS copies, min(location_path) AS first_path FROM inv WHERE crc32 IS NOT NULL GROUP BY crc32, size HAVING count(*) > 1")
def dup_groups(t: Tables) -> DataFrame:
    return t.copies.where("crc32 IS NOT NULL").groupBy("crc32", "size").agg(F.count("*").alias("copies"), F.min("location_path").alias("first_path")).where("copies > 1")


@query("SELECT crc32, count(*) AS copies FROM inv WHERE crc32 IS NOT NULL GROUP BY crc32 HAVING count(*) >= 3 ORDER BY copies DESC, crc32 LIMIT 10")
def top_duplicates(t: Tables) -> DataFrame:
    return t.copies.where("crc32 IS NOT NULL").groupBy("crc32").agg(F.count("*").alias("copies")).where("copies >= 3").orderBy(F.desc("copies"), "crc32").limit(10)


@query("""
, f AS (SELECT crc32, size, n FROM (SELECT crc32, size, count(*) OVER (PARTITION BY crc32) AS n, row_number() OVER (PARTITION BY crc32 ORDER BY ar, last_modified DESC NULLS LAST, location_path, coalesce(location_entry, ''), inv_id) AS r FROM inv WHERE crc32 IS NOT NULL) WHERE r = 1)
SELECT count(*) FILTER (n > 1) AS groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT - count(*) FILTER (n > 1) AS total_duplicates, coalesce(sum(size * (n - 1)), 0)::BIGINT AS space_wasted FROM f""")
def index_analysis(t: Tables) -> DataFrame:
    age = F.coalesce(-F.col("last_modified"), F.lit(2**62))
    first = F.struct(audit.kind_rank(audit.ARCHIVE_FIRST).alias("k"), age.alias("a"), "location_path", F.coalesce("location_entry", F.lit("")).alias("e"), "inv_id", "size")
    g = t.copies.where("crc32 IS NOT NULL").groupBy("crc32").agg(F.count("*").alias("n"), F.min(first).alias("m")).select("n", "m.size")
    many = F.col("n") > 1
    return g.agg(F.count_if(many).alias("groups"), (F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)) - F.count_if(many)).alias("total_duplicates"), F.coalesce(F.sum(F.expr("size * (n - 1)")), F.lit(0)).alias("space_wasted"))


@query("SELECT n, extra * 1.0 / n > 0.3 AS many_duplicates, hot AS groups_over_five, n > 100000 AS large FROM (SELECT count(*) AS n FROM inv), (SELECT coalesce(sum(k - 1), 0) AS extra, count(*) FILTER (k > 5) AS hot FROM (SELECT count(*) AS k FROM inv WHERE crc32 IS NOT NULL GROUP BY crc32))")
def recommendations(t: Tables) -> DataFrame:
    g = t.copies.where("crc32 IS NOT NULL").groupBy("crc32").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("extra"), F.count_if(F.col("k") > 5).alias("groups_over_five"))
    one = t.copies.agg(F.count("*").alias("n")).join(g, F.lit(True))
    return one.select("n", (F.col("extra") / F.col("n") > 0.3).alias("many_duplicates"), "groups_over_five", (F.col("n") > 100000).alias("large"))


@query("SELECT s.path, coalesce(i.n, 0) AS rom_count, coalesce(i.size, 0) AS total_size, coalesce(i.archives, 0) AS archives, s.rom_count <> coalesce(i.n, 0) AS stale FROM scan_sources s LEFT JOIN (SELECT source_path, count(*) AS n, sum(size)::BIGINT AS size, count(*) FILTER (location_type = 'archive') AS archives FROM inv GROUP BY source_path) i ON s.path = i.source_path")
def source_rollup(t: Tables) -> DataFrame:
    i = t.copies.groupBy("source_path").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.count_if(F.col("location_type") == "archive").alias("a"))
    n = F.coalesce("n", F.lit(0))
    return t.sources.join(i, F.col("path") == F.col("source_path"), "left").select("path", n.alias("rom_count"), F.coalesce("size", F.lit(0)).alias("total_size"), F.coalesce("a", F.lit(0)).alias("archives"), (F.col("rom_count") != n).alias("stale"))


@query("SELECT source_path, count(DISTINCT crc32) AS groups FROM inv WHERE crc32 IN (SELECT crc32 FROM inv GROUP BY crc32 HAVING count(*) > 1) GROUP BY source_path")
def source_duplicates(t: Tables) -> DataFrame:
    # one row per (crc32, source) leaves the first aggregate, so a hot crc32 is at most as many rows as there are sources
    per = t.copies.where("crc32 IS NOT NULL").groupBy("crc32", "source_path").agg(F.count("*").alias("n"))
    many = per.groupBy("crc32").agg(F.sum("n").alias("all")).where("all > 1").select("crc32")
    return per.join(many, "crc32", "left_semi").groupBy("source_path").agg(F.count("*").alias("groups"))


@query("SELECT location_type, count(*) AS n, sum(size)::BIGINT AS size FROM inv GROUP BY location_type")
def scan_summary(t: Tables) -> DataFrame:
    return t.copies.groupBy("location_type").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


_BEST = "SELECT {keys}, inv_id, location_type, location_path, copies FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS copies, row_number() OVER (PARTITION BY {keys} " + _RANK + ") AS r FROM inv WHERE {where}) WHERE r = 1"


@query(_BEST.format(keys="crc32", order="lr", where="crc32 IS NOT NULL"))
def best_source_local_first(t: Tables) -> DataFrame:
    return audit.best_copy(t.copies, ["crc32"])


@query(_BEST.format(keys="crc32", order="ar", where="crc32 IS NOT NULL"))
def best_source_archive_first(t: Tables) -> DataFrame:
    return audit.best_copy(t.copies, ["crc32"], audit.ARCHIVE_FIRST)


@query(_BEST.format(keys="crc32, size", order="CASE WHEN contains(location_path, '/mnt/vault') THEN 0 WHEN contains(location_path, '/data/') THEN 1 ELSE 2 END, ar", where="crc32 IS NOT NULL AND size IS NOT NULL"))
def best_source_preferred(t: Tables) -> DataFrame:
    return audit.best_copy(t.copies, ["crc32", "size"], audit.ARCHIVE_FIRST, ("/mnt/vault", "/data/"))


@query(
    ", bc AS (" + _BEST.format(keys="crc32", order="lr", where="crc32 IS NOT NULL") + "), nm AS (SELECT *, lower(name) AS lname FROM inv), bn AS (" + _BEST.format(keys="lname, size", order="lr", where="lname IS NOT NULL AND size IS NOT NULL").replace("FROM inv ", "FROM nm ") + """)
SELECT i.set_name, i.name, i.size, i.crc32, i.status, CASE WHEN bc.inv_id IS NOT NULL THEN 'crc32' WHEN bn.inv_id IS NOT NULL THEN 'name_size' END AS matched_by, coalesce(bc.inv_id, bn.inv_id) AS inv_id
FROM items i LEFT JOIN bc ON i.crc32 = bc.crc32 LEFT JOIN bn ON lower(i.name) = bn.lname AND i.size = bn.size"""
)
def match_best(t: Tables) -> DataFrame:
    return audit.match_items(t.items, t.copies)


@query("SELECT i.set_name, i.name, count(v.inv_id) AS copies FROM items i LEFT JOIN inv v ON i.crc32 = v.crc32 AND i.size = v.size GROUP BY i.set_name, i.name")
def match_composite(t: Tables) -> DataFrame:
    counts = t.copies.where("crc32 IS NOT NULL").groupBy("crc32", "size").agg(F.count("*").alias("n"))
    return t.items.join(counts, ["crc32", "size"], "left").groupBy("set_name", "name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("copies"))


@query("SELECT set_name, name, count(*) AS sources FROM (SELECT i.set_name, i.name, v.location_path, coalesce(v.location_entry, '') FROM items i JOIN inv v ON i.crc32 = v.crc32 UNION SELECT i.set_name, i.name, v.location_path, coalesce(v.location_entry, '') FROM items i JOIN inv v ON lower(i.name) = lower(v.name) AND i.size = v.size) GROUP BY set_name, name")
def all_sources(t: Tables) -> DataFrame:
    return reports.source_counts(t.items, t.copies)


_STEM = "trim(lower(regexp_replace(regexp_extract(location_path, '[^/]*$'), '(.)\\.[^.]*$', '\\1')))"


@query(f"SELECT location_path, s.set_name, s.set_name IS NULL AS unrecognized FROM (SELECT DISTINCT location_path FROM inv WHERE location_type = 'archive') a LEFT JOIN sets s ON {_STEM} = lower(s.set_name)")
def archives_of_sets(t: Tables) -> DataFrame:
    a = t.copies.where("location_type = 'archive'").select("location_path").distinct().withColumn("key", F.trim(F.lower(names.stem(F.col("location_path")))))
    return a.join(t.sets.select("set_name", F.lower("set_name").alias("key")), "key", "left").select("location_path", "set_name", F.col("set_name").isNull().alias("unrecognized"))


@query(f"SELECT i.set_name, i.name, count(a.name) > 0 AS present FROM items i LEFT JOIN (SELECT DISTINCT {_STEM} AS stem, coalesce(location_entry, name) AS name FROM inv WHERE location_type = 'archive') a ON lower(i.set_name) = a.stem AND i.name = a.name GROUP BY i.set_name, i.name")
def entries_of_items(t: Tables) -> DataFrame:
    a = t.copies.where("location_type = 'archive'").select(F.trim(F.lower(names.stem(F.col("location_path")))).alias("stem"), F.coalesce("location_entry", "name").alias("name")).distinct().withColumn("hit", F.lit(1))
    i = t.items.withColumn("stem", F.lower("set_name")).join(a, ["stem", "name"], "left")
    return i.groupBy("set_name", "name").agg((F.count("hit") > 0).alias("present"))


@query("SELECT count(*) AS total, count(DISTINCT (crc32, size)) AS unique_keys, count(*) - count(DISTINCT (crc32, size)) AS duplicates, (SELECT sum(size)::BIGINT FROM (SELECT DISTINCT crc32, size FROM inv WHERE crc32 IS NOT NULL AND size IS NOT NULL)) AS unique_size FROM inv WHERE crc32 IS NOT NULL AND size IS NOT NULL")
def consolidate_stats(t: Tables) -> DataFrame:
    g = t.copies.where("crc32 IS NOT NULL AND size IS NOT NULL").groupBy("crc32", "size").agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("total"), F.count("*").alias("unique_keys"), (F.sum("n") - F.count("*")).alias("duplicates"), F.sum("size").alias("unique_size"))


@query("SELECT lower(name) AS name, count(*) AS contents FROM (SELECT DISTINCT name, crc32, size FROM (" + _BEST.format(keys="crc32, size", order="ar", where="crc32 IS NOT NULL AND size IS NOT NULL").replace("SELECT crc32, size, inv_id", "SELECT name, crc32, size, inv_id") + ")) GROUP BY lower(name) HAVING count(*) > 1")
def consolidate_collisions(t: Tables) -> DataFrame:
    best = audit.best_copy(t.copies, ["crc32", "size"], audit.ARCHIVE_FIRST).select("inv_id")
    return t.copies.join(best, "inv_id", "left_semi").groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("contents")).where("contents > 1")


@query("SELECT crc32, inv_id, r FROM (SELECT crc32, inv_id, row_number() OVER (PARTITION BY crc32 ORDER BY location_path, coalesce(location_entry, ''), inv_id) AS r FROM inv WHERE crc32 IS NOT NULL) WHERE r <= 3")
def first_locations(t: Tables) -> DataFrame:
    w = Window.partitionBy("crc32").orderBy("location_path", F.coalesce("location_entry", F.lit("")), "inv_id")
    return t.copies.where("crc32 IS NOT NULL").select("crc32", "inv_id", F.row_number().over(w).alias("r")).where("r <= 3")


# ---- relations ------------------------------------------------------------------------------------------------------


@query("SELECT parent, string_agg(c, ',' ORDER BY c) AS clones, count(*) AS n FROM (SELECT DISTINCT clone_of AS parent, set_name AS c FROM sets WHERE clone_of IN (SELECT set_name FROM sets)) GROUP BY parent")
def parent_clone_groups(t: Tables) -> DataFrame:
    return audit.parent_clone_groups(t.sets)


@query("SELECT set_name, clone_of AS alternative FROM sets WHERE clone_of IN (SELECT set_name FROM sets) UNION ALL SELECT a.set_name, b.set_name FROM sets a JOIN sets b ON a.clone_of = b.clone_of AND a.set_name <> b.set_name")
def alternatives(t: Tables) -> DataFrame:
    return audit.alternatives(t.sets)


@query("SELECT src, dst, kind FROM edges")
def dependency_edges(t: Tables) -> DataFrame:
    return graph.edges(t.sets)


@query("SELECT root, node, depth FROM clos")
def dependency_closure(t: Tables) -> DataFrame:
    return graph.closure(graph.edges(t.sets))


@query("SELECT dst, count(DISTINCT src) AS dependents FROM edges GROUP BY dst")
def dependents(t: Tables) -> DataFrame:
    return graph.edges(t.sets).groupBy("dst").agg(F.count_distinct("src").alias("dependents"))


@query("SELECT d.root, i.name, d.source, CASE WHEN d.own THEN 'Game' WHEN s.is_bios THEN 'BIOS' WHEN s.is_device THEN 'Device' ELSE 'Parent' END AS category FROM (SELECT set_name AS root, set_name AS source, true AS own FROM sets UNION ALL SELECT root, node, false FROM clos) d JOIN sets s ON d.source = s.set_name JOIN items i ON i.set_name = d.source")
def required_items(t: Tables) -> DataFrame:
    return graph.required_items(t.sets, t.items)


@query("SELECT set_name AS archive, name, size, crc32 FROM items WHERE merge IS NULL")
def split_plan(t: Tables) -> DataFrame:
    return rebuild.split_plan(t.items)


@query("SELECT DISTINCT coalesce(s.clone_of, s.set_name) AS archive, coalesce(i.merge, i.name) AS name, i.size, i.crc32 FROM items i JOIN sets s ON i.set_name = s.set_name")
def merged_plan(t: Tables) -> DataFrame:
    return rebuild.merged_plan(t.sets, t.items)


@query("SELECT d.root AS archive, i.name, d.source FROM (SELECT set_name AS root, set_name AS source FROM sets UNION ALL SELECT root, node FROM clos) d JOIN items i ON i.set_name = d.source JOIN sets s ON s.set_name = d.source")
def nonmerged_plan(t: Tables) -> DataFrame:
    return rebuild.non_merged_plan(t.sets, t.items)


@query("SELECT st.set_name, CASE WHEN NOT s.runnable THEN 'not_working' WHEN s.set_name IN (SELECT set_name FROM items WHERE status IN ('baddump', 'nodump')) THEN 'bad_dumps' WHEN st.status = 'complete' THEN 'rebuild' WHEN found = 0 THEN 'missing' ELSE 'incomplete' END AS decision FROM st JOIN sets s ON st.set_name = s.set_name")
def rebuild_decisions(t: Tables) -> DataFrame:
    return rebuild.decisions(t.status(), t.sets, t.items)


@query("SELECT decision, count(*) AS sets FROM (SELECT CASE WHEN NOT s.runnable THEN 'not_working' WHEN s.set_name IN (SELECT set_name FROM items WHERE status IN ('baddump', 'nodump')) THEN 'bad_dumps' WHEN found > 0 THEN 'rebuild' ELSE 'missing' END AS decision FROM st JOIN sets s ON st.set_name = s.set_name) GROUP BY decision")
def rebuild_requirements(t: Tables) -> DataFrame:
    return rebuild.decisions(t.status(), t.sets, t.items, allow_incomplete=True).groupBy("decision").agg(F.count("*").alias("sets"))


# ---- scalar functions -----------------------------------------------------------------------------------------------


@query(r"""SELECT set_name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(description, '\s*\([^)]+\)', '', 'g'), '\s*\[[^\]]+\]', '', 'g'), '\s+(v|V|rev|Rev|REV)\s*[\d.]+[a-zA-Z]?', '', 'g'), '\s+\(?Proto\)?', '', 'gi'), '\s+\(?Beta\)?', '', 'gi'), '\s+\(?Demo\)?', '', 'gi'), '\s+\(?Sample\)?', '', 'gi'), '\s+\(?Alt\)?', '', 'gi'), '\s+\(?Hack\)?', '', 'gi')) AS title FROM sets""")
def clean_titles(t: Tables) -> DataFrame:
    return t.sets.select("set_name", names.clean_title(F.col("description")).alias("title"))


@query("SELECT set_name, regexp_replace(coalesce(manufacturer, 'Unknown'), '[/\\\\?%*|\"<>:]', '_', 'g') AS by_manufacturer, coalesce(year, 'Unknown') AS by_year, CASE WHEN regexp_matches(upper(set_name[1]), '^[A-Z]$') THEN upper(set_name[1]) ELSE '#' END AS by_letter, CASE WHEN clone_of IS NULL THEN 'Parents' ELSE 'Clones' END AS by_kind FROM sets")
def folders(t: Tables) -> DataFrame:
    return t.sets.select("set_name", names.folder_for("manufacturer").alias("by_manufacturer"), names.folder_for("year").alias("by_year"), names.folder_for("alphabet").alias("by_letter"), names.folder_for("parent_clone").alias("by_kind"))


@query("SELECT inv_id, CASE WHEN size < 1024 THEN printf('%.2f B', size / 1.0) WHEN size < 1048576 THEN printf('%.2f KB', size / 1024.0) WHEN size < 1073741824 THEN printf('%.2f MB', size / 1048576.0) ELSE printf('%.2f GB', size / 1073741824.0) END AS text FROM inv")
def formatted_sizes(t: Tables) -> DataFrame:
    return t.copies.select("inv_id", names.format_bytes(F.col("size")).alias("text"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents", base=False)
def content_hashes(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", checksums.all_hashes("text").alias("h")).select("doc_id", "h.md5", "h.sha1", "h.sha256")


@query("SELECT inv_id, CASE WHEN location_type = 'archive' AND location_entry IS NOT NULL THEN location_path || '#' || location_entry ELSE location_path END AS place, lower(regexp_extract(regexp_extract(name, '[^/]*$'), '\\.([^.]+)$', 1)) AS ext FROM inv")
def places(t: Tables) -> DataFrame:
    return t.copies.select("inv_id", names.display_location(F.col("location_type"), F.col("location_path"), F.col("location_entry")).alias("place"), names.extension(F.col("name")).alias("ext"))


@query("SELECT set_name, replace(replace(replace(replace(replace(description, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml FROM sets")
def escaped(t: Tables) -> DataFrame:
    return t.sets.select("set_name", names.escape_xml(F.col("description")).alias("xml"))


@query("SELECT i.inv_id, (i.crc32 = m.crc32) AS crc_ok, (i.sha1 IS NULL OR m.sha1 IS NULL OR i.sha1 = m.sha1) AS sha_ok, i.size = m.size AS size_ok FROM inv i JOIN (SELECT lower(name) AS lname, min(crc32) AS crc32, min(sha1) AS sha1, min(size) AS size FROM items WHERE crc32 IS NOT NULL GROUP BY 1 HAVING count(*) = 1) m ON lower(i.name) = m.lname")
def validation(t: Tables) -> DataFrame:
    one = t.items.where("crc32 IS NOT NULL").groupBy(F.lower("name").alias("lname")).agg(F.min("crc32").alias("c"), F.min("sha1").alias("s"), F.min("size").alias("z"), F.count("*").alias("n")).where("n = 1")
    i = t.copies.withColumn("lname", F.lower("name")).join(one, "lname")
    return i.select("inv_id", (F.col("crc32") == F.col("c")).alias("crc_ok"), (F.col("sha1").isNull() | F.col("s").isNull() | (F.col("sha1") == F.col("s"))).alias("sha_ok"), (F.col("size") == F.col("z")).alias("size_ok"))


@query("SELECT i.inv_id, m.set_name, m.name, i.size IS NOT DISTINCT FROM m.size AND (m.crc32 IS NULL OR i.crc32 IS NOT DISTINCT FROM m.crc32) AND (m.sha1 IS NULL OR i.sha1 IS NOT DISTINCT FROM m.sha1) AND (m.md5 IS NULL OR i.md5 IS NOT DISTINCT FROM m.md5) AS matches FROM inv i JOIN items m ON lower(i.name) = lower(m.name)")
def hash_matches(t: Tables) -> DataFrame:
    return audit.hash_matches(t.copies, t.items)


@query("SELECT i.inv_id, m.set_name, array_to_string(list_filter([CASE WHEN i.size IS DISTINCT FROM m.size THEN 'size' END, CASE WHEN m.crc32 IS NOT NULL AND i.crc32 IS DISTINCT FROM m.crc32 THEN 'crc32' END, CASE WHEN m.sha1 IS NOT NULL AND i.sha1 IS DISTINCT FROM m.sha1 THEN 'sha1' END], lambda x: x IS NOT NULL), ',') AS errors FROM inv i JOIN items m ON lower(i.name) = lower(m.name)")
def validation_errors(t: Tables) -> DataFrame:
    return audit.validation_errors(t.copies, t.items)


@query("SELECT *, coalesce(crc_ok AND sha_ok, false) AS valid FROM (SELECT i.inv_id, m.crc32, m.sha1, m.size, CASE WHEN m.crc32 IS NULL THEN false ELSE i.crc32 = m.crc32 END AS crc_ok, (i.sha1 IS NULL OR m.sha1 IS NULL OR i.sha1 = m.sha1) AS sha_ok, i.size = m.size AS size_ok FROM inv i JOIN (SELECT DISTINCT lower(name) AS lname, crc32, sha1, size FROM items) m ON lower(i.name) = m.lname)")
def validation_all(t: Tables) -> DataFrame:
    """Every copy against every content expected under its name; `validation` asks only names of one item, as its SQL does."""
    return audit.validate(t.items, t.copies)


# ---- set operations -------------------------------------------------------------------------------------------------


@query("SELECT name FROM items INTERSECT SELECT name FROM inv")
def names_in_both(t: Tables) -> DataFrame:
    return t.items.select("name").intersect(t.copies.select("name"))


@query("SELECT name FROM items EXCEPT SELECT name FROM inv")
def names_not_held(t: Tables) -> DataFrame:
    return t.items.select("name").subtract(t.copies.select("name"))


@query("SELECT set_name FROM st WHERE status = 'incomplete' UNION SELECT set_name FROM st WHERE status = 'missing'")
def names_to_rebuild(t: Tables) -> DataFrame:
    st = t.status()
    return st.where("status = 'incomplete'").select("set_name").union(st.where("status = 'missing'").select("set_name")).distinct()


# ---- sinks and streams ----------------------------------------------------------------------------------------------

_X = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query("SELECT i.set_name, '  <game name=\"' || " + _X.format("i.set_name") + " || '\"' || coalesce(' cloneof=\"' || " + _X.format("s.clone_of") + " || '\"', '') || '>' || chr(10) || '    <description>' || " + _X.format("s.description") + " || '</description>' || chr(10) || string_agg('    <rom name=\"' || " + _X.format("name") + " || '\" size=\"' || size || '\"' || coalesce(' crc=\"' || crc32 || '\"', '') || coalesce(' sha1=\"' || sha1 || '\"', '') || ' status=\"' || status || '\"/>', chr(10) ORDER BY name, size) || chr(10) || '  </game>' AS xml FROM found i JOIN sets s ON i.set_name = s.set_name WHERE NOT have GROUP BY i.set_name, s.clone_of, s.description")
def fixdat(t: Tables) -> DataFrame:
    return documents.fixdat_games(t.sets, t.found.where("NOT have"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL", base=False)
def event_progress(t: Tables) -> DataFrame:
    return progress.progress(t.raw("events"))
