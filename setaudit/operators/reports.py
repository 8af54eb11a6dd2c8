"""What reports are made of: audit counts and lists, missing items, issues, plans to rebuild, rename and consolidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setaudit.functions import names
from setaudit.operators import audit

#: Orders of a missing report, each a total one.
SORTS = {
    "name": lambda: [F.col("set_name").asc()],
    "year": lambda: [F.col("year").asc_nulls_last(), F.col("set_name").asc()],
    "manufacturer": lambda: [F.col("manufacturer").asc_nulls_last(), F.col("set_name").asc()],
    "missing_count": lambda: [F.col("missing").desc(), F.col("set_name").asc()],
}
SEVERITIES = ("critical", "warning", "info")


def category() -> Column:
    """BIOS, Device, Clone or Parent."""
    return F.when(F.col("is_bios"), "BIOS").when(F.col("is_device"), "Device").when(F.col("clone_of").isNotNull(), "Clone").otherwise("Parent")


def audit_counts(status: DataFrame) -> DataFrame:
    """(status, sets, found_items, missing_items, total_items, percent) of a status table; percent is 0 where there are no items."""
    per = status.groupBy("status").agg(F.count("*").alias("sets"), F.sum("found").alias("found_items"), F.sum(F.col("required") - F.col("found")).alias("missing_items"), F.sum("required").alias("total_items"))
    return per.withColumn("percent", names.percent(F.col("found_items"), F.col("total_items")))


def audit_details(status: DataFrame, found: DataFrame) -> DataFrame:
    """(set_name, status, missing, bad): the names of missing items and of bad dumps among those found, in order, joined by
    commas; a set's items are few. Lists are empty for complete sets without bad dumps."""
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("name")))), ",")
    per = found.groupBy("set_name").agg(joined(~F.col("have")).alias("missing"), joined(F.col("have") & (F.col("status") == "baddump")).alias("bad"))
    return status.select("set_name", "status").join(per, "set_name", "left").na.fill("", ["missing", "bad"])


def first_of_each(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each value of a column, with their `place`."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


def missing_report(sets: DataFrame, found: DataFrame, sort: str = "name", include: tuple[str, ...] = ("BIOS", "Device", "Clone", "Parent")) -> DataFrame:
    """(set_name, description, year, manufacturer, category, required, missing, missing_size, alternatives), sorted: sets that lack
    items, of the categories asked for. `alternatives` counts the other sets of the same family that lack nothing."""
    family = sets.withColumn("family", F.coalesce("clone_of", "set_name")).withColumn("category", category())
    per = found.groupBy("set_name").agg(F.count("*").alias("required"), F.count_if(~F.col("have")).alias("missing"), F.coalesce(F.sum(F.when(~F.col("have"), F.col("size"))), F.lit(0)).alias("missing_size"))
    whole = family.join(per.where("missing = 0"), "set_name", "left_semi").groupBy("family").agg(F.count("*").alias("alternatives"))
    rows = family.where(F.col("category").isin(*include)).join(per.where("missing > 0"), "set_name").join(whole, "family", "left")
    return rows.select("set_name", "description", "year", "manufacturer", "category", "required", "missing", "missing_size", F.coalesce("alternatives", F.lit(0)).alias("alternatives")).orderBy(*SORTS[sort]())


def issues(status: DataFrame, sets: DataFrame) -> DataFrame:
    """(severity, set_name, issue): a BIOS that is not complete is critical, a complete clone of a parent with nothing found a
    warning, a set that does not run an information."""
    held = status.where("found > 0").select(F.col("set_name").alias("clone_of"), F.lit(True).alias("held"))
    all_ = sets.join(status, "set_name").join(held, "clone_of", "left")
    cases = [
        (F.col("is_bios") & (F.col("status") != "complete"), "critical", "incomplete BIOS"),
        (F.col("clone_of").isNotNull() & (F.col("status") == "complete") & F.col("held").isNull(), "warning", "clone without parent"),
        (~F.col("runnable"), "info", "does not run"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(i).alias("issue"))) for c, s, i in cases)))
    return all_.select("set_name", F.explode(found).alias("i")).select("i.severity", "set_name", "i.issue")


def output_complete(items: DataFrame, copies: DataFrame) -> DataFrame:
    """(set_name, complete): sets of which an archive of their name exists, and whether it has entries of all required names."""
    entries = audit.archive_entries(copies)
    want = items.select("set_name", F.lower("set_name").alias("stem"), F.col("name").alias("entry")).distinct()
    seen = want.join(entries.select("stem").distinct(), "stem", "left_semi").join(entries.select("stem", "entry", F.lit(1).alias("hit")), ["stem", "entry"], "left")
    return seen.groupBy("set_name").agg((F.count("hit") == F.count("*")).alias("complete"))


def rebuild_counts(decisions: DataFrame, found: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(decision, sets, items, available, missing_items): what a rebuild would do and need; with `existing` (set_name, complete)
    sets whose output is complete already are skipped as up_to_date."""
    per = found.groupBy("set_name").agg(F.count("*").alias("items"), F.count_if("have").alias("available"))
    d = decisions
    if existing is not None:
        d = d.join(existing, "set_name", "left").withColumn("decision", F.when((F.col("decision") == "rebuild") & F.col("complete"), "up_to_date").otherwise(F.col("decision")))
    both = d.join(per, "set_name", "left").na.fill(0, ["items", "available"])
    return both.groupBy("decision").agg(F.count("*").alias("sets"), F.sum("items").alias("items"), F.sum("available").alias("available"), F.sum(F.col("items") - F.col("available")).alias("missing_items"))


def rebuild_results(counts: DataFrame) -> DataFrame:
    """(rebuilt, skipped, failed, items, success): counters of a run over all sets; a set with nothing to build from failed."""
    of = lambda *d: F.coalesce(F.sum(F.when(F.col("decision").isin(*d), F.col("sets"))), F.lit(0))
    built = of("rebuild")
    failed = of("missing")
    one = counts.agg(built.alias("rebuilt"), (F.coalesce(F.sum("sets"), F.lit(0)) - built - failed).alias("skipped"), failed.alias("failed"), F.coalesce(F.sum(F.when(F.col("decision") == "rebuild", F.col("available"))), F.lit(0)).alias("items"))
    return one.withColumn("success", names.percent(F.col("rebuilt"), F.col("rebuilt") + F.col("failed")))


def rebuild_sources(decisions: DataFrame, items: DataFrame, copies: DataFrame) -> DataFrame:
    """(archive, name, inv_id, location_type, location_path, location_entry): for each set to rebuild, the best copy of each item:
    what `sinks.archives.build` is fed with once contents are read."""
    matched = audit.match_items(items, copies).where("inv_id IS NOT NULL")
    wanted = matched.join(decisions.where("decision = 'rebuild'").select("set_name"), "set_name", "left_semi")
    return wanted.select(F.col("set_name").alias("archive"), "name", "inv_id").distinct().join(copies.select("inv_id", "location_type", "location_path", "location_entry"), "inv_id").select("archive", "name", "inv_id", "location_type", "location_path", "location_entry")


def clean_names_plan(copies: DataFrame) -> DataFrame:
    """(source, target, action) for loose files: cleaned titles in the same folder. keep where nothing changes, skip where the
    target exists or an earlier path claims it, else rename."""
    path = F.col("location_path")
    loose = copies.where("location_type = 'file'").select(path.alias("source")).distinct()
    folder = F.regexp_replace("source", r"[^/]*$", "")
    ext = F.regexp_extract("source", r"(?<=[^/])(\.[^./]*)$", 1)
    plan = loose.withColumn("target", F.concat(folder, names.clean_title(names.stem(F.col("source"))), ext))
    there = loose.select(F.col("source").alias("target"), F.lit(True).alias("exists"))
    turn = F.row_number().over(Window.partitionBy("target").orderBy("source"))
    action = F.when(F.col("source") == F.col("target"), "keep").when(F.col("exists") | (F.col("turn") > 1), "skip").otherwise("rename")
    return plan.withColumn("turn", turn).join(there, "target", "left").select("source", "target", action.alias("action"))


def organize_plan(sets: DataFrame, copies: DataFrame, style: str, root: str, custom: Column | None = None) -> DataFrame:
    """(source, target, action): archives named after a set, moved to the folder of a style under `root`; others are not moved."""
    a = copies.where(F.col("location_type").isin("archive", "file")).select(F.col("location_path").alias("source")).distinct()
    known = sets.withColumn("folder", names.folder_for(style, custom)).select(F.lower("set_name").alias("stem"), "folder")
    both = a.withColumn("stem", names.clean_set_name(names.stem(F.col("source")))).join(known, "stem")
    target = F.concat_ws("/", F.lit(root), F.nullif("folder", F.lit("")), names.base_name(F.col("source")))
    turn = F.row_number().over(Window.partitionBy("target").orderBy("source"))
    return both.select("source", target.alias("target")).withColumn("turn", turn).select("source", "target", F.when(F.col("source") == F.col("target"), "keep").when(F.col("turn") > 1, "skip").otherwise("move").alias("action"))


def consolidate_plan(copies: DataFrame, root: str, existing: DataFrame | None = None) -> DataFrame:
    """(inv_id, source, target, action): the best copy of each content, copied to `root` under its name. Of contents of one name
    the first copy (by id) is copied and the others are collisions; names in `existing` (name) are there already."""
    best = audit.best_copy(copies, ["crc32", "size"], audit.ARCHIVE_FIRST).select("inv_id", "location_path")
    named = best.join(copies.select("inv_id", "name"), "inv_id").withColumn("key", F.lower("name"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("inv_id"))
    plan = named.withColumn("turn", turn)
    there = F.lit(False)
    if existing is not None:
        plan = plan.join(existing.select(F.lower("name").alias("key"), F.lit(True).alias("there")).distinct(), "key", "left")
        there = F.coalesce("there", F.lit(False))
    action = F.when(there, "exists").when(F.col("turn") > 1, "collision").otherwise("copy")
    return plan.select("inv_id", F.col("location_path").alias("source"), F.concat(F.lit(root.rstrip("/") + "/"), "name").alias("target"), action.alias("action"))


def match_without_fallback(items: DataFrame, copies: DataFrame) -> DataFrame:
    """(set_name, name, size, crc32, matched_by, inv_id): an item with a checksum matches by it or not at all; one without, by
    name and size, else by name alone."""
    by_crc = audit.best_copy(copies, ["crc32"]).select("crc32", F.col("inv_id").alias("crc_id"))
    named = copies.withColumn("lname", F.lower("name"))
    by_both = audit.best_copy(named, ["lname", "size"]).select("lname", "size", F.col("inv_id").alias("both_id"))
    by_name = audit.best_copy(named, ["lname"]).select("lname", F.col("inv_id").alias("name_id"))
    all_ = items.withColumn("lname", F.lower("name")).join(by_crc, "crc32", "left").join(by_both, ["lname", "size"], "left").join(by_name, "lname", "left")
    none = F.col("crc32").isNull()
    found = F.when(~none, F.col("crc_id")).otherwise(F.coalesce("both_id", "name_id"))
    how = F.when(~none & F.col("crc_id").isNotNull(), "crc32").when(none & F.col("both_id").isNotNull(), "name_size").when(none & F.col("name_id").isNotNull(), "name")
    return all_.select("set_name", "name", "size", "crc32", how.alias("matched_by"), found.alias("inv_id"))


def source_counts(items: DataFrame, copies: DataFrame) -> DataFrame:
    """(set_name, name, sources): at how many places an item's content lies, by checksum or by name and size.

    Places are counted per checksum and per name and size, and those that match both are taken off, so copies of a hot content
    are never multiplied with the items that need it. Only items that a set lists under one name with several contents
    have their places listed.
    """
    places = copies.select("crc32", F.lower("name").alias("lname"), "size", "location_path", F.coalesce("location_entry", F.lit("")).alias("entry"))
    at = ["location_path", "entry"]
    crcs = places.where("crc32 IS NOT NULL").select("crc32", *at).distinct()
    named = places.where("lname IS NOT NULL AND size IS NOT NULL").select("lname", "size", *at).distinct()
    by_crc = crcs.groupBy("crc32").agg(F.count("*").alias("n_crc"))
    by_name = named.groupBy("lname", "size").agg(F.count("*").alias("n_name"))
    by_both = crcs.join(named, at).groupBy("crc32", "lname", "size").agg(F.count("*").alias("n_both"))
    mine = items.select("set_name", "name", F.lower("name").alias("lname"), "size", "crc32").distinct()
    contents = mine.withColumn("n", F.count("*").over(Window.partitionBy("set_name", "name")))
    one = contents.where("n = 1").join(by_crc, "crc32", "left").join(by_name, ["lname", "size"], "left").join(by_both, ["crc32", "lname", "size"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    counted = one.select("set_name", "name", (zero("n_crc") + zero("n_name") - zero("n_both")).alias("sources"))
    several = contents.where("n > 1")
    listed = several.select("set_name", "name", "crc32").join(crcs, "crc32").drop("crc32").unionByName(several.select("set_name", "name", "lname", "size").join(named, ["lname", "size"]).drop("lname", "size"))
    return counted.unionByName(listed.distinct().groupBy("set_name", "name").agg(F.count("*").alias("sources"))).where("sources > 0")
