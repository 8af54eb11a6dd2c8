"""Fixdats, exports and reports. Lines are built and ordered in Spark; a document is put together from its parts, stream by
stream, so neither a task nor the driver ever holds one."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setaudit.functions.names import bytes_in, escape_xml, health_sign


def _attribute(label: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f' {label}="'), escape_xml(value.cast("string")), F.lit('"')), F.lit(""))


def fixdat_games(sets: DataFrame, missing: DataFrame, disks: DataFrame | None = None) -> DataFrame:
    """(set_name, xml): one `game` element per set with missing items, its items in order of name, then its disks (set_name,
    name, sha1) if given."""
    items = missing.groupBy("set_name").agg(F.array_sort(F.collect_list(F.struct("name", "size", "crc32", "sha1", "status"))).alias("roms"))
    rom = F.transform("roms", lambda r: F.concat(F.lit('    <rom name="'), escape_xml(r["name"]), F.lit('" size="'), r["size"].cast("string"), F.lit('"'), _attribute("crc", r["crc32"]), _attribute("sha1", r["sha1"]), F.lit(' status="'), r["status"], F.lit('"/>')))
    lines = rom
    if disks is not None:
        per = disks.groupBy("set_name").agg(F.array_sort(F.collect_list(F.struct("name", "sha1"))).alias("disks"))
        items = items.join(per, "set_name", "full")
        disk = F.transform("disks", lambda d: F.concat(F.lit("    <disk"), _attribute("name", d["name"]), _attribute("sha1", F.lower(d["sha1"])), F.lit("/>")))
        none = F.array().cast("array<string>")
        lines = F.concat(F.coalesce(rom, none), F.coalesce(disk, none))
    of = _attribute("cloneof", F.col("clone_of"))
    head = F.concat(F.lit('  <game name="'), escape_xml(F.col("set_name")), F.lit('"'), of, F.lit(">\n    <description>"), escape_xml(F.col("description")), F.lit("</description>\n"))
    return items.join(sets, "set_name").select("set_name", F.concat(head, F.array_join(lines, "\n"), F.lit("\n  </game>")).alias("xml"))


def clrmamepro_games(sets: DataFrame, missing: DataFrame) -> DataFrame:
    """(set_name, text): one `game` block per set with missing items; this format escapes nothing."""
    items = missing.groupBy("set_name").agg(F.array_sort(F.collect_list(F.struct("name", "size", "crc32", "sha1"))).alias("roms"))
    said = lambda label, c: F.coalesce(F.concat(F.lit(f" {label} "), c), F.lit(""))
    rom = F.transform("roms", lambda r: F.concat(F.lit('\trom ( name "'), r["name"], F.lit('" size '), r["size"].cast("string"), said("crc", r["crc32"]), said("sha1", r["sha1"]), F.lit(" )")))
    return items.join(sets, "set_name").select("set_name", F.concat(F.lit('game (\n\tname "'), F.col("set_name"), F.lit('"\n\tdescription "'), F.col("description"), F.lit('"\n'), F.array_join(rom, "\n"), F.lit("\n)")).alias("text"))


def write_document(body: DataFrame, order: str, line: str, path: str, head: str, foot: str) -> None:
    """One file: head, the lines of `body` in order, foot. Executors write sorted parts beside it, which are joined by copying
    streams; the file appears under its name only when it is whole."""
    spark = body.sparkSession
    jvm = spark._jvm
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(hadoop)
    parts = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.parts")
    body.orderBy(order).select(F.col(line).alias("value")).write.text(parts.toString())
    out = fs.create(draft, True)
    try:
        out.write(bytearray(f"{head}\n".encode()))
        for part in sorted(s.getPath().getName() for s in fs.listStatus(parts)):
            if part.startswith("part-"):
                source = fs.open(jvm.org.apache.hadoop.fs.Path(parts, part))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                source.close()
        out.write(bytearray(f"{foot}\n".encode()))
    finally:
        out.close()
        fs.delete(parts, True)
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"{path} could not be put in place")


def write_fixdat(sets: DataFrame, missing: DataFrame, path: str, name: str, form: str = "logiqx", disks: DataFrame | None = None, version: str | None = None) -> None:
    """A fixdat as a valid document of either format: logiqx (XML) or clrmamepro (text), header first."""
    version = version or time.strftime("%Y%m%d")
    if form == "clrmamepro":
        head = f'clrmamepro (\n\tname "{name}"\n\tdescription "{name}"\n\tversion {version}\n)\n'
        write_document(clrmamepro_games(sets, missing), "set_name", "text", path, head, "")
        return
    if form != "logiqx":
        raise ValueError(f"unknown format {form}")
    plain = name.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<datafile>\n  <header>\n    <name>{plain}</name>\n    <description>{plain}</description>\n    <version>{version}</version>\n  </header>'
    write_document(fixdat_games(sets, missing, disks), "set_name", "xml", path, head, "</datafile>")


def export_sets(sets: DataFrame, items: DataFrame, folder: str, form: str = "csv") -> None:
    """name, description, year, manufacturer and number of items as csv (quoted), json or xml."""
    rows = sets.join(items.groupBy("set_name").agg(F.count("*").alias("roms")), "set_name", "left").na.fill(0, ["roms"]).select("set_name", "description", "year", "manufacturer", "roms")
    writer = rows.write.mode("overwrite").format(form)
    writer.options(**{"csv": {"header": "true", "quote": '"', "escape": '"'}, "json": {}, "xml": {"rootTag": "sets", "rowTag": "set"}}[form]).save(folder)


# ---- analysis as JSON


def analysis_lines(details: DataFrame) -> DataFrame:
    """(set_name, value): one JSON object a line for each set of an audit: status, set and the names it lacks."""
    names = F.when(F.col("missing") == "", F.array().cast("array<string>")).otherwise(F.split("missing", ","))
    bad = F.when(F.col("bad") == "", F.array().cast("array<string>")).otherwise(F.split("bad", ","))
    return details.select("set_name", F.to_json(F.struct(F.col("set_name").alias("set"), "status", names.alias("missing"), bad.alias("issues"))).alias("value"))


def to_rebuild(lines: DataFrame) -> DataFrame:
    """(status, set_name, missing) of the sets to rebuild, from the lines of an exported analysis: all that are not complete.
    A line that is no such object is left out."""
    v = F.from_json("value", "set string, status string, missing array<string>, issues array<string>")
    return lines.select(v.alias("v")).where("v.set IS NOT NULL AND v.status IN ('incomplete', 'broken', 'missing')").select("v.status", F.col("v.set").alias("set_name"), F.array_join("v.missing", ",").alias("missing"))


def write_analysis(details: DataFrame, folder: str) -> None:
    analysis_lines(details).select("value").write.mode("overwrite").text(folder)


def read_analysis(spark, path: str) -> DataFrame:
    """`to_rebuild` of an exported analysis."""
    return to_rebuild(spark.read.text(path))


def statistics_json(rows: DataFrame) -> str:
    """A one-row statistic as JSON with sorted keys and ISO dates."""
    iso = lambda v: v.isoformat() if hasattr(v, "isoformat") else str(v)
    return json.dumps(rows.first().asDict(), sort_keys=True, indent=2, default=iso)


# ---- reports


def bar(share: Column, cells: int = 20) -> Column:
    """A progress bar of a share between 0 and 1."""
    full = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * cells).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(cells) - full))


def text_report(title: str, overall: DataFrame, health: DataFrame | None = None) -> str:
    """One-row statistics as text, with the health and its bar if given."""
    lines = [title, "=" * len(title), *(f"{k.replace('_', ' ')}: {v}" for k, v in overall.first().asDict().items())]
    if health is not None:
        h = health.select("health", bar(F.col("health") / 100).alias("bar"), health_sign(F.col("health")).alias("sign")).first()
        lines.append(f"health: {h.health:.1f} {h.bar} {h.sign}")
    return "\n".join(lines)


def _cells(rows: DataFrame) -> Column:
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), escape_xml(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in rows.columns), F.lit("</tr>"))


def write_html(title: str, rows: DataFrame, path: str, order: str) -> None:
    """A report's rows, all of them, as a table in order of a column."""
    plain = title.replace("&", "&amp;").replace("<", "&lt;")
    head = f'<!DOCTYPE html>\n<html><head><meta charset="UTF-8"><title>{plain}</title></head><body><h1>{plain}</h1>\n<table><tr>{"".join(f"<th>{c}</th>" for c in rows.columns)}</tr>'
    write_document(rows.select(F.col(order).alias("_order"), _cells(rows).alias("_line")), "_order", "_line", path, head, "</table></body></html>")


def missing_lines(report: DataFrame, found: DataFrame) -> DataFrame:
    """(set_name, text): a missing report's sets as text, each with the items it lacks in order."""
    item = F.concat(F.lit("    - "), "name", F.lit(" ("), F.coalesce(bytes_in(F.col("size"), "file"), F.lit("?")), F.lit(")"), F.coalesce(F.concat(F.lit(" CRC "), "crc32"), F.lit("")))
    lack = found.where("NOT have").select("set_name", "name", item.alias("line")).groupBy("set_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "line"))), lambda r: r["line"]), "\n").alias("lines"))
    head = F.concat(F.lit("["), "category", F.lit("] "), "set_name", F.lit(" - "), "description", F.lit(": "), F.col("missing").cast("string"), F.lit(" of "), F.col("required").cast("string"), F.lit(" missing\n"))
    return report.join(lack, "set_name").select("set_name", F.concat(head, "lines").alias("text"))


def write_missing_text(report: DataFrame, found: DataFrame, path: str, title: str = "Missing") -> None:
    write_document(missing_lines(report, found), "set_name", "text", path, f"{title}\n", "")
