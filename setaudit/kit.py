"""One object for whole jobs, and the commands of `python -m setaudit.kit`.

Each method is a few operators in a row; whatever is large stays a DataFrame. Nothing on disk is changed unless asked for:
renaming, organising, consolidating and rebuilding give their plan, and act with `apply=True`.
"""

from __future__ import annotations

import argparse
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setaudit.operators import audit, graph, rebuild, reports, search
from setaudit.session import get_spark
from setaudit.sinks import archives, documents
from setaudit.sources import catalog, files
from setaudit.sources.index import Index

STATUS_RULES = ("direct", "index", "indexed", "generic", "strict")


def move_files(plan: DataFrame, act: str = "move") -> DataFrame:
    """(source, target, action, error): files moved where they lie, by the executors; a target that exists is left alone."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        from pyarrow import fs

        for pdf in frames:
            out = []
            for source, target in zip(pdf["source"], pdf["target"]):
                (system, inner), (_, origin) = files.located(target), files.located(source)
                try:
                    if system.get_file_info(inner).type != fs.FileType.NotFound:
                        out.append((source, target, "skipped", None))
                        continue
                    system.create_dir(os.path.dirname(inner), recursive=True)
                    system.move(origin, inner)
                    out.append((source, target, "moved", None))
                except OSError as e:
                    out.append((source, target, "failed", str(e)))
            yield pd.DataFrame(out, columns=["source", "target", "action", "error"])

    return plan.where(F.col("action").isin(act, "rename", "move")).select("source", "target").mapInPandas(each, "source string, target string, action string, error string")


class Kit:
    """A catalogue and an inventory: folders scanned now, or a stored index."""

    def __init__(self, spark: SparkSession, index: str | None = None):
        self.spark, self.index = spark, Index(spark, index) if index else None

    # ---- inputs

    def catalogue(self, path: str, form: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(sets, items) of a document."""
        read = catalog.read_sets(self.spark, path, form).withColumn("bios_set", F.lit(None).cast("string"))
        items = catalog.items(read).withColumn("crc32", F.col("crc32")).select("set_name", "name", "size", "crc32", "sha1", "md5", "status", "merge")
        return read, audit.items_of(items)

    def scan(self, folder: str, hashed: bool = True) -> DataFrame:
        return self._copies(files.inventory(self.spark, folder, hashed))

    def stored(self) -> DataFrame:
        if self.index is None:
            raise ValueError("no index is named")
        return self._copies(self.index.roms())

    @staticmethod
    def _copies(rows: DataFrame) -> DataFrame:
        place = F.xxhash64("location_path", F.coalesce("location_entry", F.lit("")))
        return audit.copies_of(rows.where("error IS NULL").withColumn("inv_id", place))

    def copies(self, folder: str | None) -> DataFrame:
        return self.scan(folder) if folder else self.stored()

    # ---- questions

    def status(self, sets: DataFrame, items: DataFrame, copies: DataFrame, rule: str = "index") -> DataFrame:
        if rule == "direct":
            return audit.set_status_direct(sets, items, copies).drop("broken")
        if rule == "indexed":
            return audit.set_status(sets, audit.match_items(items, copies).withColumn("have", F.col("matched_by").isNotNull()), rule)
        return audit.set_status(sets, audit.available(items, copies), rule)

    def analyze(self, dat: str, folder: str | None = None, rule: str = "index") -> DataFrame:
        """(set_name, status, missing, bad) of every set."""
        sets, items = self.catalogue(dat)
        copies = self.copies(folder)
        return reports.audit_details(self.status(sets, items, copies, rule), audit.available(items, copies))

    def statistics(self, dat: str, folder: str | None = None) -> DataFrame:
        sets, items = self.catalogue(dat)
        return reports.audit_counts(self.status(sets, items, self.copies(folder)))

    def missing(self, dat: str, folder: str | None = None, sort: str = "name") -> tuple[DataFrame, DataFrame]:
        """The missing report, and the items with a flag whether they are held."""
        sets, items = self.catalogue(dat)
        found = audit.available(items, self.copies(folder))
        return reports.missing_report(sets, found, sort), found

    def fixdat(self, dat: str, path: str, folder: str | None = None, form: str = "logiqx") -> None:
        sets, items = self.catalogue(dat)
        documents.write_fixdat(sets, audit.available(items, self.copies(folder)).where("NOT have"), path, "fixdat", form)

    def find(self, text: str, limit: int | None = None) -> DataFrame:
        """Copies by checksum, if the text is one, or by a pattern of the name."""
        import re

        copies = self.stored()
        found = search.by_crc(copies, text) if re.fullmatch("[0-9A-Fa-f]{8}", text) else search.by_name(copies, text if "%" in text else f"%{text}%")
        return found if limit is None else found.limit(limit)

    # ---- actions

    def rebuild(self, dat: str, out: str, folder: str | None = None, style: str = "split", allow_incomplete: bool = False, update: bool = False, apply: bool = False) -> DataFrame:
        """Archives of a style (split, merged, non_merged) from the best copies: the plan, or what was written."""
        sets, items = self.catalogue(dat)
        copies = self.copies(folder)
        decided = rebuild.decisions(self.status(sets, items, copies), sets, items, allow_incomplete=allow_incomplete)
        if update:
            there = reports.output_complete(items, self.scan(out, hashed=False)).where("complete")
            decided = decided.join(there, "set_name", "left_anti")
        if style == "split":
            wanted = items.where("merge IS NULL")
        elif style == "merged":
            wanted = rebuild.merged_plan(sets, items).withColumnRenamed("archive", "set_name").withColumn("status", F.lit("good"))
        elif style == "non_merged":
            needed = graph.required_items(sets, items).select(F.col("root").alias("set_name"), "source", "name")
            wanted = needed.join(items.select(F.col("set_name").alias("source"), "name", "size", "crc32", "status"), ["source", "name"]).drop("source").dropDuplicates(["set_name", "name"])
        else:
            raise ValueError(f"unknown style {style}")
        plan = reports.rebuild_sources(decided, wanted, copies)
        if not apply:
            return plan
        return archives.write_files(archives.build(archives.read_contents(plan).where("error IS NULL")), "archive", out, ".zip")

    def rename(self, folder: str, apply: bool = False) -> DataFrame:
        plan = reports.clean_names_plan(self.scan(folder, hashed=False))
        return move_files(plan) if apply else plan

    def organize(self, dat: str, folder: str, out: str, style: str = "alphabet", custom: Column | None = None, apply: bool = False) -> DataFrame:
        sets, _ = self.catalogue(dat)
        plan = reports.organize_plan(sets, self.scan(folder, hashed=False), style, out, custom)
        return move_files(plan) if apply else plan

    def consolidate(self, out: str, folder: str | None = None, apply: bool = False) -> DataFrame:
        copies = self.copies(folder)
        plan = reports.consolidate_plan(copies, out)
        if not apply:
            return plan
        sources = plan.where("action = 'copy'").select("inv_id").join(copies, "inv_id").select(F.lit("").alias("archive"), "name", "location_type", "location_path", "location_entry")
        return archives.write_files(archives.read_contents(sources).where("error IS NULL"), "name", out)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="setaudit")
    p.add_argument("--index", help="folder of a stored index; used where no folder is given")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in positional:
            c.add_argument(x)
        for x, kind in options.items():
            c.add_argument(f"--{x.replace('_', '-')}", **({"action": "store_true"} if kind is bool else {"default": kind}))
        return c

    command("analyze", "dat", folder=None, rule="index", out=None)
    command("scan", "folder")
    command("verify", "folder")
    command("export", "dat", "out", form="csv")
    command("rebuild", "dat", "out", folder=None, style="split", allow_incomplete=bool, update=bool, apply=bool)
    command("fixdat", "dat", "out", folder=None, form="logiqx")
    command("missing", "dat", "out", folder=None, sort="name", form="html")
    command("stats", "dat", folder=None)
    command("rename", "folder", apply=bool)
    command("organize", "dat", "folder", "out", style="alphabet", apply=bool)
    command("consolidate", "out", folder=None, apply=bool)
    c = command("index", "action", remove_stale=bool, limit=None)
    c.add_argument("value", nargs="*")
    a = p.parse_args(args)
    kit = Kit(spark or get_spark(), a.index)
    show = lambda df: df.show(50, truncate=False)
    if a.command == "analyze":
        details = kit.analyze(a.dat, a.folder, a.rule)
        show(details.groupBy("status").count())
        if a.out:
            documents.write_analysis(details, a.out)
    elif a.command == "scan":
        show(kit.scan(a.folder, hashed=False).groupBy("location_type").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    elif a.command == "verify":
        show(files.entries(files.scan(kit.spark, a.folder, only=("zip",))))
    elif a.command == "export":
        sets, items = kit.catalogue(a.dat)
        documents.export_sets(sets, items, a.out, a.form)
    elif a.command == "rebuild":
        show(kit.rebuild(a.dat, a.out, a.folder, a.style, a.allow_incomplete, a.update, a.apply))
    elif a.command == "fixdat":
        kit.fixdat(a.dat, a.out, a.folder, a.form)
    elif a.command == "missing":
        report, found = kit.missing(a.dat, a.folder, a.sort)
        if a.form == "html":
            ordered = report.withColumn("place", F.monotonically_increasing_id()) if a.sort != "name" else report.withColumn("place", F.col("set_name"))
            documents.write_html("Missing", ordered, a.out, "place")
        else:
            documents.write_missing_text(report, found, a.out)
    elif a.command == "stats":
        show(kit.statistics(a.dat, a.folder))
    elif a.command == "rename":
        show(kit.rename(a.folder, a.apply))
    elif a.command == "organize":
        show(kit.organize(a.dat, a.folder, a.out, a.style, apply=a.apply))
    elif a.command == "consolidate":
        show(kit.consolidate(a.out, a.folder, a.apply))
    else:
        return _index(kit, a, show)
    return 0


def _index(kit: Kit, a: argparse.Namespace, show) -> int:
    index = kit.index
    if index is None:
        raise SystemExit("--index is needed")
    if a.action == "add":
        for v in a.value:
            index.add(v)
    elif a.action == "remove":
        print(sum(index.remove(v) for v in a.value))
    elif a.action == "refresh":
        print(index.refresh(a.value or None))
    elif a.action == "list":
        show(index.sources())
    elif a.action == "stats":
        print(index.statistics())
    elif a.action == "verify":
        print("{} valid, {} stale".format(*index.verify(a.remove_stale)))
    elif a.action == "clear":
        index.clear()
    elif a.action == "optimize":
        index.optimize()
    elif a.action == "find":
        show(search.grouped(kit.find(a.value[0], int(a.limit) if a.limit else None)))
    else:
        raise SystemExit(f"unknown action {a.action}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
