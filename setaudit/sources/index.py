"""A stored index of sources: Parquet files, and manifests that say which of them count.

Each change writes new files first and then one manifest with the next number. A manifest is created, never overwritten: of
two writers one fails and nothing of its work counts, and a reader sees the files of one manifest. Manifests hold one entry
per source (there are some dozens, at any number of rows), rows stay in Spark.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setaudit.sources import files

ROWS = "name string, size bigint, crc32 string, sha1 string, md5 string, location_type string, location_path string, location_entry string, last_modified bigint, source_path string, error string"
SOURCES = "path string, last_scan bigint, rom_count bigint, total_size bigint, data string"
DAY = 24 * 3600


@dataclass
class Source:
    path: str
    last_scan: int
    rom_count: int
    total_size: int
    data: str


class Conflict(RuntimeError):
    """Another writer committed first."""


class Index:
    """The index in a folder; a folder without one is an empty index."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # ---- manifests

    def versions(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _read(self, version: int | None) -> dict[str, Source]:
        if version is None:
            version = max(self.versions(), default=None)
        if version is None:
            return {}
        text = "".join(r.value for r in self.spark.read.text(f"{self.folder}/manifests/{version:012d}.json", wholetext=True).collect())
        return {s["path"]: Source(**s) for s in json.loads(text)}

    def _commit(self, base: list[int], sources: dict[str, Source]) -> None:
        number = max(base, default=0) + 1
        text = json.dumps([asdict(s) for s in sources.values()], sort_keys=True, indent=1)
        folder = f"{self.folder}/manifests"
        self._fs.mkdirs(self._path(folder))
        draft, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{number:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {number} of {self.folder} exists")

    # ---- reading

    def sources(self, version: int | None = None) -> DataFrame:
        """(path, last_scan, rom_count, total_size, data) of all sources in order of path."""
        rows = [tuple(asdict(s).values()) for s in self._read(version).values()]
        return self.spark.createDataFrame(sorted(rows), SOURCES)

    def roms(self, version: int | None = None) -> DataFrame:
        """All rows of the index, as of a version (the last by default)."""
        return self._rows(self._read(version).values())

    def _rows(self, sources) -> DataFrame:
        paths = sorted({s.data for s in sources if s.data})
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def load(self) -> DataFrame:
        """The rows kept in the executors' memory, spilled to disk where they do not fit."""
        return self.roms().cache()

    def statistics(self) -> str:
        """Sources and totals as JSON with sorted keys and ISO dates."""
        s = sorted(self._read(None).values(), key=lambda x: x.path)
        iso = lambda t: time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(t))
        return json.dumps({"sources": [asdict(x) | {"last_scan": iso(x.last_scan)} for x in s], "source_count": len(s), "rom_count": sum(x.rom_count for x in s), "total_size": sum(x.total_size for x in s)}, sort_keys=True, indent=2)

    def outdated(self, now: int | None = None) -> list[str]:
        """Sources last scanned over a day ago."""
        return sorted(s.path for s in self._read(None).values() if (now or time.time()) - s.last_scan > DAY)

    # ---- writing

    def _write(self, path: str, rows: DataFrame) -> Source:
        data = f"{self.folder}/data/{uuid.uuid4().hex}"
        known = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in ROWS.split(", "))]
        rows.select(*known).write.parquet(data)
        n = self.spark.read.schema(ROWS).parquet(data).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
        return Source(path, int(time.time()), n.n, n.s, data)

    def upsert(self, path: str, rows: DataFrame) -> Source:
        """Rows of one source added; a row of a place that is there replaces it."""
        base, known = self.versions(), self._read(None)
        old = self._rows([known[path]] if path in known else [])
        known[path] = self._write(path, files.upsert(old, rows.withColumn("source_path", F.lit(path))))
        self._commit(base, known)
        return known[path]

    def add(self, path: str) -> bool:
        """Index a folder unless it is indexed."""
        if path in self._read(None):
            return False
        self.upsert(path, files.inventory(self.spark, path))
        return True

    def remove(self, path: str) -> int:
        """Forget a source; the number of its rows. `/var` and `/private/var` name one folder."""
        base, known = self.versions(), self._read(None)
        same = [p for p in (path, "/private" + path, path.removeprefix("/private")) if p in known]
        if not same:
            return 0
        gone = known.pop(same[0])
        self._commit(base, known)
        return gone.rom_count

    def refresh(self, paths: list[str] | None = None) -> int:
        """Sources (all by default) indexed afresh in one change; the number of rows they now have."""
        base, known = self.versions(), self._read(None)
        again = [p for p in (paths if paths is not None else known) if p in known]
        for p in again:
            known[p] = self._write(p, files.inventory(self.spark, p))
        if again:
            self._commit(base, known)
        return sum(known[p].rom_count for p in again)

    def clear(self) -> None:
        self._commit(self.versions(), {})

    def optimize(self, rows_per_file: int = 5_000_000) -> None:
        """Each source rewritten into few files, sorted by checksum so searches skip most of them; dead files deleted.

        Files that no manifest since names are deleted, so older versions are gone afterwards.
        """
        base, known = self.versions(), self._read(None)
        for p, s in known.items():
            rows = self._rows([s]).repartitionByRange(max(1, s.rom_count // rows_per_file + 1), "crc32").sortWithinPartitions("crc32")
            new = self._write(p, rows)
            known[p] = Source(p, s.last_scan, new.rom_count, new.total_size, new.data)
        self._commit(base, known)
        last, kept = max(self.versions()), {s.data.rsplit("/", 1)[-1] for s in known.values()}
        for v in self.versions():
            if v < last:
                self._fs.delete(self._path(f"{self.folder}/manifests/{v:012d}.json"), False)
        at = self._path(f"{self.folder}/data")
        for f in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if f.getPath().getName() not in kept:
                self._fs.delete(f.getPath(), True)

    def verify(self, remove_stale: bool = False) -> tuple[int, int]:
        """(valid, stale) rows by whether their files are there; stale ones are deleted if asked."""
        base, known, valid, gone = self.versions(), self._read(None), 0, 0
        for p, s in list(known.items()):
            rows = self._rows([s])
            there = self._path(p)
            listing = files.scan(self.spark, p).select("path") if self._fs.exists(there) else self.spark.createDataFrame([], "path string")
            lost = files.stale(rows, listing)
            n = lost.count()
            valid, gone = valid + s.rom_count - n, gone + n
            if n and remove_stale:
                new = self._write(p, rows.join(lost.select("location_path").distinct(), "location_path", "left_anti"))
                known[p] = Source(p, s.last_scan, new.rom_count, new.total_size, new.data)
        if gone and remove_stale:
            self._commit(base, known)
        return valid, gone
