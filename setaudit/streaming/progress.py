"""Incremental scans and progress as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setaudit.functions.names import base_name, extension


def new_files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """A stream of files as they appear, at most `per_batch` a trigger."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    return files.select("path", base_name(F.col("path")).alias("name"), extension(F.col("path")).alias("ext"), F.col("length").alias("size"), "modificationTime")


def progress(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value per type and window; works on a stream (late events within the watermark count) and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def remaining(current, total, elapsed):
    """Seconds still needed at the pace so far; null before anything is done."""
    return F.when(current > 0, (total - current) * elapsed / current)


def in_batches(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, should_stop: Callable[[], bool] = lambda: False):
    """Hand each micro-batch to a callback until there is nothing more or `should_stop` says so."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: None if should_stop() else handler(df, n)).start()


class Events:
    """What happens to the streams of a session, in order: (kind, name, rows so far). Handlers are called with each event; one that
    says False cancels the stream it speaks of."""

    def __init__(self, spark: SparkSession, *handlers: Callable[[str, str, int], bool | None]):
        from pyspark.sql.streaming import StreamingQueryListener

        self.spark, self.seen, self.rows, self.handlers = spark, [], {}, handlers
        names: dict[str, str] = {}
        tell = self._tell

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                names[str(event.id)] = event.name or ""
                tell("started", str(event.id), names, 0)

            def onQueryProgress(self, event):
                p = event.progress
                names[str(p.id)] = p.name or ""
                tell("progress", str(p.id), names, p.numInputRows)

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                tell("failed" if event.exception else "completed", str(event.id), names, 0)

        self.listener = Listener()
        spark.streams.addListener(self.listener)

    def _tell(self, kind: str, key: str, names: dict[str, str], rows: int) -> None:
        self.rows[key] = self.rows.get(key, 0) + rows
        event = (kind, names.get(key, ""), self.rows[key])
        self.seen.append(event)
        if any(h(*event) is False for h in self.handlers):
            for q in self.spark.streams.active:
                if str(q.id) == key:
                    q.stop()

    def close(self) -> None:
        self.spark.streams.removeListener(self.listener)


def cancellable(spark: SparkSession, tag: str, work: Callable[[], object]) -> object:
    """Work whose jobs bear a tag, so `spark.interruptTag(tag)` from another thread cancels them."""
    spark.addTag(tag)
    try:
        return work()
    finally:
        spark.removeTag(tag)


class Errors:
    """Errors of a run, collected: (category, severity, message)."""

    def __init__(self):
        self.all: list[tuple[str, str, str]] = []

    def add(self, category: str, severity: str, message: str) -> None:
        self.all.append((category, severity, message))

    def of(self, category: str | None = None, severity: str | None = None) -> list[tuple[str, str, str]]:
        return [e for e in self.all if category in (None, e[0]) and severity in (None, e[1])]

    @property
    def critical(self) -> bool:
        return bool(self.of(severity="critical"))

    def text(self) -> str:
        return "\n".join(f"[{s}] {c}: {m}" for c, s, m in self.all)
