"""Change feeds: a stream of changed documents, the latest one opened, and re-rendering on change."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from docloom.markdown.paths import is_markdown
from docloom.operators.tables import render_documents

#: How often the feed is polled.
POLL = "400 milliseconds"


def snapshot(path: str) -> dict[str, int]:
    """Modification times, in nanoseconds, of a file or of the Markdown files below a folder; what can't be read is left out."""
    names = [path] if os.path.isfile(path) else [os.path.join(folder, n) for folder, _, own in os.walk(path) for n in own if is_markdown(n)]
    out = {}
    for name in names:
        try:
            out[name] = os.stat(name).st_mtime_ns
        except OSError:
            continue
    return out


class ChangeReader(SimpleDataSourceStreamReader):
    """Polls modification times. The first offset is the present, so only later edits are events; edits between two polls are one, and a deleted file is forgotten."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"seen": json.dumps(snapshot(self.path))}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        last = json.loads(start["seen"])
        now = snapshot(self.path)
        rows = [(name, at // 1_000_000) for name, at in sorted(now.items()) if at > last.get(name, -1)]
        return iter(rows), {"seen": json.dumps(now)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        last, now = json.loads(start["seen"]), json.loads(end["seen"])
        return iter([(name, at // 1_000_000) for name, at in sorted(now.items()) if at > last.get(name, -1)])

    def commit(self, end: dict) -> None:
        pass


class ChangeSource(DataSource):
    """Streaming source docloom_changes: (path, mtime_ms) of each edit below option path, a folder that the driver can read."""

    @classmethod
    def name(cls) -> str:
        return "docloom_changes"

    def schema(self) -> str:
        return "path string, mtime_ms long"

    def simpleStreamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options["path"])


def watch(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (path, mtime_ms) for edits below a path."""
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format(ChangeSource.name()).option("path", path).load()


def literal(path: str) -> str:
    """A path whose signs of patterns stand for themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def rerender(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = POLL):
    """Renders whole documents again on each change and hands the batch to sink(rendered, batch id); returns the running query.

    A batch that runs again after a failure reads the files as they are then; files that are gone by then are left out.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        paths = [r[0] for r in batch.select("path").distinct().toLocalIterator() if os.path.isfile(r[0])]  # the edits between two polls
        if not paths:
            return
        files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load([literal(p) for p in paths])
        docs = files.select(F.xxhash64("path").alias("doc_id"), F.regexp_replace("path", r"^file:(?://)?", "").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("md"))
        sink(render_documents(docs), number)

    return changes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def latest(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The last opened path of events(path, seq) for each subscriber; for a batch or, in complete mode, a stream."""
    return events.groupBy(*(by or [])).agg(F.max_by("path", "seq").alias("path"), F.max("seq").alias("seq"))


def without_repeats(events: DataFrame, by: str) -> DataFrame:
    """events(path, seq) of a batch without those that open the path that is open already."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("seq")
    return events.withColumn("before", F.lag("path").over(w)).where(~F.col("path").eqNullSafe(F.col("before")) | F.col("before").isNull()).drop("before")
