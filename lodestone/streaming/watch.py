"""Debounced watching: quiet periods as session windows, and re-indexing in micro-batches."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tree import watched

QUIET = "5 seconds"


def sessions(events: DataFrame, *, key: str = "project", ts: str = "ts", path: str = "path", quiet: str = QUIET, late: str | None = None) -> DataFrame:
    """(key, first_ts, flush_ts, n_events, n_paths): each event restarts the quiet period, and its end flushes.

    Batch or streaming; on a stream, ``late`` sets the watermark and a flush is emitted once it has passed.
    """
    events = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if late is not None:
        events = events.withWatermark("__ts", late)
    # streams have no distinct aggregate; the set is that of one session
    paths = F.size(F.collect_set(path)).cast("long") if events.isStreaming else F.count_distinct(path)
    out = events.groupBy(F.col(key), F.session_window("__ts", quiet).alias("w")).agg(F.count("*").alias("n_events"), paths.alias("n_paths"))
    return out.select(key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("flush_ts"), "n_events", "n_paths")


def pending(events: DataFrame, *, ts: str = "ts", path: str = "path", late: str = "10 seconds") -> DataFrame:
    """A stream of events with each path once within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([path])


def seconds(quiet: str) -> float:
    """Of "5 seconds", "1 minute", "2 hours"."""
    number, unit = quiet.split()
    return float(number) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")]


class Watchers:
    """Running watchers by project; starting one twice has no effect."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.running: dict[str, StreamingQuery] = {}
        self.timers: dict[str, threading.Timer] = {}
        self.lock = threading.Lock()

    def start(self, root: str, reindex: Callable[[], None], checkpoint: str, quiet: str = QUIET) -> bool:
        """Watch the files below ``root``; True if it was not watched before.  Every batch with events restarts the quiet period, and
        ``reindex`` runs when it ends.  Deletions show when ``reindex`` lists the tree."""
        with self.lock:
            if root in self.running and self.running[root].isActive:
                return False
            schema = "path string, modificationTime timestamp, length long, content binary"
            files = self.spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
            files = files.select("path", "modificationTime", "length")

            def flush(batch: DataFrame, _: int) -> None:
                if not watched(batch, root).isEmpty():
                    with self.lock:
                        if (old := self.timers.get(root)) is not None:
                            old.cancel()
                        self.timers[root] = threading.Timer(seconds(quiet), reindex)
                        self.timers[root].daemon = True
                        self.timers[root].start()

            self.running[root] = files.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
            return True

    def stop(self, root: str) -> bool:
        with self.lock:
            query, timer = self.running.pop(root, None), self.timers.pop(root, None)
        if timer is not None:
            timer.cancel()
        if query is not None:
            query.stop()  # outside the lock, which a batch may be waiting for
        return query is not None
