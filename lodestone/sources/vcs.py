"""The change log of a git work tree as a data source."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TIMEOUT = 30


def git_lines(root: str, *args: str) -> list[str]:
    """Lines of a git command; none if it fails or takes too long."""
    try:
        done = subprocess.run(["git", *args], cwd=root, capture_output=True, timeout=TIMEOUT)
    except (OSError, subprocess.TimeoutExpired):
        return []
    return done.stdout.decode("utf-8", "replace").splitlines() if done.returncode == 0 else []


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.since, self.path, self.kind = options["path"], options.get("since", "1 week ago"), options.get("pathFilter"), options.get("kind", "status")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition):
        args = ["log", f"--since={self.since}", "--pretty=format:", "--name-status" if self.kind == "status" else "--shortstat"]
        for line in git_lines(self.root, *args, *(["--", self.path] if self.path and self.kind == "status" else [])):
            if line.strip():
                yield (line,)


class LogSource(DataSource):
    """``spark.read.format("gitlog").option("since", ...).load(root)``: status or (``kind`` stat) statistics lines."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)


def log(spark: SparkSession, root: str, since: str = "1 week ago", path_filter: str | None = None, kind: str = "status") -> DataFrame:
    spark.dataSource.register(LogSource)
    read = spark.read.format("gitlog").option("since", since).option("kind", kind)
    return (read.option("pathFilter", path_filter) if path_filter else read).load(root)
