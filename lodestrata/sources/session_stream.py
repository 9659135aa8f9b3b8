"""A session store as a stream: each trigger pulls what has changed since the last, an hour of it again, and gives every reading once."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import SESSION, row_ranges

OVERLAP_HOURS = 1.0


class SessionStream(DataSource):
    """format("lodestrata_session_stream") with path (an SQLite file on a disk that driver and executors share), columns (a Spark schema; updated_at
    among them), and optionally table, since, overlap_hours and partitions. Rows are read by time of change, ISO texts that are compared as such."""

    @classmethod
    def name(cls) -> str:
        return "lodestrata_session_stream"

    def schema(self) -> str:
        return self.options["columns"]

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _SessionStreamReader(self.options, [f.name for f in schema])


class _SessionStreamReader(DataSourceStreamReader):
    """An offset is the latest time of change so far. A batch is what lies between two offsets, and an overlap before the first; it is the same whenever it is
    asked for again, but for what has changed meanwhile, which a later batch has."""

    def __init__(self, options, columns: list[str]) -> None:
        self.path, self.table, self.columns = os.path.expanduser(options["path"]), options.get("table", "sessions"), columns
        self.since, self.overlap, self.n = options.get("since", ""), float(options.get("overlap_hours", OVERLAP_HOURS)), int(options.get("partitions", 1))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"updated_at": self.since}

    def latestOffset(self) -> dict:  # noqa: N802
        if not os.path.exists(self.path):
            return self.initialOffset()
        with _open(self.path) as db:
            latest = db.execute(f'SELECT max(updated_at) FROM "{self.table}"').fetchone()[0]
        return {"updated_at": max(latest or "", self.since)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low = start["updated_at"]
        low = low if low == self.since else earlier(low, self.overlap)
        if not os.path.exists(self.path):
            return []
        with _open(self.path) as db:
            return [InputPartition((*rows, low, end["updated_at"])) for rows in row_ranges(db, self.table, self.n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, last, low, high = partition.value
        names = ", ".join(f'"{c}"' for c in self.columns)
        with _open(self.path) as db:
            yield from db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ? AND updated_at > ? AND updated_at <= ?', [first, last, low, high])


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def earlier(time: str, hours: float) -> str:
    """An ISO time so many hours before, in the same form; what is no time stays as it is."""
    try:
        then = datetime.fromisoformat(time.replace("Z", "+00:00")) - timedelta(hours=hours)
    except ValueError:
        return time
    return then.isoformat().replace("+00:00", "Z") if time.endswith("Z") else then.isoformat()


def read_session_stream(spark: SparkSession, db: str, since: str = "", overlap_hours: float = OVERLAP_HOURS, partitions: int = 1) -> DataFrame:
    """Readings of sessions, each (id, updated_at) once, though the overlap is read again.

    A session that is written up to overlap_hours after the time that it bears is found by the trigger after. What has been read is remembered for twice
    the overlap of the sessions' own time, and not longer. Rows whose updated_at is no time are left out.
    """
    spark.dataSource.register(SessionStream)
    options = {"path": db, "columns": SESSION, "since": since, "overlap_hours": overlap_hours, "partitions": partitions}
    rows = spark.readStream.format("lodestrata_session_stream").options(**options).load()
    timed = rows.withColumn("changed", F.try_to_timestamp(F.regexp_replace("updated_at", "Z$", "+00:00"))).where("changed IS NOT NULL")
    minutes = int(2 * 60 * overlap_hours) + 1
    return timed.withWatermark("changed", f"{minutes} minutes").dropDuplicatesWithinWatermark(["id", "updated_at"]).drop("changed")
