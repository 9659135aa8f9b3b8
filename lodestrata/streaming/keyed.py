"""The registry's counters as keyed state of a stream: timers for what decays, a time to live for what is forgotten."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.ledger import DECAY_DAYS

CHANGE = "fingerprint string, change string, hit_count long, distinct_days long, first_seen timestamp, last_seen timestamp, at_ms long"
STATE = "hits long, days long, first long, last long, last_day string, timer long, stale boolean"
PARTIAL = "fingerprint string, day string, hits long, first long, last long"
#: By the stream's own time so many states hold all fingerprints, each those of one bucket: a call on a state costs some tenths of a
#: millisecond, a fingerprint in it some microseconds. A checkpoint is bound to its number.
BUCKETS = 1 << 15
HELD = "counters string, timer long"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY_MS = 86_400_000


def _row(fingerprint: str, change: str, hits: int, days: int, first: int, last: int, now: int) -> Row:
    return Row(fingerprint=fingerprint, change=change, hit_count=hits, distinct_days=days, first=first, last=last, at_ms=now)


def _folded(before: Iterable | None, rows: list[Row]) -> tuple[int, int, int, int, str]:
    """hits, days, first, last, last_day of a fingerprint after some sightings more."""
    hits, days, first, last, last_day = before or (0, 0, None, None, None)
    found = sorted({r["day"] for r in rows})
    first, last = min([r["first"] for r in rows] + [first] * (first is not None)), max([r["last"] for r in rows] + [last] * (last is not None))
    return hits + sum(r["hits"] for r in rows), days + len(found) - (last_day in found), first, last, found[-1]


class Counters(StatefulProcessor):
    """By the wall clock: folds sightings of a fingerprint into its state and gives a row for each change: seen, decayed.

    The timer runs from the batch, and what is forgotten goes by the state's time to live, without a row. at_ms is the clock at the change, and a timer
    runs at least a millisecond beyond it: of one fingerprint's changes the one of the highest at_ms and then hit_count is the last.
    """

    def __init__(self, decay_days: float, keep_days: float | None) -> None:
        self.decay_ms, self.keep_ms = int(decay_days * DAY_MS), None if keep_days is None else int(keep_days * DAY_MS)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counters", STATE, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = self.state.get()
        own = _folded(old and old[:5], list(rows))
        now = timerValues.getCurrentProcessingTimeInMs()
        if old and old[5] is not None:
            self.handle.deleteTimer(old[5])
        timer = now + max(1, self.decay_ms)
        self.state.update((*own, timer, False))
        self.handle.registerTimer(timer)
        yield _row(key[0], "seen", *own[:4], now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        old = self.state.get()
        if not old or expiredTimerInfo.getExpiryTimeInMs() != old[5]:
            return
        self.state.update((*old[:5], None, True))
        yield _row(key[0], "decayed", *old[:4], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


class Buckets(StatefulProcessor):
    """By the stream's own clock: folds sightings into the state of their fingerprints' bucket and gives a row for each change: seen, decayed, forgotten.

    A fingerprint is due from its last sighting, first when it decays, then when it is forgotten; a bucket's timer is that of its first one due.
    at_ms is the watermark at the change, and what is due is at least a millisecond beyond it, as for Counters.
    """

    def __init__(self, decay_days: float, keep_days: float | None) -> None:
        self.decay_ms, self.keep_ms = int(decay_days * DAY_MS), None if keep_days is None else int(keep_days * DAY_MS)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("buckets", HELD)

    def _read(self) -> tuple[dict[str, list], int | None]:
        held = self.state.get()
        return (json.loads(held[0]), held[1]) if held else ({}, None)

    def _write(self, counters: dict[str, list], timer: int | None, fired: bool) -> None:
        first = min((x[5] for x in counters.values() if x[5] is not None), default=None)
        if first != timer or fired:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.state.update((json.dumps(counters, separators=(",", ":")), first)) if counters else self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        counters, timer = self._read()
        now = max(0, timerValues.getCurrentWatermarkInMs() or 0)
        seen: dict[str, list[Row]] = {}
        for r in rows:
            seen.setdefault(r["fingerprint"], []).append(r)
        for name, own in seen.items():
            new = _folded(counters[name][:5] if name in counters else None, own)
            counters[name] = [*new, max(now + 1, new[3] // 1000 + 1 + self.decay_ms), False]
            yield _row(name, "seen", *new[:4], now)
        self._write(counters, timer, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        counters, timer = self._read()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at != timer:
            return
        now = max(0, timerValues.getCurrentWatermarkInMs() or 0)
        for name, (hits, days, first, last, last_day, due, stale) in list(counters.items()):
            if due is None or not (due < now or due <= at):
                continue
            if stale:
                del counters[name]
                yield _row(name, "forgotten", 0, 0, first, last, now)
            else:
                again = None if self.keep_ms is None else max(now + 1, last // 1000 + 1 + self.keep_ms)
                counters[name] = [hits, days, first, last, last_day, again, True]
                yield _row(name, "decayed", hits, days, first, last, now)
        self._write(counters, timer, True)

    def close(self) -> None:
        pass


def registry_changes(sightings: DataFrame, delay: str = "0 seconds", decay_days: float = DECAY_DAYS, keep_days: float | None = None, wall: bool = False) -> DataFrame:
    """The changes that a stream of sightings (fingerprint, ts) makes: CHANGE.

    A batch's sightings are summed by fingerprint and day within each task before they go to their state, so a hot one is a row for each Arrow batch and day. A
    day counts if it isn't the last one stored; sightings that come late count as hits, however late. What was seen last decay_days ago by the
    watermark (or, if wall, by the clock) decays, once, until it is seen again; after keep_days it is forgotten, and begins anew. Sightings without a
    fingerprint or a time are passed over.
    """
    timed = sightings.select("fingerprint", F.col("ts").cast("timestamp").alias("ts")).where("fingerprint IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    rows = timed.select("fingerprint", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.unix_micros("ts").alias("us"))
    change = CHANGE.replace("first_seen timestamp", "first long").replace("last_seen timestamp", "last long")
    sums = rows.mapInArrow(_summed, PARTIAL)
    if wall:
        out = sums.groupBy("fingerprint").transformWithState(Counters(decay_days, keep_days), change, "Append", "ProcessingTime")
    else:
        dealt = sums.withColumn("bucket", F.pmod(F.xxhash64("fingerprint"), F.lit(BUCKETS)))
        out = dealt.groupBy("bucket").transformWithState(Buckets(decay_days, keep_days), change, "Append", "EventTime")
    return out.select("fingerprint", "change", "hit_count", "distinct_days", F.timestamp_micros("first").alias("first_seen"), F.timestamp_micros("last").alias("last_seen"), "at_ms")


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = pa.Table.from_batches([batch]).group_by(["fingerprint", "day"]).aggregate([("us", "count"), ("us", "min"), ("us", "max")])
        yield from sums.select(["fingerprint", "day", "us_count", "us_min", "us_max"]).rename_columns(["fingerprint", "day", "hits", "first", "last"]).to_batches()


def append_changes(changes: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Take in what there is now, append the changes to folder, and stop; or go on, with a batch every so often. By the wall clock there is always
    another batch, for its timers, so that every must be given. State is in RocksDB, its snapshots with the checkpoint; folder has each
    batch's changes once, however often a batch is tried."""
    conf, (name, value) = changes.sparkSession.conf, PROVIDER
    before = conf.get(name, None)
    conf.set(name, value)
    try:
        return changes.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def registry_state(changes: DataFrame) -> DataFrame:
    """fingerprint, hit_count, distinct_days, first_seen, last_seen, decayed as the changes so far have left them; forgotten ones are not there."""
    last = changes.groupBy("fingerprint").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "fingerprint"]), F.struct("at_ms", "hit_count")).alias("x"))
    return last.where("x.change <> 'forgotten'").select("fingerprint", "x.hit_count", "x.distinct_days", "x.first_seen", "x.last_seen", (F.col("x.change") == "decayed").alias("decayed"))
