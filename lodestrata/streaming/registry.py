"""The registry kept up by a stream of sightings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import upsert
from ..sources.store import BucketedTable


def fold_batches(table: BucketedTable, now: Callable[[int], str], stream: str = "registry") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that folds each batch into the table.

    A version has the number of the stream's last batch with it, so that a batch that is run again after a failure changes nothing, and
    hits count once however often it is tried. Whatever else writes the table, other streams too, does no harm, one writer at a time.
    now gives the run's ISO time for a batch number; stream is a name without - and @ that stays the same as long as its checkpoint does.
    """

    def fold(batch: DataFrame, number: int) -> None:
        if table.batch(stream) >= number:
            return
        stamp = now(number)
        batch.persist()  # read for its buckets, and then folded
        try:
            table.update(batch, lambda prior: upsert(prior, batch, F.lit(stamp), F.lit(stamp[:10])).drop("change"), stream, number)
        finally:
            batch.unpersist()

    return fold


def stream_name(checkpoint: str) -> str:
    """The name under which a checkpoint's batches are known."""
    return hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def run_registry(sightings: DataFrame, table: BucketedTable, checkpoint: str, now: Callable[[int], str]) -> StreamingQuery:
    """Start the stream and fold all that is there now, then stop; the checkpoint remembers what has been folded, and names the stream."""
    return sightings.writeStream.foreachBatch(fold_batches(table, now, stream_name(checkpoint))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
