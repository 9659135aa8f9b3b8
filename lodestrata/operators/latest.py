"""The latest reading of what is read more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(readings: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Of the rows of each key the one of the highest version, column by column. Whole rows are compared and kept, never columns of several."""
    rest = [c for c in readings.columns if c != key]
    return readings.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def replace_older(prior: DataFrame, readings: DataFrame, key: str, version: list[str]) -> DataFrame:
    """prior, a row a key, with each row replaced by a reading of the same or a higher version; readings of new keys are put in. A reading that comes
    late, with a lower version than what is there, changes nothing."""
    rest = [c for c in prior.columns if c != key]
    old = prior.select(key, F.struct(*rest).alias("old"))
    new = newest(readings.select(*prior.columns), key, version).select(key, F.struct(*rest).alias("new"))
    later = F.struct(*[F.col(f"new.{c}") for c in version]) >= F.struct(*[F.col(f"old.{c}") for c in version])
    kept = F.when(F.col("old").isNull() | (F.col("new").isNotNull() & later), F.col("new")).otherwise(F.col("old"))
    return old.join(new, key, "full_outer").select(key, kept.alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def replace_whole(prior: DataFrame, read: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """prior, several rows a key, in which the keys of read have the rows of parts in place of all that they had: a part that is gone goes."""
    again = read.select(key).distinct()
    return prior.join(again, key, "left_anti").unionByName(parts.select(*prior.columns).join(again, key, "left_semi"))


def keep_latest(table, key: str, version: list[str], stream: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a bucketed table at the latest readings; a batch that is run again changes nothing."""

    def keep(batch: DataFrame, number: int) -> None:
        if table.batch(stream) >= number:
            return
        batch.persist()  # read for its buckets, and then put in
        try:
            table.update(batch, lambda prior: replace_older(prior, batch, key, version), stream, number)
        finally:
            batch.unpersist()

    return keep
