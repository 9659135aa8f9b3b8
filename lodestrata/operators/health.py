"""Is the nightly run well, and what may be thrown away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WARN_HOURS, FAIL_HOURS = 28, 50
#: Files of a kind that are kept, and the days that replay work is.
KEEP, REPLAY_DAYS = {"harvest": 40, "out": 40, "run-log": 30, "completion": 40, "shards": 10}, 7


def verdict(age_hours: Column, pending: Column, last_status: Column, ready: Column, warn: int = WARN_HOURS, fail: int = FAIL_HOURS) -> Column:
    """RED without a trigger, without a journal, or with one older than `fail` hours; YELLOW if older than `warn`, with reviews
    pending, or if the last run's status has neither success nor ok in it; else GREEN."""
    red = ~F.coalesce(ready, F.lit(False)) | age_hours.isNull() | (age_hours > fail)
    bad = F.coalesce((last_status != "") & ~last_status.rlike("(?i)success|ok"), F.lit(False))
    return F.when(red, "RED").when((age_hours > warn) | (F.coalesce(pending, F.lit(0)) > 0) | bad, "YELLOW").otherwise("GREEN")


def succeeded(journal_fresh: Column, marker_fresh: Column) -> Column:
    """A run counts as done by its journal and its marker, whatever its exit code."""
    return F.coalesce(journal_fresh & marker_fresh, F.lit(False))


def advances_watermark(success: Column, replay: Column, propose_only: Column) -> Column:
    return success & ~F.coalesce(replay, F.lit(False)) & ~F.coalesce(propose_only, F.lit(False))


def keep_newest(files: DataFrame, n: int) -> DataFrame:
    """The n newest rows of each kind (kind, name, modified), with their place; tasks pick theirs before the shuffle."""
    order = Window.partitionBy("kind").orderBy(F.desc("modified"), F.desc("name"))
    return files.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def keep_recent(files: DataFrame, as_of: Column, days: int = REPLAY_DAYS) -> DataFrame:
    return files.where(F.col("modified") >= as_of - F.make_dt_interval(days=F.lit(days)))


def journal_summary(order: DataFrame) -> DataFrame:
    """section, n_claims, n_skills, top_importance for each bucket of a work order."""
    return order.groupBy(F.col("bucket").alias("section")).agg(F.count(F.lit(1)).alias("n_claims"), F.count_distinct("skill").alias("n_skills"), F.max("importance").alias("top_importance"))
