"""The registry: how often and on how many days each claim was seen, its last attributes, and what follows from that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTRIBUTES = ("claim", "domain", "horizon", "importance", "confidence", "target", "source", "evidence", "notes")
PROMOTE_HITS, PROMOTE_DAYS, DECAY_DAYS = 3, 3, 14


def upsert(prior: DataFrame, batch: DataFrame, now: Column, day: Column) -> DataFrame:
    """prior with a batch of sightings (ATTRIBUTES, status, fingerprint, ord) folded in, and `change` (inserted, updated, kept).

    Each sighting counts as a hit; a day counts if it isn't the last one stored. The last sighting's attributes win, and the last
    status that isn't null, else the stored one, else active. now is an ISO text and day a date text, both of the run.
    """
    seen = batch.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("hits"), F.max_by(F.struct(*ATTRIBUTES), "ord").alias("new"), F.max_by("status", F.when(F.col("status").isNotNull(), F.col("ord"))).alias("new_status")
    )
    old = prior.select("fingerprint", F.struct(*[c for c in prior.columns if c != "fingerprint"]).alias("old"))
    both = old.join(seen, "fingerprint", "full_outer")
    met, known = F.col("hits").isNotNull(), F.col("old").isNotNull()
    fresh = F.when(met & known & ~F.col("old.last_day").eqNullSafe(day), 1).when(met & ~known, 1).otherwise(0)
    pick = lambda new, old: F.when(met, new).otherwise(F.col(f"old.{old}")).alias(old)
    return both.select(
        "fingerprint",
        *[pick(F.col(f"new.{c}"), c) for c in ATTRIBUTES],
        F.coalesce("new_status", "old.status", F.when(met, F.lit("active"))).alias("status"),
        (F.coalesce("old.hit_count", F.lit(0)) + F.coalesce("hits", F.lit(0))).cast("long").alias("hit_count"),
        (F.coalesce("old.distinct_days", F.lit(0)) + fresh).cast("long").alias("distinct_days"),
        F.coalesce("old.first_seen", now).alias("first_seen"), pick(now, "last_seen"), pick(day, "last_day"), pick(now, "updated_at"),
        F.when(~known, "inserted").when(met, "updated").otherwise("kept").alias("change"),
    )


def fold_history(sightings: DataFrame) -> DataFrame:
    """The registry's counters from a whole log of sightings (key, ts): hits, days (those that differ from the day before in the
    log, which for a log in order are the distinct ones), first and last. Days are made distinct before anything is sorted."""
    days = sightings.groupBy("key", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return days.groupBy("key").agg(F.sum("n").alias("hit_count"), F.count(F.lit(1)).alias("distinct_days"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"))


def fold_runs(sightings: DataFrame) -> DataFrame:
    """Like fold_history for a log whose days (key, ord, day) may go back: each change from the sighting before counts a day."""
    before = F.lag("day").over(Window.partitionBy("key").orderBy("ord"))
    changed = sightings.withColumn("fresh", F.when(before.eqNullSafe(F.col("day")), 0).otherwise(1))
    return changed.groupBy("key").agg(F.count(F.lit(1)).alias("hit_count"), F.sum("fresh").alias("distinct_days"))


def promotions(items: DataFrame, hits: int = PROMOTE_HITS, days: int = PROMOTE_DAYS) -> DataFrame:
    return items.where((F.col("horizon") == "short") & F.col("status").isin("active", "applied") & (F.col("hit_count") >= hits) & (F.col("distinct_days") >= days))


def promotions_by_hits(items: DataFrame, hits: int = PROMOTE_HITS, days: int = PROMOTE_DAYS) -> DataFrame:
    """promotions by falling hits, equals by fingerprint."""
    return promotions(items, hits, days).orderBy(F.desc("hit_count"), "fingerprint")


def decays(items: DataFrame, as_of: Column, days: int = DECAY_DAYS) -> DataFrame:
    """Active short claims last seen earlier than so many days before as_of."""
    return items.where((F.col("horizon") == "short") & (F.col("status") == "active") & (F.col("last_seen") < as_of - F.make_dt_interval(days=F.lit(days))))


def decays_by_age(items: DataFrame, as_of: Column, days: int = DECAY_DAYS) -> DataFrame:
    """decays, the longest unseen first, equals by fingerprint."""
    return decays(items, as_of, days).orderBy("last_seen", "fingerprint")


def changes(upserted: DataFrame) -> DataFrame:
    """inserted, updated: how many of an upsert's rows are new, and how many were there before, in one row."""
    return upserted.agg(*[F.count_if(F.col("change") == x).alias(x) for x in ("inserted", "updated")])


def stats(items: DataFrame, by: str) -> DataFrame:
    """Rows for each value; null is a value of its own, written 'null'."""
    return items.groupBy(F.coalesce(by, F.lit("null")).alias(by)).agg(F.count(F.lit(1)).alias("items"))


def dump(items: DataFrame, status: str | None = None, horizon: str | None = None) -> DataFrame:
    for name, value in (("status", status), ("horizon", horizon)):
        items = items.where(F.col(name) == value) if value else items
    return items.orderBy(F.col("importance").desc_nulls_last(), F.col("hit_count").desc_nulls_last(), "fingerprint")


def set_status(items: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """items with the status of updates (fingerprint, status, ord); of several for one item the last holds. Any text will do."""
    last = updates.groupBy("fingerprint").agg(F.max_by("status", "ord").alias("new"), F.lit(True).alias("hit"))
    joined = items.join(last, "fingerprint", "left")
    changed = {"status": F.when(F.col("hit"), F.col("new")).otherwise(F.col("status"))}
    if "updated_at" in items.columns:
        changed["updated_at"] = F.when(F.col("hit"), now).otherwise(F.col("updated_at"))
    return joined.withColumns(changed).drop("new", "hit")


def record_run(runs: DataFrame, new: DataFrame) -> DataFrame:
    """runs with those of new put in, in place of what has the same run_id."""
    return runs.join(new.select("run_id").distinct(), "run_id", "left_anti").unionByName(new, allowMissingColumns=True)


def last_run(runs: DataFrame) -> DataFrame:
    """The run that finished last; of equals the one of the highest id."""
    return runs.orderBy(F.col("finished").desc_nulls_last(), F.col("run_id").desc()).limit(1)
