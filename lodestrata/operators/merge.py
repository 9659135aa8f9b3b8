"""Merging claims that share a fingerprint: where they disagree, the result leans towards review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ACTIVE_WORK, confidence_name, confidence_rank, fingerprint, strip, text
from .written import written

FIELDS = ("claim", "domain", "horizon", "importance", "confidence", "target", "status", "source", "evidence", "notes")
#: Those of them that can be long, and are only wanted of a group's base.
_TEXTS = ("claim", "notes")
#: Length of merged evidence; each text but the last takes two characters at least, so no more texts can be seen in it.
EVIDENCE_CHARS = 400
_EVIDENCE_TEXTS = EVIDENCE_CHARS // 2 + 1


def with_fingerprints(claims: DataFrame) -> DataFrame:
    """Claims that aren't blank, each with its own fingerprint or else the one of its text."""
    own = F.when(F.col("fingerprint") != "", F.col("fingerprint")) if "fingerprint" in claims.columns else F.lit(None).cast("string")
    return claims.where(F.length(strip(text(F.col("claim")))) > 0).withColumn("fingerprint", F.coalesce(own, fingerprint(F.col("claim"))))


def resolved_horizon(long: Column, short: Column, drop: Column) -> Column:
    """Long and short alone are short; with a vote to drop besides, the strongest other wins."""
    return F.when(long & short & ~drop, "short").when(long, "long").when(short, "short").otherwise("drop")


def merge_claims(claims: DataFrame) -> DataFrame:
    """One row for each fingerprint of claims (FIELDS, fingerprint, ord: a unique input order).

    A lone claim passes unchanged. Of several, the first among the most important gives the fields that aren't resolved;
    confidence is the least of all, at most medium if some but not all want to drop; a short claim goes to active work; evidence is
    the distinct texts in order, cut to EVIDENCE_CHARS; differing sources are mixed. n_raw counts the claims, first_ord is the first
    one's place; unresolvable marks disagreement with a horizon other than long, short and drop, which has no defined result.
    """
    rank = F.struct(F.coalesce("importance", F.lit(0)).alias("i"), (-F.col("ord")).alias("o"))
    horizon = F.coalesce(F.when(F.col("horizon") != "", F.col("horizon")), F.lit("drop"))
    source = F.when(F.col("source") != "", F.col("source"))
    votes = {x: F.max(horizon == x) for x in ("long", "short", "drop")}
    small = [c for c in FIELDS if c not in _TEXTS]
    bases = claims.select(F.col("ord").alias("base_ord"), *_TEXTS)  # of the other claims' texts, none is shuffled with the groups
    claims = written(claims.select("ord", "fingerprint", *small))  # fingerprints are dear, and both groups and evidence want them
    grouped = claims.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.min("ord").alias("first_ord"),
        F.max_by(F.struct("ord", *small), rank).alias("base"),
        F.max(F.coalesce("importance", F.lit(0))).alias("top"),
        F.min(confidence_rank(F.col("confidence"))).alias("least"),
        *[v.alias(f"has_{k}") for k, v in votes.items()],
        F.max(~horizon.isin("long", "short", "drop")).alias("has_other"),
        F.min(horizon).alias("low_horizon"),
        F.max(horizon).alias("high_horizon"),
        F.min(source).alias("low_source"),
        F.max(source).alias("high_source"),
    )
    mixed = F.col("low_horizon") != F.col("high_horizon")
    found = F.when(~mixed, F.col("low_horizon")).otherwise(resolved_horizon(F.col("has_long"), F.col("has_short"), F.col("has_drop")))
    merged = grouped.withColumn("found", found).withColumn("several", F.col("n_raw") > 1)
    least = F.when(mixed & F.col("has_drop") & (F.col("found") != "drop"), F.least("least", F.lit(2))).otherwise(F.col("least"))
    pick = lambda new, old: F.when(F.col("several"), new).otherwise(F.col(f"base.{old}")).alias(old)
    joined = merged.join(_evidence(claims), "fingerprint", "left").join(bases, F.col("base.ord") == F.col("base_ord"))
    return joined.select(
        "fingerprint", "claim", F.col("base.domain").alias("domain"), pick(F.col("found"), "horizon"), pick(F.col("top"), "importance"),
        pick(confidence_name(least), "confidence"), pick(F.when(F.col("found") == "short", ACTIVE_WORK).otherwise(F.col("base.target")), "target"), F.col("base.status").alias("status"),
        pick(F.when(F.col("low_source") != F.col("high_source"), "mixed").otherwise(F.col("low_source")), "source"), pick(text(F.col("joined")), "evidence"), "notes",
        "n_raw", "first_ord", (mixed & F.col("has_other")).alias("unresolvable"),
    )


def _evidence(claims: DataFrame) -> DataFrame:
    """The texts that can show in merged evidence: the first distinct ones, which tasks pick before anything is shuffled."""
    each = claims.where(F.coalesce("evidence", F.lit("")) != "").select("fingerprint", strip(F.col("evidence")).alias("e")).distinct()
    nth = F.row_number().over(Window.partitionBy("fingerprint").orderBy("e"))
    first = each.withColumn("nth", nth).where(F.col("nth") <= _EVIDENCE_TEXTS)
    return first.groupBy("fingerprint").agg(F.left(F.array_join(F.array_sort(F.collect_list("e")), "; "), F.lit(EVIDENCE_CHARS)).alias("joined"))


def conflicts(claims: DataFrame) -> DataFrame:
    """fingerprint, n_raw and the distinct horizons, in order and joined by commas, of groups that don't agree on one."""
    horizon = F.coalesce(F.when(F.col("horizon") != "", F.col("horizon")), F.lit("drop"))
    return claims.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_raw"), F.array_join(F.array_sort(F.collect_set(horizon)), ",").alias("horizons")).where(F.contains("horizons", F.lit(",")))


def duplicate_groups(claims: DataFrame) -> DataFrame:
    return claims.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_raw"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")).where("n_raw > 1")


def ranked(candidates: DataFrame) -> DataFrame:
    """Candidates by falling importance, and by first place among equals."""
    return candidates.orderBy(F.coalesce("importance", F.lit(0)).desc(), "first_ord")
