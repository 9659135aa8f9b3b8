"""The work order: where each candidate goes, with promotions and decays from the registry."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ACTIVE_WORK, INDEX, REVIEW, text

#: A claim without a known target becomes a proposal for a new skill from this importance on, or from the keep floor if higher.
NEW_SKILL_FLOOR = 7


def long_term_skills(configured: Iterable[str], seed: str | None = "general", seed_enabled: bool = True) -> list[str]:
    """The configured skills, or only the seed where there are none yet."""
    found = sorted(set(configured))
    return found or ([seed] if seed and seed_enabled else [])


def route(candidates: DataFrame, rejected: DataFrame, skills: list[str], keep_floor: int = 4) -> DataFrame:
    """candidates with bucket, skill, new_skill and rejected_denied; the first rule that holds decides.

    Rejected fingerprints (a column of rejected; null ones are passed over) and dropped claims go to drop; short ones, and any
    for active work, to active_add; those meant for review to review_queue; long ones for a known skill to by_skill if they
    are of high, to review_queue if of medium or low confidence; everything else to review_queue.
    """
    vetoed = rejected.where("fingerprint IS NOT NULL AND fingerprint <> ''").select(F.col("fingerprint").alias("vetoed")).distinct()
    joined = candidates.join(vetoed, F.col("fingerprint") == F.col("vetoed"), "left")
    horizon, confidence, target = text(F.col("horizon")), F.coalesce(F.when(F.col("confidence") != "", F.col("confidence")), F.lit("low")), text(F.col("target"))
    known = target.isin(skills) if skills else F.lit(False)
    denied = F.col("vetoed").isNotNull()
    last = ~(denied | horizon.isin("", "drop", "short") | target.isin(ACTIVE_WORK, REVIEW))
    bucket = (
        F.when(denied | horizon.isin("", "drop"), "drop").when((horizon == "short") | (target == ACTIVE_WORK), "active_add").when(target == REVIEW, "review_queue")
        .when((horizon == "long") & (confidence == "high") & known, "by_skill").otherwise("review_queue")
    )
    new = last & ~known & (F.coalesce("importance", F.lit(0)) >= max(NEW_SKILL_FLOOR, keep_floor))
    added = joined.withColumns({"bucket": bucket, "skill": F.when(bucket == "by_skill", target), "new_skill": new, "rejected_denied": denied})
    return added.drop("vetoed")


def promoted(promotions: DataFrame, rejected: DataFrame, skills: list[str]) -> DataFrame:
    """Recurring short claims as long ones of high confidence: to their skill if it is known, else to review."""
    vetoed = rejected.where("fingerprint IS NOT NULL").select("fingerprint").distinct()
    kept, target = promotions.join(vetoed, "fingerprint", "left_anti"), text(F.col("target"))
    known = target.isin(skills) if skills else F.lit(False)
    importance = F.when(F.coalesce("importance", F.lit(0)) == 0, 6).otherwise(F.col("importance"))
    return kept.select(
        "fingerprint", "claim", "domain", F.lit("long").alias("horizon"), importance.alias("importance"), F.lit("high").alias("confidence"), target.alias("target"),
        F.lit("ledger-promotion").alias("source"), F.format_string("promoted (hit=%d days=%d)", F.col("hit_count").cast("long"), F.col("distinct_days").cast("long")).alias("evidence"),
        F.when(known, "by_skill").otherwise("review_queue").alias("bucket"), F.when(known, target).alias("skill"), F.lit(True).alias("promoted"),
    )


def decayed(decays: DataFrame) -> DataFrame:
    return decays.select("fingerprint", "claim", F.lit("active_remove").alias("bucket"))


def work_order(candidates: DataFrame, rejected: DataFrame, promotions: DataFrame, decays: DataFrame, skills: list[str], keep_floor: int = 4) -> DataFrame:
    routed = route(candidates, rejected, skills, keep_floor)
    order = routed.unionByName(promoted(promotions, rejected, skills), allowMissingColumns=True).unionByName(decayed(decays), allowMissingColumns=True)
    false = F.lit(False)
    return order.withColumns({c: F.coalesce(c, false) for c in ("new_skill", "rejected_denied", "promoted")})


def totals(order: DataFrame) -> DataFrame:
    """The work order's eight counters in one row."""
    count = lambda condition: F.count_if(condition).cast("long")
    promoted = F.coalesce("promoted", F.lit(False)) if "promoted" in order.columns else F.lit(False)
    skills = order.select("skill", "bucket", promoted.alias("promoted"), "rejected_denied")
    bucket = F.col("bucket")
    return skills.agg(
        count((bucket != "active_remove") & ~F.col("promoted")).alias("candidates"), F.count_distinct(F.when(bucket == "by_skill", F.col("skill"))).alias("skills_to_edit"), count(bucket == "by_skill").alias("apply_claims"),
        count(bucket == "active_add").alias("active_add"), count(bucket == "active_remove").alias("active_remove"), count(bucket == "review_queue").alias("review_queue"),
        count(bucket == "drop").alias("drops"), count(F.col("rejected_denied")).alias("rejected_denied"),
    )


def target_paths(spark, skills: dict[str, str], short_path: str | None = None, index_path: str | None = None, seed: str | None = None) -> DataFrame:
    """name, path of every place a claim can go to; without configured skills the seed has a path of its own name."""
    rows = dict(skills) or ({seed: f"skills/{seed}/SKILL.md"} if seed else {})
    rows |= {ACTIVE_WORK: short_path} if short_path else {}
    rows |= {INDEX: index_path} if index_path else {}
    return spark.createDataFrame(sorted(rows.items()), "name string, path string")
