"""Whether the nightly run is well, from the files and the registry that it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import health, ledger
from ..sources.config import Config
from ..sources.files import list_files
from ..sources.store import get_json, items_table, runs_table
from .run import Folders


def newest(files: DataFrame) -> DataFrame:
    """name, modified of the file that changed last, and the number of files, in one row; nulls and 0 without files."""
    return files.agg(F.max_by("name", F.struct("modified", "name")).alias("name"), F.max("modified").alias("modified"), F.count(F.lit(1)).alias("files"))


def problems(journals: DataFrame, pending: DataFrame, last: DataFrame, now: str, ready: bool, warn: int = health.WARN_HOURS, fail: int = health.FAIL_HOURS) -> DataFrame:
    """One row: verdict, journal_age_h, newest_journal, last_run_status, last_run_model, pending_review, issues, warnings.

    journals and pending are listings (name, modified), last is the last run's row or none. Any issue is RED, else any warning YELLOW.
    """
    age = (F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros("modified")) / 3.6e9
    one = newest(journals).select(F.col("name").alias("newest_journal"), F.round(age, 1).alias("journal_age_h"))
    two = pending.agg(F.count(F.lit(1)).alias("pending_review"))
    three = last.agg(F.max("status").alias("last_run_status"), F.max("model").alias("last_run_model"))  # of one row or none
    row = one.crossJoin(two).crossJoin(three)  # of three single rows
    hours, status = F.col("journal_age_h"), F.col("last_run_status")
    issue = [
        F.when(F.lit(not ready), "no nightly trigger found"), F.when(F.col("newest_journal").isNull(), "no journal has ever been written"),
        F.when(hours > fail, F.format_string(f"newest journal is %.1fh old (> {fail}h)", hours)),
    ]
    warning = [
        F.when((status != "") & ~status.rlike("(?i)success|ok"), F.concat(F.lit("last run status = "), status)),
        F.when((hours > warn) & (hours <= fail), F.format_string(f"newest journal is %.1fh old (> {warn}h)", hours)),
        F.when(F.col("pending_review") > 0, F.format_string("%d items await review", "pending_review")),
    ]
    return row.select(
        health.verdict(hours, F.col("pending_review"), status, F.lit(ready), warn, fail).alias("verdict"), "journal_age_h", "newest_journal", "last_run_status", "last_run_model", "pending_review",
        F.array_compact(F.array(*issue)).alias("issues"), F.array_compact(F.array(*warning)).alias("warnings"),
    )


def status(spark: SparkSession, config: Config, now: str, trigger: str | None = None, scheduler: str | None = None, next_run: str | None = None, warn: int = health.WARN_HOURS, fail: int = health.FAIL_HOURS) -> DataFrame:
    """The health report's thirteen columns in one row. trigger and scheduler are the states of what starts the run, null where there is none;
    they and next_run are for whoever runs the scheduler to tell."""
    place = Folders(config)
    last = ledger.last_run(runs_table(spark, place.ledger).read(tolerant=True))
    found = problems(list_files(spark, place.journal, "*.md"), list_files(spark, place.review, "*.md"), last, now, bool(trigger or scheduler), warn, fail)
    mark = (get_json(spark, place.state) or {}).get("last_run_utc")
    text = lambda x: F.lit(x).cast("string")
    items = items_table(spark, place.ledger).read(tolerant=True).agg(F.count(F.lit(1)).alias("ledger_items"))
    return found.crossJoin(items).select(  # of two single rows
        "verdict", "journal_age_h", "newest_journal", "last_run_status", "last_run_model", "ledger_items", text(mark).alias("watermark"), text(trigger).alias("trigger_task"), text(scheduler).alias("trigger_scheduler"),
        text(next_run).alias("next_run"), "pending_review", "issues", "warnings",
    )
