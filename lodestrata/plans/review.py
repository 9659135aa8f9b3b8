"""Approving and rejecting proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.written import written
from ..sources.proposals import parse_proposals, read_proposals, select_proposals
from ..sources.text_files import delete_files
from .nightly import finish


def _found(spark: SparkSession, path: str, selector: dict) -> DataFrame:
    every = parse_proposals(read_proposals(spark, path))
    return select_proposals(every, **selector) if selector else every


def chosen(spark: SparkSession, path: str, **selector) -> DataFrame:
    """Proposals of a folder, by slug, file or everything; raises LookupError where a selector fits none. Without one, all are listed."""
    found = _found(spark, path, selector)
    if selector and found.isEmpty():
        raise LookupError(f"no proposal fits {selector}")
    return found.orderBy("name")


def decide(spark: SparkSession, folder: str, path: str, status: str, now: str, dry_run: bool = False, **selector) -> list[str]:
    """Give the chosen proposals' claims a status (applied: approved; rejected: never to come up again), then have tasks delete the files.

    Returns the files' names. Without a selector nothing is decided. The registry is written first, so that a failure leaves the
    proposals where they are; a file without a fingerprint is only deleted.
    """
    if not selector:
        return []
    found = written(_found(spark, path, selector).select("name", "fingerprint"))  # files are opened once
    names = sorted(r["name"] for r in found.select("name").collect())
    if not names:
        raise LookupError(f"no proposal fits {selector}")
    if not dry_run:
        changes = found.where("fingerprint IS NOT NULL").select("fingerprint", F.lit(status).alias("status"), F.lit(1).alias("ord"))
        finish(spark, folder, changes, now)
        delete_files(found.select("name"), path)
    return names
