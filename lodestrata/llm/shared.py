"""What the operators need from the session: tables, the shared folder, labels' split."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir or the context names it. Where neither does, a temporary one
    will do if driver and executors are one process (tests); on a cluster that is an error, as nobody else could read it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, by: str | None = None, **options) -> DataFrame:
    """Write df as a table in the shared folder, in parts by the values of a column if asked for, and read it back: lineage is cut, and a
    lost executor costs no rework. Options are the Parquet writer's."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


@contextlib.contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Within it each query's shuffle files are deleted when it has ended, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Tables that only later tables are made from, deleted when these are there."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, by: str | None = None, **options) -> DataFrame:
        out = materialize(df, by, **options)
        self.paths += [out.written_to]
        return out

    def clear(self) -> None:
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; 0 (held out) for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))
