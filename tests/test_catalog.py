"""Every query of the catalog against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import columns
from lodestrata.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    show = lambda v: "null" if pd.api.types.is_scalar(v) and pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


def number(rows):
    """Whole numbers alike, whether a null has made floats of them."""
    return [tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in rows]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert number(plain(got)) == number(plain(want))


def test_entry_points_agree(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", ["status_changes", "proposals_made", "frontmatter_parse", "set_status", "order_written", "receipts_read", "replay_filter"])
def test_fingerprints_of_texts_are_made_once(spark, name):
    """They are dear, so what is left to run has none of them, but reads those that were written."""
    left = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z0-9 ]" not in left


def test_order_makes_fingerprints_of_rejected_texts_once(spark):
    left = catalog._order(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z0-9 ]" not in left


def test_fingerprint_is_that_of_the_plain_expression(spark):
    odd = [None, "", "  ", "\n", "AİB \U0001f600c\U0001f600", "...", "a.b.c", "é à ü ab", "z \n", "abc\n", "$1 \\1", "x" * 50_000]
    rows = spark.createDataFrame([(x,) for x in odd], "text string")
    collapsed = F.lower(F.trim(F.regexp_replace("text", rf"{columns._BLANK}++", " ")))
    plain = F.substring(F.sha1(F.regexp_replace(collapsed, "[^a-z0-9 ]++", "").cast("binary")), 1, 16)
    assert rows.where(~plain.eqNullSafe(columns.fingerprint(F.col("text")))).isEmpty()
