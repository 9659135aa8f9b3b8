"""Line dedup: three-line windows that occur before are removed, overlapping ones merged. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _covers(docs: DataFrame, window: int) -> DataFrame:
    """of_doc, of_key, starts: where later occurrences of repeated windows start, for each (doc_id, text) of docs that has any.

    Only hashes and places are shuffled; lines are split where the texts are read."""
    lines = F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(_lines(F.col("text")))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), lines.alias("lines"))
    last = F.size("lines") - window
    parts = lambda i, order: [F.get("lines", i + k) for k in order]
    keys = F.transform(
        F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(*parts(i, range(window))).alias("a"), F.xxhash64(F.lit(window), *parts(i, reversed(range(window)))).alias("b")),
    )
    windows = base.select("doc_id", "text_key", F.posexplode(keys).alias("line", "key")).select("doc_id", "text_key", "line", "key.a", "key.b")
    place = F.struct("doc_id", "line")
    repeated = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    repeated = materialize(repeated.select("a", "b", "first"))  # as a table, its hot keys can be split in the join below
    covers = windows.join(repeated, ["a", "b"]).where(place > F.col("first"))
    return covers.groupBy(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_key")).agg(F.collect_set("line").alias("starts"))


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """row (doc_id, text and whatever else docs has, as a struct, so that no name can clash), n_lines, n_removed, kept.

    Places are joined to the rows before lines are split again, so that texts move once and alone; the places are the side that is
    looked up, so that no text is sorted."""
    rows = docs.select(F.struct("*").alias("row"))
    id_, text = F.col("row.doc_id"), F.col("row.text")
    covers = _covers(docs.select("doc_id", "text"), window)
    joined = rows.join(covers.hint("shuffle_hash"), id_.eqNullSafe(F.col("of_doc")) & (F.xxhash64(text) == F.col("of_key")), "left")
    split = joined.select("row", "starts", F.when(F.col("starts").isNotNull(), _lines(text)).alias("lines"))
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (window - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    marked = split.select("row", "lines", F.when(F.col("starts").isNotNull(), left).alias("left"))
    kept = F.when(F.col("left").isNull(), text).otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
    n = F.when(text.isNull(), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    gone = F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("left"))
    return marked.select("row", n.cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, window: int = 3) -> DataFrame:
    """Remove every line that a later occurrence of a repeated window covers.

    Lines are what newlines separate; a window is `window` consecutive lines of one text. Windows are compared over all texts by
    128 bits of hash; the first occurrence, by (doc_id, line), stays and each later one covers its lines. Windows are judged on
    the input, and what overlapping windows cover is removed once.

    Returns doc_id, n_lines, n_removed (long), kept (the lines left, joined by newlines; null for a null text) for each row.
    A null text has no lines. A text of fewer lines than a window has none to lose. A null doc_id comes first. Rows of equal
    doc_id and text are one place: they are treated alike. A very long text is one row, split in one task; of it only hashes and
    places are shuffled before its own row is. No rows give no rows. Other columns of docs are not looked at.
    """
    return _cut(docs.select("doc_id", "text"), window).select("row.doc_id", "n_lines", "n_removed", "kept")


def without_repeats(docs: DataFrame, window: int = 3) -> DataFrame:
    """docs, all rows and columns, with text as dedup_lines leaves it and n_chars, if there is one, as long as that is.

    Nulls, short and long texts, ties and repeated rows are as dedup_lines has them: a null text stays null, with an n_chars of null.
    Columns of docs may have any names; they are carried as they are. No rows give no rows.
    """
    cut = _cut(docs, window)
    new = {"text": F.col("kept").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def digest(result: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of what dedup_lines returns (null: empty)."""
    return result.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH base AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
n AS (SELECT doc_id, text, l, unnest(range(1, len(l) - 1)) AS i FROM base WHERE len(l) >= 3),
w AS (SELECT doc_id, i, [l[i], l[i + 1], l[i + 2]] AS k FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM w),
c AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM r WHERE nth > 1),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM base),
k AS (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY x.i) FILTER (c.i IS NULL) AS kept, count(c.i) AS n_removed
      FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT b.doc_id, CASE WHEN b.text IS NULL THEN 0 ELSE len(b.l) END::BIGINT AS n_lines, k.n_removed::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM base b JOIN k ON b.doc_id = k.doc_id
"""
