"""A learned classifier: multinomial naive Bayes, trained by sharded counts of words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ACTIVE_WORK, REVIEW
from .classify import Classifier, classify_rules
from .written import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
SMOOTHING = 1.0


@dataclass
class Model:
    """word, weight (what one occurrence adds to the log odds), and the log odds of a text without known words."""

    weights: DataFrame
    bias: float


def words(text: Column) -> Column:
    """Runs of digits, letters in lower case and whatever isn't ASCII; none of a null text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def train(texts: DataFrame, smoothing: float = SMOOTHING) -> Model:
    """The model of texts (text, label: 1 or 0, others are passed over).

    Words are counted by label in each task before they are shuffled, so that a frequent word is a row a task; only the two labels' sums come to the
    driver. A label that no text has counts as one with no words, and half a text. Without texts all weights and odds are even.
    """
    known = texts.where(F.col("label").isin(0, 1)).select("label", words(F.col("text")).alias("words"))
    n = known.agg(F.count_if(F.col("label") == 1).alias("of_one"), F.count_if(F.col("label") == 0).alias("of_none")).first()
    each = known.select("label", F.explode("words").alias("word"))
    counts = written(each.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("one"), F.count_if(F.col("label") == 0).alias("none")))
    sums = counts.agg(F.coalesce(F.sum("one"), F.lit(0)).alias("one"), F.coalesce(F.sum("none"), F.lit(0)).alias("none"), F.count(F.lit(1)).alias("words")).first()
    share = lambda c, total: F.log((F.col(c) + smoothing) / (total + smoothing * sums["words"]))
    weights = written(counts.select("word", (share("one", sums["one"]) - share("none", sums["none"])).alias("weight")))
    odds = texts.sparkSession.range(1).select(F.log(F.lit(max(n["of_one"], 0.5) / max(n["of_none"], 0.5)))).first()[0]
    return Model(weights, odds)


def score(texts: DataFrame, model: Model, key: str = "ord", text: str = "text") -> DataFrame:
    """key, score of each of texts, whose key is unique: the log odds of label 1. Words that no training text has count nothing.

    A text's words are summed up first, so a frequent word is a row a text; its one weight meets them in a join that adaptive execution splits, both sides
    of which are plain shuffles or written."""
    bag = texts.select(key, F.explode(words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("times"))
    sums = written(bag).join(model.weights, "word").groupBy(key).agg(F.sum(F.col("times") * F.col("weight")).alias("sum"))
    return texts.select(key).join(sums, key, "left").select(key, (F.lit(model.bias) + F.coalesce("sum", F.lit(0.0))).alias("score"))


def classify_learned(model: Model) -> Classifier:
    """A classifier in place of classify_rules: passing work is known by its words as there; of what is left, that with even or better odds lasts and the rest is
    dropped."""

    def classify(texts: DataFrame) -> DataFrame:
        texts = written(texts)
        found = classify_rules(texts).join(score(texts, model), "ord")
        horizon = F.when(F.col("horizon") == "short", "short").when(F.col("score") >= 0, "long").otherwise("drop")
        return found.withColumns({"horizon": horizon, "target": F.when(horizon == "short", ACTIVE_WORK).otherwise(REVIEW)}).drop("score")

    return classify
