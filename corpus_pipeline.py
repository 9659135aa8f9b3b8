"""From documents to encoded training text, stage by stage.

Every stage takes empty tables, repeated rows, texts of any length and columns of any names besides doc_id and text, as its operator
states; all but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import bpe, decontamination, line_dedup, near_dedup, toxicity
from lodestrata.llm.shared import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled ones doesn't call toxic. Null and empty texts are scored as empty ones; without labels all stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat three-line windows of earlier ones. A null text stays null; a text may become empty."""
    return line_dedup.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id. Texts without words, and rows without a doc_id, stay."""
    return near_dedup.keep_one_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents fewer than a twentieth of whose words are in passages of the benchmark. Null and empty texts stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded of the texts that are left; of a null or empty text no ids and an empty string."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated), ("BPE", encode),
]
#: Neither the toxicity model nor BPE can be expressed in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; what each but the last leaves is written as Parquet, and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
