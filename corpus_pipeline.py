"""Corpus pipeline: documents without toxic, repeated and contaminated ones, secrets masked, packed into sequences.

Every stage takes rows with null ids or texts, empty and very long texts, repeated rows and further columns, and
an empty table; what it does with them is said below and in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlab.llm import decontaminate, packing, secrets, simhash, toxicity
from pairlab.llm.common import materialise, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic; learned from those whose labels are open to training.

    A null or empty text is scored as a text without any known word. Without a confirmed toxic document all stay.
    """
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (op9's rule: four words, four bits) the document of the smallest id, once.

    Rows without an id all stay. Wordless texts, null or empty, are copies of each other. Rows of one id with
    different texts are different documents.
    """
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any benchmark window. Wordless texts have none and stay; so do repeated rows."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; a null text stays null, repeated rows stay."""
    return secrets.mask_secrets(docs, secrets.train(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their place in a sequence; a null or empty text is one piece, the end id."""
    return packing.pack_documents(docs).drop("certified")


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL expresses neither the classifiers nor the packing; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written as Parquet and read by the next.

    The rows are op3's pieces of what the stages kept, `certified` left out. Nulls, empty and long texts, repeated rows
    and an empty table are told at the stages; without documents there are no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
