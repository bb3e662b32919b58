"""A corpus from documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder and reads it again as the next stage's documents. All but
the last return the columns of ``docs``, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sqlassay.llm import covering, fuzzy_lines, packing, rules, toxicity
from sqlassay.session import landed


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. The lexicon is learned from the labels outside the held-out third."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean_documents(docs, toxicity.learn(docs, labels))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return rules.kept_documents(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the lines that are the first of their kind; one that keeps no line stays as an empty text."""
    return fuzzy_lines.line_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return covering.near_dedup(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its bin and its place there."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("quality rules", of_quality),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_copies),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs


#: A learned lexicon, union-find over fuzzy links and first-come bins are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
