"""A training corpus from ``documents``: five stages, each one operator of spanloom.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns the columns of ``documents``; the last returns tokens. Null ids, texts and sources,
empty tables, ties, repeated rows and extra columns have the results that the operators'
docstrings define. Near-duplicates here are documents whose five-word shingles have a
similarity of at least 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, mixing, neardup, pii, quality
from spanloom.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half."""
    docs = docs.select(*COLUMNS)
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter(F.col("__score") >= 0.5).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return neardup.deduplicated(docs.select(*COLUMNS), width=5, percent=80, coords=48, match=24)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind; lengths follow."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document stands as often as the mix takes it."""
    return mixing.emit(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, for training."""
    made = bpe.encode(docs.select(*COLUMNS), keep=["doc_id", "source"])
    return made.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", good_enough),
    ("near-duplicates", one_of_each),
    ("personal data", without_personal_data),
    ("mix", mixed),
    ("tokens", tokens),
]

#: Learned scores, MinHash and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
