"""A corpus pipeline: quality classifier, near-duplicates, benchmark decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; other columns are left out. Empty tables stay empty,
texts of any length count whole, and repeated rows are judged alike (near_duplicates keeps one of them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontam, mixing, neardup, ngramquality, sharding
from tidewright.llm.common import read, written
from tidewright.llm.queries import SHARDS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the Kneser-Ney classifier keeps; each is judged by its own text, null and empty texts are kept."""
    return ngramquality.trusted_like(docs, read(spark, sf_dir, "labels")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts: five-word shingles, similarity 0.8 or more.

    Different texts under one doc_id, or under none, are different documents. Rows without words all stay.
    """
    return neardup.one_of_each(docs, size=5, percent=80).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, in its words or with other slots; each is judged by its own text."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: sources weigh 3, 1, 2 in turn and share 150 % of all words."""
    return mixing.repeat(mixing.mix(docs, keep=COLUMNS)).select(COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed rows with their shard; copies of a document share one, rows without doc_id are placed by their text."""
    return sharding.place(docs, "doc_id", SHARDS, spread="text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: Not expressible: Kneser-Ney training and connected components.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
