"""A training corpus from documents, stage by stage; each stage is written and read again.

Toxic documents go, of exact and of near duplicates one row stays, sources are
mixed to their target weights, and what is left is encoded. The mix takes each
document once at most, so no stage makes copies again: targets share SHARE of
all words by weight and stop at the size of their source. Both are half of what
op5_mixing takes, so each source's target is half of its target there: the
proportions are the same.

In every stage null text counts as empty, an empty table stays empty, rows may
have further columns of any name, which all stages but the last keep, and texts
are taken whole. Before each stage the executors give back the memory that the
one before has left. A null doc_id is judged like any other; rows that repeat both
doc_id and text leave the second stage as one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonalake.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from sonalake.llm.common import collected, written

#: Half of op5_mixing's share, as each document is taken once instead of twice.
SHARE = mixing.SHARE / 2


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half, by a model of the labelled rows outside its held-out fold; ties don't occur, equal texts score alike."""
    collected(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id."""
    collected(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row whose doc_id names it; documents without words stay."""
    collected(spark)
    return near_dedup.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by hash thresholds of their sources, each once at most; documents without words aren't taken."""
    collected(spark)
    return mixing.mixed_rows(docs, share=SHARE, repeat=mixing.REPEAT / 2)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the ids, the ids, and the digest of the text decoded again, one row for each row."""
    collected(spark)
    return bpe.encode_table(docs, bpe.tokenizer_path(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: The stages fit a model and walk trees, which SQL lacks; the tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
