"""Exact duplicates by a heavy-hitter split.

Misra-Gries summaries of the digests, one per task, are merged by sums. With k
counters each, a digest of more than 2N/(k+1) of N rows always has a merged
count over N/(k+1), and at most k digests can have one. These are counted
exactly; the winners, at most k rows, are broadcast and joined map-side. Only
the other digests, each with few rows, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, one_each, packed, without, written

#: Counters of each summary, hence the most rows that are broadcast.
COUNTERS = 2048


def normalised(text: Column) -> Column:
    """The text that is compared: runs of white space become one space, null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def misra_gries(summary: dict[bytes, int], items: pd.Series, counters: int) -> dict[bytes, int]:
    """The summary with the items added: sums, less the (counters+1)-th largest, positive ones stay."""
    counts = items.value_counts()
    if summary:
        counts = counts.add(pd.Series(summary, dtype="int64"), fill_value=0).astype("int64")
    if len(counts) > counters:
        over = int(np.partition(counts.to_numpy(), len(counts) - counters - 1)[len(counts) - counters - 1])
        counts = counts[counts > over] - over
    return dict(zip(counts.index, counts.to_numpy().tolist(), strict=True))


def summaries(digests: DataFrame, counters: int) -> DataFrame:
    """(digest, n): each task's summary, and one row with a null digest and the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: dict[bytes, int] = {}
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            summary = misra_gries(summary, batch.column(0).to_pandas(), counters)
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array([None, *summary], pa.binary()), "n": pa.array([rows, *summary.values()], pa.int64())}
        )

    return digests.select("digest").mapInArrow(run, "digest binary, n long")


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` digests, among them all of more than 2N/(counters+1) of the N rows."""
    merged = written(summaries(digests, counters).groupBy("digest").agg(F.sum("n").alias("n")), "heavy")
    rows = merged.where("digest IS NULL").agg(F.sum("n")).first()[0] or 0
    return merged.where(F.col("digest").isNotNull() & (F.col("n") > rows / (counters + 1))).select("digest")


def exact_groups(documents: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of documents(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group; null text is empty text. keep_id is the smallest
    doc_id of the group. A row without doc_id never stays for one that has an
    id; if none has, keep_id is null and all stay. Rows that repeat both id and
    text are one document: each counts in group_size, and all say kept.
    """
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    rows = written(documents.select("doc_id", digest.alias("digest")), "digests")
    heavy = F.broadcast(heavy_digests(rows, counters))
    best = (F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = F.broadcast(rows.join(heavy, "digest", "left_semi").groupBy("digest").agg(*best))
    split = rows.join(winners, "digest", "left")
    done = split.where("group_size IS NOT NULL")
    rest = split.where("group_size IS NULL").select("doc_id", "digest")
    rest = rest.join(rest.groupBy("digest").agg(*best), "digest")  # sums before the shuffle; a join of many rows can be split
    columns = ("doc_id", "digest", "keep_id", "group_size")
    return done.select(*columns).union(rest.select(*columns)).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.expr("doc_id <=> keep_id").alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(documents: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of documents that stay, with all their columns, whatever their names; exact_groups() says what null ids do.

    Of rows that repeat both doc_id and text one stays. An empty table stays empty.
    """
    groups = written(exact_groups(documents, counters), "groups")
    lost = written(groups.where("NOT kept").select("doc_id", "text_sha256").distinct(), "lost")
    row = packed(documents, F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    left = without(row, lost, ["doc_id", "text_sha256"])
    return one_each(left, groups.where("kept").select("doc_id", "text_sha256"), ["doc_id", "text_sha256"]).select("row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
