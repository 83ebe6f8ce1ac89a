"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash of its id and text; rows that repeat both are
numbered, so that each has a hash of its own. Sizes are summed by source and leading hash
bits; in these histograms the budget of a source falls into one bucket. Only
the documents of that boundary bucket are summed again, by their next bits,
until it holds one hash. The mix is then a filter on the hash: no sort, no
shuffle of documents, and a larger budget always takes a superset.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEY_ROWS, WORD, sized, written

WEIGHTS, SHARE, REPEAT = (3.0, 1.0, 2.0), 1.5, 2.0
HASH_BITS, LEVEL_BITS = 60, 10
#: Sources whose row in the plan of the mix is broadcast at most; more are joined by a salted shuffle.
SOURCE_ROWS = 100_000
SALTS = 32


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hash60(key: Column) -> Column:
    """The first 15 hex digits of md5, the same in every engine."""
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


KEY = ["doc_id", "source", "digest"]


def repeated(rows: DataFrame) -> DataFrame:
    """The keys that several of rows(doc_id, source, digest) share."""
    return written(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY), "repeated")


def hashed(rows: DataFrame, again: DataFrame) -> DataFrame:
    """rows(doc_id, source, digest, ...) with hash: of id, text, and the row's number among those that share both.

    Rows of one key are alike, so it doesn't matter which has which number.
    They are counted within each of their partitions first, and numbered from
    the sum of those before: no task gathers a key's rows.
    """
    numbered = rows.withColumn("nth", F.lit(0).cast("long"))
    if not again.isEmpty():
        other = again.select(*(F.col(c).alias(f"key_{c}") for c in KEY))
        same = reduce(and_, (rows[c].eqNullSafe(other[f"key_{c}"]) for c in KEY))
        other = sized(other, again.count(), KEY_ROWS)
        some = written(rows.join(other, same, "left_semi").withColumn("part", F.spark_partition_id()), "repeats")
        counts = some.groupBy(*KEY, "part").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(*(F.col(c).alias(f"key_{c}") for c in KEY), F.col("part").alias("key_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        here = reduce(and_, (some[c].eqNullSafe(counts[f"key_{c}"]) for c in [*KEY, "part"]))
        inside = F.row_number().over(Window.partitionBy(*KEY, "part").orderBy(F.lit(0))) - 1
        some = some.withColumn("inside", inside).join(counts, here).withColumn("nth", (F.col("inside") + F.col("base")).cast("long"))
        numbered = numbered.join(other, same, "left_anti").unionByName(some.select(*numbered.columns))
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", "nth")
    return numbered.withColumn("hash", hash60(key)).drop("nth")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size) with place, from 0 by code point, null last: sorted in ranges, numbered within each."""
    ranges = written(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    before, total = [], 0
    for r in ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row for each range
        before.append((r["part"], total))
        total += r["n"]
    base = sizes.sparkSession.createDataFrame(before, "part int, base long")
    return ranges.withColumn("inside", inside).join(F.broadcast(base), "part").select("source", "source_size", (F.col("inside") + F.col("base")).alias("place"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeat: float) -> DataFrame:
    """sizes(source, source_size) with target: share of all sizes by weight, at most repeat times the source's size.

    Filled up like water: with level t, a source gets min(repeat * size,
    weight * t). Each round fixes the sources whose cap lies below the level
    and raises it for the rest, by two sums; it ends when none is added.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    plan = written(ranked_sources(sizes).select("source", "source_size", weight.alias("weight")), "sources")
    cap = F.col("source_size") * repeat
    total, level, fixed = None, 0.0, -1
    while True:
        below = cap <= F.col("weight") * level if total is not None else F.lit(False)
        got = plan.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(below, cap)).alias("capped"),
            F.sum(F.when(~below, F.col("weight"))).alias("open"),
            F.count_if(below).alias("fixed"),
        ).first()
        total = (got["total"] or 0) * min(share, repeat)
        if not got["open"] or got["fixed"] == fixed:
            break
        level, fixed = (total - (got["capped"] or 0)) / got["open"], got["fixed"]
    return plan.select("source", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def thresholds(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with copies (whole repeats of all) and below: documents of a source with a smaller hash are taken once more."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("copies", copies).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    edge = written(plan.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").cast("double").alias("left")), "edge0")
    inside = documents.where("size > 0").select("source", "size", "hash", F.lit(0).cast("long").alias("prefix"))
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        e, d = edge.select("source", "prefix", "left").alias("e"), inside.alias("d")
        if level:
            d = inside.withColumn("prefix", F.shiftright("hash", shift + LEVEL_BITS)).alias("d")
        bins = d.groupBy("source", "prefix", F.shiftright("hash", shift).alias("bin")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs"))
        if level:
            same = F.col("b.source").eqNullSafe(F.col("e.source")) & (F.col("b.prefix") == F.col("e.prefix"))
            bins = bins.alias("b").join(e, same, "left_semi")
        order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # 1024 bins at most
        bins = bins.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
        here = bins.alias("b").join(e, F.col("b.source").eqNullSafe(F.col("e.source"))).where("before <= left AND before + size > left")
        found = here.select("b.source", F.col("b.bin").alias("prefix"), (F.col("left") - F.col("before")).alias("left"), "b.size", "docs")
        rest = e.join(found.select(F.col("source").alias("s")), F.col("e.source").eqNullSafe(F.col("s")), "left_anti")
        # A source without a boundary bucket here takes all documents of its prefix: the next prefix, and nothing left.
        kept = rest.select("source", F.shiftleft(F.col("prefix") + 1, LEVEL_BITS).alias("prefix"), F.lit(0.0).alias("left"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("docs"))
        edge = written(found.union(kept), f"edge{level + 1}")
        if level + 1 < HASH_BITS // LEVEL_BITS and edge.where("docs > 1 AND left > 0").isEmpty():
            break
    # What is left in the boundary bucket: take it if that comes nearer to the target than leaving it.
    below = F.shiftleft(F.col("prefix") + F.when((F.col("size") > 0) & (F.col("left") * 2 >= F.col("size")), 1).otherwise(0), shift)
    last = edge.select(F.col("source").alias("s"), below.alias("below"))
    joined = plan.join(last, plan["source"].eqNullSafe(last["s"]), "left")
    return written(joined.select("source", "source_size", "target", "copies", F.coalesce("below", F.lit(0)).alias("below")), "plan")


def sized_rows(documents: DataFrame, *more: Column) -> DataFrame:
    return documents.select(*more, "doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def planned(documents: DataFrame, weights: tuple[float, ...], share: float, repeat: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes and hashes of documents, the keys that rows share, and each source's plan."""
    sizes = written(sized_rows(documents), "sizes")
    again = repeated(sizes)
    sizes = hashed(sizes, again).drop("digest")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sizes, again, thresholds(sizes, source_targets(per_source, weights, share, repeat))


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(source, hash, ...) with the plan of their source: broadcast if it has few sources, else joined by source and a part of the hash."""
    plan = plan.withColumnRenamed("source", "plan_source")
    same = rows["source"].eqNullSafe(F.col("plan_source"))
    if plan.count() <= SOURCE_ROWS:
        return rows.join(F.broadcast(plan), same)
    salted = plan.withColumn("plan_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, same & (rows["hash"] % SALTS == F.col("plan_salt")))


def copies_taken() -> Column:
    """How often the mix takes a document, from its size and hash and its source's plan."""
    return F.when(F.col("size") > 0, F.col("copies") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)).otherwise(0)


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """documents(doc_id, text, source) with size, source_size, target and taken, one row per row.

    Null text has size 0 and null is a source of its own, last in order; rows
    without words take nothing. Rows that repeat a doc_id, or have none, are
    taken apart, those that repeat the text as well too. A source misses its
    target by half a document at most. An empty table gives no rows; other
    columns don't matter.
    """
    sizes, _, plan = planned(documents, weights, share, repeat)
    taken = (F.col("size") * copies_taken()).cast("long").alias("taken")
    return with_plan(sizes, plan).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken)


def mixed_rows(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """The documents that mix() takes, each as often as it is taken, with all their columns, whatever their names."""
    _, again, plan = planned(documents, weights, share, repeat)
    rows = hashed(sized_rows(documents, F.struct(*(documents[c] for c in documents.columns)).alias("row")), again)
    taken = with_plan(rows, plan).select("row", copies_taken().cast("int").alias("times")).where("times > 0")
    if repeat > 1:
        taken = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return taken.select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same mix by sorting: running sums in hash order, and the boundary document by the nearer side.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')),
                                       row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1)), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, 2 * source_size AS cap, 1.5 * sum(source_size) OVER () AS total,
         coalesce(sum(2 * source_size) OVER before, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open
  FROM s WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((total - capped) / open) AS level FROM f),
p AS (
  SELECT source, source_size, least(cap, weight * coalesce(level, 1e300)) AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap, weight * coalesce(level, 1e300)) / source_size) ELSE 0 END AS copies
  FROM f, l),
r AS (
  SELECT d.*, p.source_size, p.target, p.copies, p.target - p.copies * p.source_size AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY hash, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (size * (copies + CASE WHEN before + size <= budget OR (before <= budget AND 2 * (budget - before) >= size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
