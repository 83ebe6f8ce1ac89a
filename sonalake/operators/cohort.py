"""Cohorts: label groups, leak guards, class caps, balance, age, and pruning of features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cleanse import mapped, nan_to_null


def hash_order(key: Column | str, seed: int) -> list[Column]:
    """A reproducible shuffle: md5 of seed and key, then the key; the same in any engine."""
    key = F.col(key) if isinstance(key, str) else key
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), key]


def hash_ranked(df: DataFrame, key: Column | str, seed: int, label: Column | None = None, rank: str = "hash_rank", size: str = "hash_size") -> DataFrame:
    """df with each row's place in hash order, from 1, within its label, and the label's rows.

    Rows are ranked within 65536 slices of the hash, and from the sum of the
    slices before: neither a label nor the table is sorted in one task.
    """
    label = F.lit(0) if label is None else label
    order = hash_order(key, seed)
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), label.alias("label"), F.substring(order[0], 1, 4).alias("slice"), *(o.alias(f"o{i}") for i, o in enumerate(order)))
    before = Window.partitionBy("label").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    counts = rows.groupBy("label", "slice").agg(F.count(F.lit(1)).alias("c"))
    base = counts.select(F.col("label").alias("of"), F.col("slice").alias("at"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.sum("c").over(Window.partitionBy("label")).alias("all"))
    inside = rows.withColumn("inside", F.row_number().over(Window.partitionBy("label", "slice").orderBy("o0", "o1")))
    found = inside.join(base, F.col("label").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at")))
    return found.select("row.*", (F.col("inside") + F.col("base")).cast("long").alias(rank), F.col("all").cast("long").alias(size))


def with_status(df: DataFrame, allowed: Mapping[str, Sequence[str]], null_ok: bool = False) -> DataFrame:
    """Rows whose status columns have allowed values; null counts as allowed if null_ok."""
    for column, values in allowed.items():
        fine = F.col(column).isin(*values)
        df = df.where(fine | F.col(column).isNull() if null_ok else fine)
    return df


def target_keep(label: str, groups: Mapping[str, str]) -> Column:
    return mapped(label, groups)


def target_drop(df: DataFrame, label: str, groups: Mapping[str, str], healthy: Column, name: str = "target") -> DataFrame:
    """Healthy rows are "healthy"; others get their group, and go where there is none."""
    group = F.when(healthy, "healthy").otherwise(F.element_at(F.create_map(*(F.lit(x) for kv in groups.items() for x in kv)), F.col(label)))
    return df.withColumn(name, group).where(F.col(name).isNotNull())


def target_other(label: str, groups: Mapping[str, str]) -> Column:
    return mapped(label, groups, F.lit("Other"))


def drop_mixed(df: DataFrame, ident: str, label: str) -> DataFrame:
    """Without ids that have rows of more than one label."""
    mixed = df.groupBy(ident).agg(F.countDistinct(label).alias("labels")).where("labels > 1").select(ident)
    return df.join(mixed, ident, "left_anti")


def drop_small(df: DataFrame, label: str, least: int) -> DataFrame:
    """Without classes of fewer rows than least; counts are joined, so a large class never meets in one task."""
    fine = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_rows")).where(F.col("class_rows") >= least).select(label)
    return df.join(fine, label, "left_semi")


def capped(df: DataFrame, label: str, key: str, most: int | None, seed: int, exempt: Column | None = None) -> DataFrame:
    """At most `most` rows of each class in hash order; null labels are a class, exempt rows all stay, None caps nothing.

    A first cap within 64 slices of the hash leaves few rows for the second, so
    no class is sorted as a whole in one task.
    """
    if most is None:
        return df
    if most <= 0:
        raise ValueError("a cap must be positive")
    slice_of = F.pmod(F.xxhash64(key), F.lit(64))
    order = hash_order(key, seed)
    first = F.row_number().over(Window.partitionBy(label, slice_of).orderBy(*order))
    last = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    pool = df if exempt is None else df.where(~F.coalesce(exempt, F.lit(False)))
    kept = pool.withColumn("cap_rank", first).where(F.col("cap_rank") <= most).withColumn("cap_rank", last).where(F.col("cap_rank") <= most).drop("cap_rank")
    return kept if exempt is None else df.where(F.coalesce(exempt, F.lit(False))).unionByName(kept)


def balanced(df: DataFrame, healthy: Column, key: str, seed: int) -> DataFrame:
    """Healthy rows cut to the number of others, in hash order; if either side is empty or healthy is smaller, nothing changes.

    Where it is unknown whether a row is healthy, it counts as one of the others.
    """
    healthy = F.coalesce(healthy, F.lit(False))
    counts = df.agg(F.count_if(healthy).alias("h"), F.count_if(~healthy).alias("p")).first()
    if not counts["h"] or not counts["p"] or counts["h"] <= counts["p"]:
        return df
    kept = hash_ranked(df.where(healthy), key, seed).where(F.col("hash_rank") <= counts["p"]).drop("hash_rank", "hash_size")
    return kept.unionByName(df.where(~healthy))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """first, second, r for each pair of columns over rows where both have values, all in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(nan_to_null(a), nan_to_null(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("p")).select("p.*")


def collinear(df: DataFrame, columns: Sequence[str], limit: float) -> list[str]:
    """The later column of every pair with |r| over the limit, dropped ones' pairs included."""
    found = {r["second"] for r in correlations(df, columns).where(F.abs("r") > limit).collect()}  # one row a pair of columns
    return [c for c in columns if c in found]


def feature_columns(df: DataFrame, prefixes: Sequence[str], exclude: str | None = None) -> list[str]:
    """Allow-listed by prefix, never by type: labels and flags can't slip in."""
    import re

    return [c for c in df.columns if c.startswith(tuple(prefixes)) and not (exclude and re.search(exclude, c))]
