"""Fan-in joins that can't multiply rows, lookups, and reports on key sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cleanse import first_by


def fan_in(core: DataFrame, sides: Mapping[str, DataFrame], key: str, order: Mapping[str, Sequence[Column]]) -> DataFrame:
    """core with the columns of each side, reduced to one row a key first; a column both have gets the side's name in front."""
    out = core
    for name, side in sides.items():
        single = first_by(side, [key], order[name])
        clash = [c for c in single.columns if c != key and c in out.columns]
        out = out.join(single.withColumnsRenamed({c: f"{name}_{c}" for c in clash}), key, "left")
    return out


def lookup(df: DataFrame, table: DataFrame, key: str, order: Sequence[Column], status: str = "match_status") -> DataFrame:
    """df with the first row of each key of the table, and whether there was one."""
    hit = "lookup_hit"
    while hit in df.columns or hit in table.columns:
        hit += "_"
    found = first_by(table, [key], order).withColumn(hit, F.lit(True))
    return df.join(found, key, "left").withColumn(status, F.when(F.col(hit), "matched").otherwise("missing")).drop(hit)


def pairwise_overlap(members: DataFrame, group: str, ident: str, samples: int = 20) -> DataFrame:
    """Every pair of groups with the number of ids that both have, zeros included, and the first ids."""
    pairs = members.select(group, ident).distinct()
    groups = pairs.select(group).distinct()
    a, b = pairs.alias("a"), pairs.alias("b")
    both = a.join(b, (F.col(f"a.{ident}") == F.col(f"b.{ident}")) & (F.col(f"a.{group}") < F.col(f"b.{group}")))
    counts = both.groupBy(F.col(f"a.{group}").alias("left_group"), F.col(f"b.{group}").alias("right_group")).agg(
        F.count(F.lit(1)).alias("overlap"), F.slice(F.array_sort(F.collect_set(f"a.{ident}")), 1, samples).alias("sample_ids")
    )
    grid = groups.select(F.col(group).alias("left_group")).join(groups.select(F.col(group).alias("right_group")), F.col("left_group") < F.col("right_group"))
    return grid.join(counts, ["left_group", "right_group"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))


def key_set_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, only left, only right, and whether the sets are equal."""
    a = left.select(F.col(key).alias("k")).distinct().withColumn("in_left", F.lit(True))
    b = right.select(F.col(key).alias("k")).distinct().withColumn("in_right", F.lit(True))
    both = F.col("in_left").isNotNull() & F.col("in_right").isNotNull()
    return a.join(b, "k", "full_outer").agg(
        F.count_if(both).alias("n_both"),
        F.count_if(F.col("in_right").isNull()).alias("n_left_only"),
        F.count_if(F.col("in_left").isNull()).alias("n_right_only"),
        F.coalesce(F.bool_and(both), F.lit(True)).alias("equal_sets"),
    )
