"""Splits and folds that keep each group on one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cohort import hash_ranked


def group_split(df: DataFrame, group: str, test: float, val: float, seed: int) -> DataFrame:
    """One row a group: group, split. Shares are of groups: the first ceil(test G) in hash order, then val of all likewise."""
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    total = groups.count()
    n_test = -(-round(test * total * 1e9) // 10**9)
    n_val = min(total - n_test, -(-round(val * total * 1e9) // 10**9))
    name = F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_val, "val").otherwise("train")
    return hash_ranked(groups, group, seed, rank="rank").select(group, name.alias("split"))


def group_folds(df: DataFrame, group: str, label: str, folds: int, seed: int) -> DataFrame:
    """One row a group: group, label (its most frequent, ties to the least), fold. Near-stratified: groups are dealt out label by label."""
    majority = df.groupBy(group).agg(F.mode(label, True).alias("label"))
    return hash_ranked(majority, group, seed, F.col("label")).select(group, "label", ((F.col("hash_rank") - 1) % folds).cast("long").alias("fold"))


def holdout(df: DataFrame, key: str, label: str, share: float, seed: int) -> DataFrame:
    """df with held_out: the first ceil(share n) rows of each class in hash order."""
    ranked = hash_ranked(df, key, seed, F.col(label))
    return ranked.withColumn("held_out", F.col("hash_rank") <= F.ceil(F.col("hash_size") * share)).drop("hash_rank", "hash_size")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight = rows / (classes * n)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    return counts.select(label, "n", (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def mapped_split(df: DataFrame, table: DataFrame, group: str, default: str = "train") -> DataFrame:
    """df with the split of its group; groups that the table lacks get the default."""
    return df.join(table.select(group, "split"), group, "left").withColumn("split", F.coalesce("split", F.lit(default)))


def split_leaks(df: DataFrame, group: str, split: Column | str = "split") -> DataFrame:
    """Groups that are on more than one side; empty for a proper split."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")
