"""Evaluation as aggregates: confusion, macro metrics, thresholds, votes of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def normalised(cells: DataFrame) -> DataFrame:
    """Cells over the sum of their row of truth, at least 1."""
    row = F.sum("n").over(Window.partitionBy("truth"))
    return cells.withColumn("share", F.col("n") / F.greatest(row, F.lit(1)))


def class_report(cells: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support of each class that is true or guessed; nothing over nothing is 0."""
    t = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    p = cells.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("guessed"))
    hit = cells.where("truth = guess").select(F.col("truth").alias("label"), F.col("n").alias("hits"))
    all_ = t.join(p, "label", "full_outer").join(hit, "label", "left").fillna(0, ["support", "guessed", "hits"])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(a / b)

    hits, support, guessed = F.col("hits"), F.col("support"), F.col("guessed")
    return all_.select("label", ratio(hits, guessed).alias("precision"), ratio(hits, support).alias("recall"), ratio(2 * hits, support + guessed).alias("f1"), "support", "hits")


def macro_metrics(cells: DataFrame) -> DataFrame:
    """accuracy, balanced accuracy (mean recall of true classes), macro F1 (over all classes)."""
    return class_report(cells).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("f1_macro"),
    )


def threshold_sweep(df: DataFrame, truth: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """threshold, accuracy, balanced_accuracy, f1_macro: rows meet the few thresholds before one aggregation."""
    each = df.select(F.col(truth).cast("int").alias("y"), F.col(score).alias("p")).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    guess = F.col("p") >= F.col("threshold")
    c = each.groupBy("threshold").agg(
        F.count_if((F.col("y") == 1) & guess).alias("tp"),
        F.count_if((F.col("y") == 0) & guess).alias("fp"),
        F.count_if((F.col("y") == 1) & ~guess).alias("fn"),
        F.count_if((F.col("y") == 0) & ~guess).alias("tn"),
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    half = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select(
        "threshold",
        ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
        ((half(tp, tp + fn) + half(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        ((half(2 * tp, 2 * tp + fp + fn) + half(2 * tn, 2 * tn + fp + fn)) / 2).alias("f1_macro"),
    )


def best_threshold(sweep: DataFrame, objective: str = "balanced_accuracy") -> DataFrame:
    """The first threshold of the highest score."""
    return sweep.orderBy(F.desc(F.round(objective, 9)), "threshold").limit(1)


def vote(df: DataFrame, group: str, guess: str, truth: str) -> DataFrame:
    """Each group's most frequent guess and truth, ties to the least."""
    return df.groupBy(group).agg(F.mode(guess, True).alias("guess"), F.mode(truth, True).alias("truth"))


def mean_probability(df: DataFrame, group: str, scores: Sequence[str], truth: str) -> DataFrame:
    """Each group's mean of class probabilities, the class of the largest (first of ties), and its most frequent truth."""
    means = df.groupBy(group).agg(*(F.avg(s).alias(s) for s in scores), F.mode(truth, True).alias("truth"))
    listed = F.array(*(F.round(s, 9) for s in scores))
    return means.withColumn("guess", (F.array_position(listed, F.array_max(listed)) - 1).cast("long"))


def report_averages(report: DataFrame) -> DataFrame:
    """The macro and the weighted average of a class report, as two rows."""
    names = ("precision", "recall", "f1")
    macro = report.agg(F.lit("macro avg").alias("label"), *(F.avg(c).alias(c) for c in names), F.sum("support").alias("support"))
    weighted = report.agg(F.lit("weighted avg").alias("label"), *((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names), F.sum("support").alias("support"))
    return macro.unionByName(weighted)
