"""Profiles and reports."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cleanse import nan_to_null


def stacked(one: DataFrame, values: dict[str, list], names: Sequence[str]) -> DataFrame:
    """A row for each item of values, from the columns of a one-row table."""
    rows = F.array(*(F.struct(F.lit(k).alias(names[0]), *(c.alias(n) for c, n in zip(v, names[1:], strict=True))) for k, v in values.items()))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n_missing, pct_missing in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in columns))
    return stacked(one, {c: [F.col(f"m_{c}"), F.round(100 * F.col(f"m_{c}") / F.col("n"), 4)] for c in columns}, ("column", "n_missing", "pct_missing"))


def infinite_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*(F.count_if(F.abs(c) == float("inf")).alias(f"i_{c}") for c in columns))
    return stacked(one, {c: [F.col(f"i_{c}")] for c in columns}, ("column", "n_infinite"))


#: Bins of a level of quantiles(), and how many levels narrow a rank down before values are counted one by one.
BINS, LEVELS = 1024, 2


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, shares: Sequence[float]) -> DataFrame:
    """keys with q, the exact quantiles (linear between neighbours) of the values that aren't null or NaN.

    Histograms between the least and the largest value find the bin of each
    rank wanted; only the rows of these bins are looked at again, in finer
    bins, and at last by value. No buffer holds a key's values.
    """
    x = nan_to_null(value.cast("double"))
    rows = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), x.alias("x")).where("x IS NOT NULL")
    ks = [f"k{i}" for i in range(len(keys))]
    ends = rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    places = F.array(*((F.col("n") - 1) * F.lit(float(s)) for s in shares))
    ranks = F.array_distinct(F.concat(F.transform(places, lambda p: F.floor(p)), F.transform(places, lambda p: F.ceil(p))))
    want = ends.select(*ks, F.lit(0).cast("long").alias("base"), "lo", "hi", F.explode(ranks).alias("rank"))
    cell = [*ks, "lo", "hi", "base"]

    def met(a: DataFrame, b: DataFrame, names: Sequence[str]) -> DataFrame:
        other = b.withColumnsRenamed({c: f"{c}_of" for c in names})
        same = F.lit(True)
        for c in names:
            same = same & a[c].eqNullSafe(other[f"{c}_of"])
        return a.join(other, same).drop(*(f"{c}_of" for c in names))

    for level in range(LEVELS + 1):
        inside = met(rows, want.select(*cell).distinct(), ks).where("x BETWEEN lo AND hi")
        if level < LEVELS:
            part = F.coalesce(F.least(F.lit(float(BINS - 1)), F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * BINS).cast("double")), F.lit(0.0))
        else:
            part = F.col("x")
        bins = inside.withColumn("part", part).groupBy(*cell, "part").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
        before = Window.partitionBy(*cell).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("start", F.col("base") + F.coalesce(F.sum("c").over(before), F.lit(0)))
        found = met(want, bins, cell).where((F.col("start") <= F.col("rank")) & (F.col("rank") < F.col("start") + F.col("c")))
        want = found.select(*ks, F.col("start").alias("base"), F.col("least").alias("lo"), F.col("most").alias("hi"), "rank")
    at = want.groupBy(*ks).agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))  # two ranks for each share
    both = met(ends.select(*ks, "n"), at, ks)

    def between(p: Column) -> Column:
        low, high = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        return low + (p - F.floor(p)) * (high - low)

    return both.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), F.transform(places, between).alias("q"))


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, count, mean, std, min, q1, median, q3, max; quartiles are exact, NaN is missing."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), nan_to_null(F.col(c).cast("double")).alias("x")) for c in columns))).alias("r")).select("r.*")
    plain = long.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    q = quantiles(long, ["column"], F.col("x"), [0.25, 0.5, 0.75])
    return plain.join(q, "column", "left").select("column", "n", "mean", "std", "min", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))), "max")


def speaker_frame(df: DataFrame, ident: str, columns: Sequence[str]) -> DataFrame:
    """ident with col__mean, col__std (0 for a single row) and col__median of each column."""
    aggs = []
    for c in columns:
        x = nan_to_null(F.col(c).cast("double"))
        aggs += [F.avg(x).alias(f"{c}__mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"{c}__std")]
    out = df.groupBy(ident).agg(*aggs)
    for c in columns:
        q = quantiles(df, [ident], F.col(c), [0.5]).select(F.col(ident).alias("of"), F.get("q", F.lit(0)).alias(f"{c}__median"))
        out = out.join(q, out[ident].eqNullSafe(q["of"]), "left").drop("of")
    return out.select(ident, *(f"{c}__{s}" for c in columns for s in ("mean", "std", "median")))


def interclass_variance(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """column, variance of its class means."""
    means = df.groupBy(label).agg(*(F.avg(nan_to_null(F.col(c).cast("double"))).alias(c) for c in columns))
    return stacked(means.agg(*(F.var_samp(c).alias(c) for c in columns)), {c: [F.col(c)] for c in columns}, ("column", "variance"))


def anova_f(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """column, f: between-class over within-class mean square, from sums of each class."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{c}") for c in columns), *(F.coalesce(F.var_pop(c), F.lit(0.0)).alias(f"v_{c}") for c in columns))
    aggs = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")]
    for c in columns:
        m, v, n = F.col(f"m_{c}"), F.col(f"v_{c}"), F.col("n")
        aggs += [F.sum(n * m).alias(f"s_{c}"), F.sum(n * m * m).alias(f"q_{c}"), F.sum(n * v).alias(f"w_{c}")]
    one = per.agg(*aggs)
    between = lambda c: (F.col(f"q_{c}") - F.col(f"s_{c}") * F.col(f"s_{c}") / F.col("n")) / (F.col("k") - 1)
    return stacked(one, {c: [between(c) / (F.col(f"w_{c}") / (F.col("n") - F.col("k")))] for c in columns}, ("column", "f"))


def even_mean(value: str, digits: int) -> Column:
    """The mean of each group, rounded half to even.

    Sums of binary fractions depend on the order of rows, and may put a mean
    that lies halfway on either side of it. Where all values are decimals of at
    most 10 places, their sum is exact, and halfway is seen as such.
    """
    x = F.col(value).cast("double")
    step = 10**digits
    exact = x.try_cast("decimal(24,10)")
    total, n = F.try_sum(exact).try_cast("decimal(30,10)"), F.count(x)
    halves = F.rint(total.cast("double") / n * (2 * step))
    halfway = (F.count_if(exact.cast("double") == x) == n) & (total * F.lit(Decimal(2 * step)) == halves.try_cast("decimal(17,0)") * n.try_cast("decimal(10,0)"))  # as they are, both sides fit 38 digits
    return F.when(halfway, F.rint(halves / 2) / step).otherwise(F.rint(F.avg(x) * step) / step)


def curve_envelope(df: DataFrame, group: str, values: str) -> DataFrame:
    """group, pos, mean, std over arrays by position."""
    return df.select(group, F.posexplode(values).alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"))
