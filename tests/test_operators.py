import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonalake.functions import kernels, signal
from sonalake.operators import aggs, cache, cleanse, cohort, evaluate, joins, splits


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_token_and_blank_and_flags(spark):
    df = spark.createDataFrame([("12-a_n", "12", " "), ("a_n", "12", "x"), (None, "12", None)], "stem string, id string, b string")
    assert rows(df.select(cleanse.sample_token("stem", "id"), cleanse.blank_to_null("b"))) == [("a_n", "x"), ("a_n", None), (None, None)]
    flags = spark.createDataFrame([("1",), ("True",), ("no",), (None,)], "v string")
    assert [r[0] for r in flags.select(cleanse.as_flag("v")).collect()] == [True, True, False, False]


def test_overlap_ignores_blank_ids(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (" ", "x"), (" ", "y"), (None, "x"), ("b", "x")], "s string, p string")
    got = cleanse.overlap_flag(df, "s", "p", "o")
    assert got.count() == 6 and rows(got.where("o").select("s").distinct()) == [("a",)]


def test_years_round_half_even_and_floor_days(spark):
    df = spark.createDataFrame([(dt.datetime(2001, 1, 1, 12), dt.datetime(2000, 1, 1))], "l timestamp, e timestamp")
    assert df.select(cleanse.years_between(F.col("l"), F.col("e"))).first()[0] == 1.0


def test_fan_in_keeps_rows_and_renames_clashes(spark):
    core = spark.createDataFrame([(1, "c"), (2, "d")], "k long, v string")
    side = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    got = joins.fan_in(core, {"s": side}, "k", {"s": [F.col("v")]})
    assert rows(got) == [(1, "c", "x"), (2, "d", None)]


def test_pairs_with_no_overlap_are_kept(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "g string, i long")
    assert rows(joins.pairwise_overlap(df, "g", "i").select("left_group", "right_group", "overlap")) == [("a", "b", 1), ("a", "c", 0), ("b", "c", 0)]


def test_cap_keeps_null_class_and_exempt_rows(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "ab"[i % 2]) for i in range(60)], "k long, c string")
    got = cohort.capped(df, "c", "k", 4, 1, exempt=F.col("c") == "a").groupBy("c").count()
    assert dict(map(tuple, got.collect())) == {None: 4, "a": 20, "b": 4}
    assert cohort.capped(df, "c", "k", None, 1) is df
    with pytest.raises(ValueError):
        cohort.capped(df, "c", "k", 0, 1)


def test_balance_is_identity_when_one_side_is_empty(spark):
    df = spark.range(5).withColumn("h", F.lit(True))
    assert cohort.balanced(df, F.col("h"), "id", 1).count() == 5


def test_small_class_boundary(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2, "c string")
    assert rows(cohort.drop_small(df, "c", 3).distinct()) == [("a",)]


def test_collinear_drops_by_all_pairs(spark):
    x = np.arange(50.0)
    df = spark.createDataFrame([(float(a), float(2 * a), float((a * 37) % 11)) for a in x], "a double, b double, c double")
    assert cohort.collinear(df, ["a", "b", "c"], 0.9) == ["b"]


def test_feature_columns_hold_no_label(spark):
    df = spark.createDataFrame([(1, 1.0, True)], "mf_num int, mf_x double, is_healthy boolean")
    assert cohort.feature_columns(df, ["mf_"], "num") == ["mf_x"]


def test_splits_and_folds_are_disjoint(spark):
    df = spark.createDataFrame([(i % 17, "ab"[i % 2]) for i in range(200)], "g long, y string")
    split = splits.group_split(df, "g", 0.2, 0.2, 3)
    assert split.count() == 17 and splits.split_leaks(df.join(split, "g"), "g").isEmpty()
    folds = splits.group_folds(df, "g", "y", 3, 3)
    assert folds.count() == 17 and folds.select("fold").distinct().count() == 3


def test_metrics_with_a_class_that_is_never_guessed(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "y int, g int")
    got = evaluate.macro_metrics(evaluate.confusion(df, "y", "g")).first()
    assert got["accuracy"] == pytest.approx(1 / 3) and got["balanced_accuracy"] == 0.5 and got["f1_macro"] == 0.25


def test_vote_takes_the_least_of_ties(spark):
    df = spark.createDataFrame([("s", 1, 0), ("s", 0, 0)], "s string, g int, y int")
    assert rows(evaluate.vote(df, "s", "g", "y")) == [("s", 0, 0)]


@pytest.mark.parametrize(("have", "want", "state"), [([1, 2], [1, 2], "exact"), ([1, 2, 3], [1], "shrink"), ([1], [1, 2], "grow"), ([1, 2], [2, 3], "overlap"), ([1], [2], "rebuild")])
def test_cache_algebra(spark, have, want, state):
    old = spark.createDataFrame([(k, "old") for k in have], "k long, v string")
    target = spark.createDataFrame([(k,) for k in want], "k long")
    assert cache.state(old, target, "k") == state
    new = cache.reconciled(old, target, "k", lambda m: m.withColumn("v", F.lit("new")))
    assert rows(new) == [(k, "old" if k in have else "new") for k in want]
    assert rows(cache.reconciled(new, target, "k", lambda m: m.withColumn("v", F.lit("again")))) == rows(new)


def test_describe_takes_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    got = aggs.described(df, ["x"]).first()
    assert (got["n"], got["mean"], got["median"]) == (2, 2.0, 2.0)


def long(spark, x, key="k"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(x)], "key string, i long, x double")


def test_fluctuation_against_polyfit(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=210)
    y, s = np.cumsum(x - x.mean()), 16
    parts = [y[i * s : (i + 1) * s] for i in range(210 // s)] + [y[210 % s + i * s : 210 % s + (i + 1) * s] for i in range(210 // s)]
    f2 = [np.mean((p - np.polyval(np.polyfit(np.arange(s), p, 1), np.arange(s))) ** 2) for p in parts]
    want = np.mean(np.array(f2) ** 1.0) ** 0.5
    assert signal.fluctuation(long(spark, x), [s], [2.0]).first()["fq"] == pytest.approx(want)


def test_scales(spark):
    assert signal.scales(64, 10)[0] == 16 and signal.scales(2000, 40)[-1] == 499
    with pytest.raises(ValueError):
        signal.scales(100, 5)


def test_spectrum_slopes_equal_gradient(spark):
    q, h = np.array([-2.0, -1.0, 1.0, 3.0]), np.array([0.9, 0.8, 0.6, 0.5])
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(q, h)], "key string, q double, h double")
    got = [r["alpha"] for r in signal.spectrum(df).orderBy("q").collect()]
    np.testing.assert_allclose(got, np.gradient(q * h - 1, q))


def test_constant_and_short_signals(spark):
    assert signal.peak_normalised(long(spark, [0, 0])).agg(F.max("x")).first()[0] == 0
    assert signal.sevcik(long(spark, [1, 1, 1])).first()["sevcik"] is None
    assert signal.unbiased_moments(long(spark, [1.0])).first()["skewness"] is None
    got = kernels.extracted(long(spark, [1.0] * 5), 100.0).first()
    assert got["status"] == "short_signal" and got["centroid"] is None


def test_pitch_and_centroid_of_a_sine():
    x = np.sin(2 * np.pi * 100 * np.arange(512) / 1000)
    assert np.median(kernels.yin(x, 1000.0, 20, 400)) == pytest.approx(100, rel=0.05)
    assert kernels.spectral_moments(x, 1000.0)["centroid"] == pytest.approx(100, rel=0.1)


def test_sample_entropy_against_loops():
    x = np.random.default_rng(1).normal(size=60)
    r, n = 0.2 * x.std(ddof=1), len(x)
    count = lambda m: sum(max(abs(x[i : i + m] - x[j : j + m])) <= r for i in range(n - 2) for j in range(n - 2) if i != j)
    assert kernels.sample_entropy(x) == pytest.approx(-np.log(count(3) / count(2)))


def test_entropies_see_every_point_below_their_rate(spark):
    x = np.random.default_rng(2).normal(size=4500).cumsum().round(3)
    t = np.lib.stride_tricks.sliding_window_view(x, 2)
    np.testing.assert_array_equal(kernels._matches(x, 2, 0.7), [(abs(t - a).max(1) <= 0.7).sum() for a in t])
    got = kernels.extracted(long(spark, [float(v) for v in x]), 1000.0).first()
    assert got["sample_entropy"] == pytest.approx(kernels.sample_entropy(x))
    assert got["approximate_entropy"] == pytest.approx(kernels.approximate_entropy(x))


@pytest.mark.parametrize("kind", ["cents", "constant", "normal", "walk", "two", "wide"])
def test_templates_by_levels_equal_pairs(monkeypatch, kind):
    rng = np.random.default_rng(5)
    n = 2500
    x = {"cents": rng.exponential(50, n).round(2), "constant": np.ones(n), "normal": rng.normal(size=n + 1597), "walk": np.cumsum(rng.normal(size=n)), "two": rng.integers(0, 2, n).astype(float), "wide": 1e16 * rng.normal(size=n) + rng.integers(-1, 2, n)}[kind]
    want = {(m, f): kernels._pairs(x, m, f * x.std(ddof=1)) for m in (2, 3) for f in (0.2, 0.0, 3.0)}
    monkeypatch.setattr(kernels, "_pairs", None)  # long series don't meet it
    for (m, f), counts in want.items():
        np.testing.assert_array_equal(kernels._matches(x, m, f * x.std(ddof=1)), counts)


def test_entropies_of_a_long_series(monkeypatch):
    x = np.random.default_rng(6).exponential(50, 3000).round(2)
    r = 0.2 * x.std(ddof=1)
    pairs = kernels._pairs
    a, b = (pairs(x, 3, r) - 1).sum(), (pairs(x[:-1], 2, r) - 1).sum()
    phi = [np.log(pairs(x, m, r) / (len(x) - m + 1)).mean() for m in (2, 3)]
    monkeypatch.setattr(kernels, "_pairs", None)
    assert kernels.entropies(x) == pytest.approx((-np.log(a / b), phi[0] - phi[1]))


def test_each_long_series_has_a_task(spark):
    rows = spark.range(500).selectExpr("CAST(id % 5 AS STRING) AS key", "id AS i", "CAST(id * 7 % 13 AS DOUBLE) AS x")
    tasks = kernels.extracted(rows, 1000.0).select("key", F.spark_partition_id().alias("task")).collect()
    assert len({r["task"] for r in tasks}) == 5
