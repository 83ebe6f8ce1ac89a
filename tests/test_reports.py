"""Reports, exact quantiles and hash ranks on small fixtures; blocks and stretches against plain windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonalake.functions import kernels, signal
from sonalake.operators import aggs, cleanse, cohort, joins, reports, splits
from sonalake.sources import readers, writers


def long(spark, x, key="k"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(x)], "key string, i long, x double")


def test_quantiles_of_skewed_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(aggs, "BINS", 4)
    rng = np.random.default_rng(0)
    values = {"a": rng.normal(size=400), "b": np.r_[np.zeros(300), 1e30, -5.0], None: np.array([7.0]), "c": rng.integers(0, 3, 99).astype(float)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("a", float("nan"))]
    got = {r["k"]: r["q"] for r in aggs.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), [0, 0.25, 0.5, 0.9, 1]).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        np.testing.assert_allclose(got[k], np.quantile(v, [0, 0.25, 0.5, 0.9, 1]))


def test_balance_keeps_unknown_rows(spark):
    df = spark.createDataFrame([(i, "healthy" if i < 6 else None if i == 6 else "ill") for i in range(9)], "k long, label string")
    got = cohort.balanced(df, F.col("label") == "healthy", "k", 1).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"healthy": 3, None: 1, "ill": 2}


def test_mean_halfway_whatever_the_order(spark):
    rows = {1: [87.32, 41.04, 49.12, 3.92], 2: [128.03, 68.37, 178.65, 69.15], 3: [0.25, None], 4: [None], 5: [1e300, 1e300], 6: [1 / 3, 2 / 3], 7: [float("nan")], 8: [-0.15, -0.15], 9: [49.54] * 59 + [50.12]}  # means 45.35, 111.05 in no order of binary sums
    want = {1: 45.4, 2: 111.0, 3: 0.2, 4: None, 5: 1e300, 6: 0.5, 8: -0.2, 9: 49.5}
    for turn in (1, -1):
        df = spark.createDataFrame([(k, v) for k, vs in rows.items() for v in vs[::turn]], "k long, v double")
        got = {r["k"]: r["m"] for r in df.groupBy("k").agg(aggs.even_mean("v", 1).alias("m")).collect()}
        assert np.isnan(got.pop(7)) and got == want


def test_hash_ranks_equal_a_sort(spark):
    import hashlib

    df = spark.createDataFrame([(i, i % 3 or None) for i in range(3000)], "k long, label long")
    got = cohort.hash_ranked(df, "k", 5, F.col("label")).collect()
    for label in (None, 1, 2):
        own = sorted((r for r in got if r["label"] == label), key=lambda r: (hashlib.md5(f"5|{r['k']}".encode()).hexdigest(), r["k"]))
        assert [r["hash_rank"] for r in own] == list(range(1, 1001)) and own[0]["hash_size"] == 1000


def test_mapped_split_fills_in(spark):
    table = spark.createDataFrame([(1, "test")], "g long, split string")
    got = splits.mapped_split(spark.createDataFrame([(1,), (2,)], "g long"), table, "g").orderBy("g").collect()
    assert [r["split"] for r in got] == ["test", "train"]


def test_lookup_with_a_clashing_column(spark):
    a = spark.createDataFrame([(1, True), (2, True)], "k long, lookup_hit boolean")
    b = spark.createDataFrame([(1, "x")], "k long, v string")
    got = joins.lookup(a, b, "k", [F.col("v")]).orderBy("k").collect()
    assert [(r["lookup_hit"], r["v"], r["match_status"]) for r in got] == [(True, "x", "matched"), (True, None, "missing")]


def test_blocks_and_stretches(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=500).round(2)
    whole = {n: f(long(spark, x)).toPandas() for n, f in {"delta": signal.delta, "profile": signal.profile, "petrosian": signal.petrosian, "sevcik": signal.sevcik}.items()}
    monkeypatch.setattr(signal, "BLOCK", 16)
    for n, f in {"delta": signal.delta, "profile": signal.profile, "petrosian": signal.petrosian, "sevcik": signal.sevcik}.items():
        got = f(long(spark, x)).toPandas()
        keys = [c for c in ("i",) if c in got]
        got, want = (t.sort_values(keys) if keys else t for t in (got, whole[n]))
        np.testing.assert_allclose(got.select_dtypes("number").to_numpy(float), want[got.columns].select_dtypes("number").to_numpy(float), atol=1e-9)
    order = rng.permutation(500)
    rows = spark.createDataFrame([("k", int(t) // 7, int(t), float(x[t])) for t in order] + [("k", 3, 999, float("nan")), ("one", 5, 1, 2.0)], "key string, ts long, id long, v double")
    got = signal.series(rows, "key", ["ts", "id"], "v").where("key = 'k'").orderBy("i").toPandas()
    assert got["i"].tolist() == list(range(500)) and got["x"].tolist() == x.tolist()


def test_scales_follow_the_length(spark):
    assert signal.scales(64, 20) == sorted({16, int(10 ** np.log10(17))}) and signal.scales(2000, 20)[-1] == 499  # the last one is cut off, not rounded
    both = long(spark, np.sin(np.arange(400) ** 1.5)).union(long(spark, np.cos(np.arange(200) ** 1.5), "short"))
    got = signal.fluctuation(both, 20, [2.0]).groupBy("key").agg(F.max("s").alias("s")).collect()
    assert {r["key"]: r["s"] for r in got} == {"k": signal.scales(400)[-1], "short": signal.scales(200)[-1]}


def test_fluctuation_of_any_order():
    x = np.random.default_rng(2).normal(size=210)
    y = np.cumsum(x - x.mean())
    for order in (1, 2):
        parts = [y[i * 16 : i * 16 + 16] for i in range(13)] + [y[2 + i * 16 : 18 + i * 16] for i in range(13)]
        f2 = np.array([((p - np.polyval(np.polyfit(np.arange(16), p, order), np.arange(16))) ** 2).mean() for p in parts])
        got = kernels.fluctuation(x, [16, 500], [0.0, 2.0, -1.0], order)
        np.testing.assert_allclose(got[0], [np.exp(np.log(f2).mean() / 2), f2.mean() ** 0.5, (f2**-0.5).mean() ** -1])
        assert np.isnan(got[1]).all()


def test_acoustic_columns():
    t = np.arange(8000) / 8000
    got = kernels.acoustic(0.5 * np.sin(2 * np.pi * 220 * t), 8000.0, 1024, 256)
    assert list(got) == kernels.ACOUSTIC and len(got) == 84
    assert got["ac_f0_mean"] == pytest.approx(220, rel=0.03) and got["ac_time_peak"] == pytest.approx(0.5, rel=1e-3) and got["ac_spec_centroid_min"] == pytest.approx(220, rel=0.2)
    assert got["ac_zcr_max"] == pytest.approx(2 * 220 / 8000, rel=0.1) and got["ac_rms_max"] == pytest.approx(0.5 / 2**0.5, rel=0.05)
    silent = kernels.acoustic(np.zeros(100), 8000.0, 1024, 256)
    assert silent["ac_rms_mean"] == 0 and silent["ac_time_crest_factor"] == 0


def test_slopes():
    rows = np.stack([np.arange(20) * 2.0, np.ones(20)], 1)
    np.testing.assert_allclose(kernels.slopes(rows), np.tile([2.0, 0.0], (20, 1)), atol=1e-12)
    assert kernels.slopes(rows[:5]).tolist() == np.zeros((5, 2)).tolist()


def test_sample_status_lattice(spark):
    rows = [(1, None, True, None, "ok"), (2, " ", True, None, "ok"), (3, "a", False, None, "ok"), (4, "a", True, "bad", "ok"), (5, "a", True, None, "ok"), (6, "a", True, None, "short_signal"), (7, "a", None, None, "ok")]
    df = spark.createDataFrame(rows, "k long, path string, there boolean, err string, mf string")
    got = reports.sample_status(df, F.col("path"), F.col("there"), F.col("err"), {"ac": F.lit("failed"), "mf": F.col("mf")}).orderBy("k").collect()
    assert [r["core_status"] for r in got] == ["missing_wav_path"] * 2 + ["missing_wav_file", "audio_load_failed", "partial_failure", "partial_failure", "missing_wav_file"]
    assert got[3]["core_error"] == "bad" and got[5]["core_error"] == "ac:failed | mf:short_signal" and got[2]["mf_status"] == "missing_wav_file" and got[4]["mf_status"] == "ok"


def test_small_reports(spark):
    df = spark.createDataFrame([("x10", 1), ("x9", 1), ("y", 2), ("x9", 3)], "name string, g long")
    assert [r["name"] for r in reports.ranked(df.select("name").distinct(), reports.natural("name")).orderBy("rank").collect()] == ["x9", "x10", "y"]
    assert [r["text"] for r in reports.first_and_more(df.select("name").distinct(), [F.col("name")], F.col("name"), 2).orderBy("line").collect()] == ["x10", "x9", "... and 1 more"]
    assert reports.numeric_columns(df, []) == ["g"] and reports.ordered_columns(df, ["g", "no"]).columns == ["g", "name"]
    flags = spark.createDataFrame([("healthy", None), ("ill", "1"), (None, None), ("healthy", "false")], "c string, is_healthy string")
    assert [r["m"] for r in flags.select(reports.healthy_mask(flags, "c").alias("m")).collect()] == [True, True, False, False]
    assert [r["m"] for r in flags.drop("is_healthy").select(reports.healthy_mask(flags.drop("is_healthy"), "c").alias("m")).collect()] == [True, False, False, True]
    with pytest.raises(ValueError):
        cleanse.require(df, ["name", "none"])


def test_names_paths_and_summary(spark, tmp_path):
    df = spark.createDataFrame([("Reinke Ödem",), ("Reinke Ödem",), ("else",)], "c string")
    assert [r[0] for r in df.select(cleanse.english("c")).collect()] == ["reinke's edema", "reinke's edema", "else"]
    there = {"/r/a.wav", "/r/data/b.wav"}.__contains__
    assert readers.resolved("a.wav", ["/q", "/r"], there) == "/r/a.wav" and readers.resolved("/old/data/b.wav", ["/r"], there) == "/r/data/b.wav"
    assert readers.resolved("c.wav", ["/q"], there) == "/q/c.wav" and readers.resolved(None) is None
    writers.write_summary(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 3


def test_conversion_statuses(spark, tmp_path):
    import struct

    body = struct.pack("<20sI8s", b"", 8000, b"")
    good = b"FORMDS16" + struct.pack("<I", 0) + b"HEDR" + struct.pack("<I", len(body)) + body + b"SDA_" + struct.pack("<I", 4) + struct.pack("<2h", 1, -1)
    files = spark.createDataFrame([("/x/a.nsp", good), ("/x/b.nsp", b"bad")], "path string, content binary").coalesce(1)
    first, again = (sorted((r["path"], r["wav_conversion_status"]) for r in readers.converted(files, str(tmp_path / "w")).collect()) for _ in range(2))
    assert first == [("/x/a.nsp", "converted"), ("/x/b.nsp", "failed")] and again[0][1] == "skipped_exists"
    with open(next((tmp_path / "w").iterdir()), "rb") as f:
        assert readers.read_wav(f.read())[1].ravel().tolist() == [1, -1]
    x = np.sin(2 * np.pi * 3000 * np.arange(8000) / 8000)
    assert np.abs(readers.resampled(x, 8000, 2000)[100:-100]).max() < 0.05  # above half the new rate: gone


class TestModels:
    def rows(self, spark):
        rng = np.random.default_rng(3)
        y = np.arange(90) % 2
        return spark.createDataFrame([(i, i % 30, "abc"[i % 3], int(y[i]), *(float(v) for v in rng.normal(y[i] * 2, 1, 3))) for i in range(90)], "k long, g long, token string, label int, ft_0 double, ft_1 double, ft_2 double")

    def test_out_of_fold_rows_and_drivers(self, spark):
        from sonalake.plans import models

        df = self.rows(spark)
        got = models.out_of_fold(df, "g", "label", ["ft_0", "ft_1", "ft_2"], models.logistic(), 2, tuned=[0.4, 0.5, 0.6]).toPandas()
        assert sorted(got["k"]) == list(range(90)) and (got["guess"] == got["y"]).mean() > 0.8 and (got.groupby("g")["fold"].nunique() == 1).all()
        ensemble = models.token_ensemble(df, "g", "label", "token", "ft_", models.logistic(), least=10, folds=2).toPandas()
        assert sorted(ensemble["g"]) == list(range(30)) and (ensemble["guess"] == ensemble["y"]).mean() > 0.8

    def test_selection(self, spark):
        from pyspark.ml import Pipeline

        from sonalake.plans import models

        df = self.rows(spark).withColumn("ft_3", F.lit(1.0) * (F.col("k") % 7))
        columns = [f"ft_{i}" for i in range(4)]
        assert "ft_3" not in models.forest_selected(df, "label", columns) and "ft_3" not in models.eliminated(df, "label", columns, 2, 1) and "ft_3" not in models.l1_selected(df, "label", columns)
        fitted = Pipeline(stages=models.preprocessing(columns)[:2]).fit(df)
        assert models.feature_names(fitted, df, "raw") == [f"{c}_filled" for c in columns]
        assert models.importances(df, "label", "ft_", 2).count() == 2 and models.explained(df, "ft_", 4)[1] <= 4
