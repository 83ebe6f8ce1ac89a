"""Signals: the values of each event type in time order, and the embeddings as short arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, signal
from .registry import query, table

#: Scales of each series, from its own length.
SCALES = 20
QS = [-5.0, -3.0, -1.0, 1.0, 2.0, 3.0, 5.0]
S = """s AS (SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, value AS x FROM events)"""
FQ = f"""{S},
p AS (SELECT key, i, count(*) OVER (PARTITION BY key) AS n, sum(dx) OVER (PARTITION BY key ORDER BY i) AS y FROM (SELECT key, i, x - avg(x) OVER (PARTITION BY key) AS dx FROM s)),
sc AS (SELECT DISTINCT n, trunc(pow(10, CASE WHEN k = {SCALES - 1} THEN log10(greatest(17, n // 4)) ELSE log10(16) + k * ((log10(greatest(17, n // 4)) - log10(16)) / {SCALES - 1}) END))::INT AS s
       FROM (SELECT DISTINCT n FROM p), (SELECT unnest(range(0, {SCALES})) AS k)),
e AS (SELECT key, i, p.n, y, s FROM p JOIN sc ON p.n = sc.n),
g AS (SELECT key, s, 0 AS d, i // s AS seg, i % s AS j, y FROM e WHERE n >= 2 * s AND i < n - n % s
      UNION ALL SELECT key, s, 1, (i - n % s) // s, (i - n % s) % s, y FROM e WHERE n >= 2 * s AND n % s > 0 AND i >= n % s),
f2 AS (SELECT key, s, (regr_syy(y, j) - regr_sxy(y, j) * regr_sxy(y, j) / regr_sxx(y, j)) / s AS f2 FROM g GROUP BY key, s, d, seg),
fq AS (SELECT key, s, q, pow(avg(pow(f2, q / 2)), 1 / q) AS fq FROM (SELECT key, s, f2, unnest({QS})::DOUBLE AS q FROM f2 WHERE f2 > 0) GROUP BY key, s, q)"""
HQ = f"""{FQ}, h AS (SELECT key, q, regr_slope(ln(fq), ln(s)) AS h FROM fq GROUP BY key, q HAVING count(*) >= 3)"""
SP = f"""{HQ}, t AS (SELECT *, q * h - 1 AS tau FROM h),
w AS (SELECT *, q - lag(q) OVER k AS a, lead(q) OVER k - q AS b, lag(tau) OVER k AS ta, lead(tau) OVER k AS tb FROM t WINDOW k AS (PARTITION BY key ORDER BY q)),
al AS (SELECT key, q, h, tau, CASE WHEN a IS NULL THEN (tb - tau) / b WHEN b IS NULL THEN (tau - ta) / a
       ELSE (a * a * tb + (b * b - a * a) * tau - b * b * ta) / (a * b * (a + b)) END AS alpha FROM w),
sp AS (SELECT *, q * alpha - tau AS f FROM al)"""


def series(spark: SparkSession, d: str) -> DataFrame:
    return signal.series(table(spark, d, "events"), "event_type", ["ts", "event_id"], "value")


def rounded(df: DataFrame, digits: int, *keep: str) -> DataFrame:
    return df.select(*keep, *(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keep))


@query(f"WITH {S} SELECT key, i, round(x / max(abs(x)) OVER (PARTITION BY key), 6) AS x FROM s")
def peak_normalise(spark, d):
    return rounded(signal.peak_normalised(series(spark, d)), 6)


@query(f"WITH {S} SELECT key, i, greatest(-32768, least(32767, trunc(x / max(abs(x)) OVER (PARTITION BY key) * 32767)))::SMALLINT AS pcm FROM s")
def to_int16(spark, d):
    return signal.int16(series(spark, d)).select("key", "i", "pcm")


@query(f"WITH {S} SELECT key, i // 6 AS i, x FROM s WHERE i % 6 = 0")
def decimate(spark, d):
    return signal.decimated(series(spark, d), 6)


@query(f"""WITH {S} SELECT key, round(avg(x * x), 4) AS energy, round(avg(abs(x)), 6) AS abs_mean, round(max(abs(x)), 6) AS peak,
           round(max(abs(x)) / (sqrt(avg(x * x)) + 1e-12), 6) AS crest_factor FROM s GROUP BY key""")
def time_domain_stats(spark, d):
    return signal.time_domain(series(spark, d)).select("key", F.round("energy", 4).alias("energy"), *(F.round(c, 6).alias(c) for c in ("abs_mean", "peak", "crest_factor")))


FRAMES = f"""{S}, c AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, avg(x) OVER (PARTITION BY key) AS m FROM s),
fr AS (SELECT key, k.k AS f, i, x, m FROM c JOIN (SELECT unnest(range(0, (SELECT count(*) // 32 + 1 FROM events))) AS k) k ON i BETWEEN k.k * 32 AND k.k * 32 + 63 AND k.k * 32 + 64 <= n)"""


@query(f"WITH {FRAMES} SELECT key, f, round(sqrt(avg(x * x)), 6) AS rms FROM fr GROUP BY key, f")
def rms_frames(spark, d):
    return rounded(signal.frame_rms(series(spark, d), 64, 32), 6)


@query(f"""WITH {FRAMES}, z AS (SELECT key, f, (x >= 100) <> (lag(x) OVER (PARTITION BY key, f ORDER BY i) >= 100) AS c FROM fr)
           SELECT key, f, round(count(*) FILTER (c) / 64.0, 6)::DOUBLE AS zcr FROM z GROUP BY key, f""")
def zcr_frames(spark, d):
    centred = series(spark, d).withColumn("x", F.col("x") - 100)
    return rounded(signal.frame_zcr(centred, 64, 32), 6)


@query(f"WITH {S} SELECT key, count(*) AS n, round(skewness(x), 5) AS skewness, round(kurtosis(x), 5) AS kurtosis FROM s GROUP BY key")
def skew_kurt_unbiased(spark, d):
    return rounded(signal.unbiased_moments(series(spark, d)), 5)


@query(f"WITH {FQ} SELECT key, i, n, round(y, 4) AS y FROM p")
def profile_cumsum(spark, d):
    return rounded(signal.profile(series(spark, d)), 4)


@query(f"WITH {FQ} SELECT key, s, q, round(fq, 4) AS fq FROM fq")
def mfdfa_fluctuation(spark, d):
    return signal.fluctuation(series(spark, d), SCALES, QS).select("key", "s", "q", F.round("fq", 4).alias("fq"))


@query(f"WITH {HQ} SELECT key, q, round(h, 6) AS h FROM h")
def hurst_hq(spark, d):
    return rounded(signal.hurst(signal.fluctuation(series(spark, d), SCALES, QS)), 6)


def _spectrum(spark, d):
    return signal.spectrum(signal.hurst(signal.fluctuation(series(spark, d), SCALES, QS)))


@query(f"WITH {SP} SELECT key, q, round(h, 6) AS h, round(tau, 6) AS tau, round(alpha, 6) AS alpha, round(f, 6) AS f FROM sp")
def tau_alpha_spectrum(spark, d):
    return rounded(_spectrum(spark, d), 6)


@query(f"""WITH {SP}, x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(f, 9) DESC, q) AS r FROM sp),
pk AS (SELECT key, alpha AS pa, f AS pf FROM x WHERE r = 1)
SELECT key, round(avg(h), 5) AS hq_mean, round(stddev_pop(h), 5) AS hq_std, round(min(h), 5) AS hq_min, round(max(h), 5) AS hq_max, round(avg(tau), 5) AS tau_mean,
       round(stddev_pop(tau), 5) AS tau_std, round(avg(alpha), 5) AS alpha_mean, round(stddev_pop(alpha), 5) AS alpha_std, round(max(alpha) - min(alpha), 5) AS spectrum_width,
       round(any_value(pa), 5) AS spectrum_peak_alpha, round(any_value(pf), 5) AS spectrum_peak_f,
       round((any_value(pa) - min(alpha)) / (max(alpha) - any_value(pa) + 1e-12), 4) AS spectrum_asymmetry, round(max(h) - min(h), 5) AS delta_h, count(*) AS num_q
FROM sp JOIN pk USING (key) GROUP BY key""")
def mf_descriptors(spark, d):
    out = rounded(signal.descriptors(_spectrum(spark, d)), 5)
    return out.withColumn("spectrum_asymmetry", F.round("spectrum_asymmetry", 4))


@query(f"WITH {S}, c AS (SELECT key, x, count(*) AS c FROM s GROUP BY ALL), p AS (SELECT key, c / sum(c) OVER (PARTITION BY key) AS p FROM c) SELECT key, round(sum(-p * log2(p)), 6) AS shannon FROM p GROUP BY key")
def shannon_entropy(spark, d):
    return rounded(signal.shannon(series(spark, d)), 6)


@query(f"""WITH {S}, a AS (SELECT key, i, x - lag(x) OVER (PARTITION BY key ORDER BY i) AS dx FROM s), b AS (SELECT key, dx * lag(dx) OVER (PARTITION BY key ORDER BY i) < 0 AS flip FROM a),
c AS (SELECT key, count(*)::DOUBLE AS n, count(*) FILTER (flip) AS d FROM b GROUP BY key) SELECT key, round(log10(n) / (log10(n) + log10(n / (n + 0.4 * d))), 8) AS petrosian FROM c""")
def petrosian_fd(spark, d):
    return rounded(signal.petrosian(series(spark, d)), 8)


@query(f"""WITH {S}, u AS (SELECT key, i, count(*) OVER k AS n, (x - min(x) OVER k) / (max(x) OVER k - min(x) OVER k) AS x FROM s WINDOW k AS (PARTITION BY key)),
v AS (SELECT key, n, x - lag(x) OVER (PARTITION BY key ORDER BY i) AS dx FROM u) SELECT key, round(1 + ln(sum(sqrt(dx * dx + 1 / ((n - 1.0) * (n - 1.0))))) / ln(2 * (any_value(n) - 1)), 6) AS sevcik FROM v GROUP BY key""")
def sevcik_fd(spark, d):
    return rounded(signal.sevcik(series(spark, d)), 6)


@query(f"""WITH {S} SELECT key, i, round(({" + ".join(f"{k} * (lead(x, {k}) OVER w - lag(x, {k}) OVER w)" for k in range(1, 5))}) / 60, 6) AS delta FROM s WINDOW w AS (PARTITION BY key ORDER BY i)""")
def delta_slope(spark, d):
    return rounded(signal.delta(series(spark, d)), 6)


@query(f"""WITH {SP}, grid AS (SELECT k, k * 0.02 + 0.3 AS a FROM (SELECT unnest(range(0, 31)) AS k)), n AS (SELECT key, alpha AS a0, f AS f0, lead(alpha) OVER w AS a1, lead(f) OVER w AS f1 FROM sp WINDOW w AS (PARTITION BY key ORDER BY alpha, q))
SELECT key, k, round(a, 6)::DOUBLE AS alpha, round(f0 + (f1 - f0) * (a - a0) / (a1 - a0), 5) AS f FROM n JOIN grid ON a >= a0 AND a < a1 WHERE a1 > a0""")
def spectrum_interpolation(spark, d):
    return signal.interpolated(_spectrum(spark, d), 31, 0.3, 0.9).select("key", "k", F.round("alpha", 6).alias("alpha"), F.round("f", 5).alias("f"))


@query("""SELECT vec_id AS key, CASE WHEN len(embedding) < 128 THEN 'short_signal' ELSE 'ok' END AS mf_status FROM embeddings""")
def short_signal_status(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("key"), F.when(F.size("embedding") < 128, "short_signal").otherwise("ok").alias("mf_status"))


@query()
def spectral_features(spark, d):
    """Spectral moments, cepstra, pitch and template entropies of each series; tested against direct sums."""
    return kernels.extracted(series(spark, d), 1000.0)


@query()
def embedding_features(spark, d):
    return kernels.extracted(signal.exploded(table(spark, d, "embeddings"), "vec_id", "embedding"), 1000.0).select("key", "status", "centroid", "mfcc1_mean", "f0_mean")


@query()
def acoustic_features(spark, d):
    """The 84 acoustic columns of each series, in short frames; tested against direct sums."""
    return kernels.acoustic_extracted(series(spark, d), 1000.0, 256, 64)


@query(f"WITH {S}, n AS (SELECT key, count(*) AS n FROM s GROUP BY key) SELECT key, greatest(1, n // 500) AS step, (n + greatest(1, n // 500) - 1) // greatest(1, n // 500) AS left_over FROM n")
def decimation_step(spark, d):
    """The step that leaves about 500 points, by the rule of rates: the largest whole ratio, one at least."""
    s = series(spark, d)
    n = s.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("step", signal.decimation_step(F.col("n"), 500))
    return signal.joined(s, n.select("key", "step")).where(F.col("i") % F.col("step") == 0).groupBy("key").agg(F.max("step").alias("step"), F.count(F.lit(1)).alias("left_over"))
