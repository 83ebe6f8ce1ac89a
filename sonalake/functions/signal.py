"""Signal operators over long series (key, i, x), as expressions and aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12
#: Least number of distinct scales that a spectrum needs.
LEAST_SCALES = 6


#: Points of a block: windows over neighbours and running sums never hold more than a block and its edges.
BLOCK = 65_536
#: Stretches of a key's first order column in which its rows are numbered apart.
STRETCHES = 1024


def joined(s: DataFrame, per_key: DataFrame, *more: str) -> DataFrame:
    """s with a small table's columns of its key, null keys too; the sums before it are combined on each side first."""
    other = per_key.withColumnsRenamed({c: f"own_{c}" for c in ("key", *more)})
    same = s["key"].eqNullSafe(other["own_key"])
    for c in more:
        same = same & (s[c] == other[f"own_{c}"])
    return s.join(other, same).drop("own_key", *(f"own_{c}" for c in more))


def series(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """key, i (from 0 in a total order), x; null and NaN values are left out first.

    Rows are numbered within stretches of the first order column, a number or
    time, and from the sum of the stretches before: a key never meets in a task.
    """
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.select(F.col(key).alias("key"), *(F.col(o).alias(f"o{k}") for k, o in enumerate(order)), x.alias("x")).where("x IS NOT NULL")
    kind = rows.schema["o0"].dataType.simpleString()
    first = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o0)") if kind == "timestamp_ntz" else F.col("o0").cast("timestamp") if kind == "date" else F.col("o0")
    first = first.cast("double")
    rows = joined(rows, rows.groupBy("key").agg(F.min(first).alias("lo"), F.max(first).alias("hi")))
    place = F.try_divide(first - F.col("lo"), F.col("hi") - F.col("lo")) * STRETCHES
    rows = rows.withColumn("part", F.least(F.lit(STRETCHES - 1), F.coalesce(F.floor(place), F.lit(0))).cast("int")).drop("lo", "hi")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    base = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c")).select("key", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy(*(f"o{k}" for k in range(len(order))))) - 1
    return joined(rows.withColumn("inside", inside), base, "part").select("key", (F.col("inside") + F.col("base")).cast("long").alias("i"), "x")


def with_neighbours(s: DataFrame, reach: int) -> DataFrame:
    """s(key, i, ...) with block, rows near an edge once more for the block beyond it: see own()."""
    block = F.floor(F.col("i") / BLOCK)
    at = F.col("i") % BLOCK
    blocks = F.array_compact(F.array(block, F.when((at < reach) & (block > 0), block - 1), F.when(at >= BLOCK - reach, block + 1)))
    return s.withColumn("block", F.explode(blocks))


def own(rows: DataFrame) -> DataFrame:
    """The rows of with_neighbours() that belong to their block."""
    return rows.where(F.col("block") == F.floor(F.col("i") / BLOCK)).drop("block")


def in_block() -> WindowSpec:
    return Window.partitionBy("key", "block").orderBy("i")


def exploded(df: DataFrame, key: str, values: str) -> DataFrame:
    """The same from arrays, a series for each row."""
    return df.select(F.col(key).alias("key"), F.posexplode(values).alias("i", "x")).select("key", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


def peak_normalised(s: DataFrame) -> DataFrame:
    """Divided by the largest magnitude; a series of zeros stays."""
    each = joined(s, s.groupBy("key").agg(F.max(F.abs("x")).alias("peak")))
    return each.withColumn("x", F.coalesce(F.try_divide("x", F.nullif("peak", F.lit(0.0))), F.lit(0.0))).drop("peak")


def int16(s: DataFrame) -> DataFrame:
    """Scaled by 32767 over the largest magnitude, cut to 16 bits."""
    n = peak_normalised(s)
    return n.withColumn("pcm", F.least(F.lit(32767), F.greatest(F.lit(-32768), (F.col("x") * 32767).cast("int"))).cast("short"))


def decimation_step(rate: Column, target: int = 8000) -> Column:
    """Points to go on for each one kept: the largest whole ratio of the rates, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(rate / target))


def decimated(s: DataFrame, step: int) -> DataFrame:
    """Every step-th point, renumbered."""
    return s.where(F.col("i") % step == 0).withColumn("i", (F.col("i") / step).cast("long"))


def time_domain(s: DataFrame) -> DataFrame:
    energy, peak = F.avg(F.col("x") * F.col("x")), F.max(F.abs("x"))
    return s.groupBy("key").agg(energy.alias("energy"), F.avg(F.abs("x")).alias("abs_mean"), peak.alias("peak"), (peak / (F.sqrt(energy) + EPS)).alias("crest_factor"))


def framed(s: DataFrame, frame: int, hop: int) -> DataFrame:
    """key, f, i, x: whole frames only, each point once for every frame that covers it."""
    last = F.floor(F.col("i") / hop)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - frame + 1) / hop))
    each = joined(s, s.groupBy("key").agg(F.count(F.lit(1)).alias("n"))).withColumn("f", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return each.where(F.col("f") * hop + frame <= F.col("n")).select("key", "f", "i", "x")


def frame_rms(s: DataFrame, frame: int, hop: int) -> DataFrame:
    return framed(s, frame, hop).groupBy("key", "f").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def frame_zcr(s: DataFrame, frame: int, hop: int) -> DataFrame:
    """Share of points in each frame whose sign differs from the point before."""
    before = F.lag("x").over(Window.partitionBy("key", "f").orderBy("i"))
    crossed = framed(s, frame, hop).withColumn("c", (F.signum("x") >= 0) != (F.signum(before) >= 0))
    return crossed.groupBy("key", "f").agg((F.count_if(F.coalesce("c", F.lit(False))) / F.lit(float(frame))).alias("zcr"))


def unbiased_moments(s: DataFrame) -> DataFrame:
    """key, n, skewness, kurtosis with the small-sample corrections; null where they aren't defined."""
    m = s.groupBy("key").agg(F.count("x").alias("n"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"))
    n = F.col("n").cast("double")
    skew = F.try_divide(F.col("g1") * F.sqrt(n * (n - 1)), F.nullif(n - 2, F.lit(0.0)))
    kurt = F.try_divide((n - 1) * ((n + 1) * F.col("g2") + 6), F.nullif((n - 2) * (n - 3), F.lit(0.0)))
    return m.select("key", "n", skew.alias("skewness"), kurt.alias("kurtosis"))


def profile(s: DataFrame) -> DataFrame:
    """key, i, n, y: running sum of deviations from the mean, block by block from the sum of the blocks before."""
    each = joined(s, s.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")))
    each = each.select("key", "i", "n", (F.col("x") - F.col("mean")).alias("dx"), F.floor(F.col("i") / BLOCK).alias("block"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    base = each.groupBy("key", "block").agg(F.sum("dx").alias("t")).select("key", "block", F.coalesce(F.sum("t").over(before), F.lit(0.0)).alias("base"))
    inside = each.withColumn("inside", F.sum("dx").over(in_block().rowsBetween(Window.unboundedPreceding, 0)))
    return joined(inside, base, "block").select("key", "i", "n", (F.col("inside") + F.col("base")).alias("y"))


def scales(n: int, count: int = 20) -> list[int]:
    """Distinct truncated log-spaced scales from 16 to a quarter of n, 17 at least."""
    if count < LEAST_SCALES:
        raise ValueError(f"at least {LEAST_SCALES} scales are needed")
    lo, hi = math.log10(16), math.log10(max(17, n // 4))  # number by number: numpy's powers of arrays round otherwise on some processors
    return sorted({int(10.0 ** (hi if k == count - 1 else lo + k * ((hi - lo) / (count - 1)))) for k in range(count)})


def fluctuation(s: DataFrame, at: Sequence[int] | int, qs: Sequence[float]) -> DataFrame:
    """key, s, q, fq: order-1 detrended fluctuation from closed-form regressions of each segment, from both ends.

    at: scales, or how many each series gets from its own length. The scales are
    few, so each point is exploded by scale next to it and all segments of all
    series reduce in one partial aggregation.
    """
    points = profile(s)
    if isinstance(at, int):

        @F.pandas_udf("array<int>")
        def own_scales(n: pd.Series) -> pd.Series:
            return n.map(lambda v: scales(int(v), at))

        lengths = s.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", own_scales("n").alias("at"))  # a row for each series
        each = joined(points, lengths).withColumn("s", F.explode("at")).drop("at")
    else:
        each = points.withColumn("s", F.explode(F.array(*map(F.lit, at))))
    each = each.where(F.col("n") >= 2 * F.col("s"))
    rest = F.col("n") % F.col("s")
    ahead = F.when(F.col("i") < F.col("n") - rest, F.struct(F.lit(0).alias("d"), F.floor(F.col("i") / F.col("s")).alias("seg"), (F.col("i") % F.col("s")).alias("j")))
    back = F.when((rest > 0) & (F.col("i") >= rest), F.struct(F.lit(1).alias("d"), F.floor((F.col("i") - rest) / F.col("s")).alias("seg"), ((F.col("i") - rest) % F.col("s")).alias("j")))
    points = each.select("key", "s", "y", F.explode(F.filter(F.array(ahead, back), lambda p: p.isNotNull())).alias("p"))
    j, y = F.col("p.j").cast("double"), F.col("y")
    resid = (F.regr_syy(y, j) - F.regr_sxy(y, j) * F.regr_sxy(y, j) / F.regr_sxx(y, j)) / F.col("s")
    f2 = points.groupBy("key", "s", "p.d", "p.seg").agg(resid.alias("f2")).where("f2 > 0")
    q = f2.withColumn("q", F.explode(F.array(*(F.lit(float(v)) for v in qs if v))))
    return q.groupBy("key", "s", "q").agg(F.pow(F.avg(F.pow("f2", F.col("q") / 2)), 1 / F.col("q")).alias("fq"))


def hurst(f: DataFrame) -> DataFrame:
    """key, q, h: slope of ln F over ln s, from three finite positive points at least."""
    fine = f.where((F.col("fq") > 0) & (F.col("fq") < float("inf")))
    return fine.groupBy("key", "q").agg(F.regr_slope(F.ln("fq"), F.ln("s")).alias("h"), F.count(F.lit(1)).alias("points")).where("points >= 3").drop("points")


def spectrum(h: DataFrame) -> DataFrame:
    """key, q, h, tau, alpha, f: alpha by central differences of unequal steps, one-sided at the ends."""
    w = Window.partitionBy("key").orderBy("q")
    t = h.withColumn("tau", F.col("q") * F.col("h") - 1)
    t = t.select("*", *(F.lag(c).over(w).alias(f"{c}_a") for c in ("q", "tau")), *(F.lead(c).over(w).alias(f"{c}_b") for c in ("q", "tau")))
    a, b = F.col("q") - F.col("q_a"), F.col("q_b") - F.col("q")
    inner = (a * a * F.col("tau_b") + (b * b - a * a) * F.col("tau") - b * b * F.col("tau_a")) / (a * b * (a + b))
    alpha = F.when(F.col("q_a").isNull(), (F.col("tau_b") - F.col("tau")) / b).when(F.col("q_b").isNull(), (F.col("tau") - F.col("tau_a")) / a).otherwise(inner)
    return t.select("key", "q", "h", "tau", alpha.alias("alpha")).withColumn("f", F.col("q") * F.col("alpha") - F.col("tau"))


def descriptors(sp: DataFrame) -> DataFrame:
    """The twelve summaries of a spectrum, and its number of q; the peak is the first of the largest f."""
    peak = lambda c: F.max_by(c, F.struct(F.round("f", 9), -F.col("q")))
    lo, hi, at = F.min("alpha"), F.max("alpha"), peak("alpha")
    return sp.groupBy("key").agg(
        F.avg("h").alias("hq_mean"), F.stddev_pop("h").alias("hq_std"), F.min("h").alias("hq_min"), F.max("h").alias("hq_max"),
        F.avg("tau").alias("tau_mean"), F.stddev_pop("tau").alias("tau_std"),
        F.avg("alpha").alias("alpha_mean"), F.stddev_pop("alpha").alias("alpha_std"),
        (hi - lo).alias("spectrum_width"), at.alias("spectrum_peak_alpha"), peak("f").alias("spectrum_peak_f"),
        ((at - lo) / (hi - at + EPS)).alias("spectrum_asymmetry"), (F.max("h") - F.min("h")).alias("delta_h"), F.count(F.lit(1)).alias("num_q"),
    )


def shannon(s: DataFrame) -> DataFrame:
    """key, entropy in bits over distinct values."""
    counts = s.groupBy("key", "x").agg(F.count(F.lit(1)).alias("c"))
    each = joined(counts, s.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    p = F.col("c") / F.col("n")
    return each.select("key", (-p * F.log2(p)).alias("t")).groupBy("key").agg(F.sum("t").alias("shannon"))


def _steps(s: DataFrame) -> DataFrame:
    """s with dx, the step from the point before, and last, the step before that."""
    x = F.col("x")
    rows = with_neighbours(s, 2).withColumn("dx", x - F.lag(x).over(in_block())).withColumn("last", F.lag(x).over(in_block()) - F.lag(x, 2).over(in_block()))
    return own(rows)


def petrosian(s: DataFrame) -> DataFrame:
    """key, petrosian: from the sign changes of the first difference."""
    flip = F.col("dx") * F.col("last") < 0
    c = _steps(s).withColumn("flip", flip).groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.coalesce("flip", F.lit(False))).alias("d"))
    n = F.col("n")
    return c.select("key", F.try_divide(F.log10(n), F.log10(n) + F.log10(n / (n + 0.4 * F.col("d")))).alias("petrosian"))


def sevcik(s: DataFrame) -> DataFrame:
    """key, sevcik: length of the curve in the unit square; null for fewer than three points or a constant."""
    ends = s.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    unit = joined(s, ends).select("key", "i", "n", F.try_divide(F.col("x") - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("x"))
    c = _steps(unit).groupBy("key").agg(F.first("n").alias("n"), F.sum(F.sqrt(F.col("dx") * F.col("dx") + 1 / ((F.col("n") - 1) * (F.col("n") - 1)))).alias("length"))
    return c.select("key", F.when(F.col("n") > 2, 1 + F.ln("length") / F.ln(2 * (F.col("n") - 1))).alias("sevcik"))


def delta(s: DataFrame, half: int = 4) -> DataFrame:
    """key, i, delta: slope of a line through each point's 2 half + 1 neighbours; null at the ends."""
    w = in_block()
    norm = float(2 * sum(k * k for k in range(1, half + 1)))
    slope = sum((F.lead("x", k).over(w) - F.lag("x", k).over(w)) * float(k) for k in range(1, half + 1)) / norm
    return own(with_neighbours(s, half).withColumn("delta", slope)).select("key", "i", "delta")


def interpolated(sp: DataFrame, points: int, lo: float, hi: float) -> DataFrame:
    """key, k, alpha, f: f(alpha) on a common grid by straight lines, null outside; a range join on neighbours of a few points."""
    w = Window.partitionBy("key").orderBy("alpha", "q")
    span = sp.select("key", F.col("alpha").alias("a0"), F.col("f").alias("f0"), F.lead("alpha").over(w).alias("a1"), F.lead("f").over(w).alias("f1")).where("a1 > a0")
    step = (hi - lo) / (points - 1)
    first, last = F.ceil((F.col("a0") - lo) / step - 1e-9), F.ceil((F.col("a1") - lo) / step - 1e-9) - 1
    inside = span.withColumn("first", F.greatest(F.lit(0), first)).withColumn("last", F.least(F.lit(points - 1), last)).where("first <= last")
    each = inside.withColumn("k", F.explode(F.sequence("first", "last"))).withColumn("alpha", F.col("k") * step + lo)
    return each.select("key", "k", "alpha", (F.col("f0") + (F.col("f1") - F.col("f0")) * (F.col("alpha") - F.col("a0")) / (F.col("a1") - F.col("a0"))).alias("f"))
