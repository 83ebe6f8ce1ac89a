"""Numpy kernels for what expressions can't say: spectra, cepstra, pitch, template entropies.

Each takes one signal as an array and runs inside grouped Arrow batches; a
failure becomes a status, never a failed job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, HOP = 64, 16
LEAST_SIGNAL, ENTROPY_RATE = 16, 8000
#: Partitions at least in which series are spread: a few long ones take a task each, however small their rows are together.
SPREAD = 200
#: Points below which templates are compared pair by pair; bits of the places compared so at the ends of a range; questions at once.
PAIRS, LEAF, SLICE = 2048, 6, 65_536


def frames(x: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def power(x: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    return np.abs(np.fft.rfft(frames(x, size, hop) * np.hanning(size), axis=1)) ** 2


def spectral_moments(x: np.ndarray, rate: float) -> dict[str, float]:
    """Mean over frames of centroid, bandwidth, 85 % rolloff and flatness."""
    p = power(x) + 1e-12
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    total = p.sum(1)
    centre = (p * f).sum(1) / total
    width = np.sqrt((p * (f - centre[:, None]) ** 2).sum(1) / total)
    roll = f[(np.cumsum(p, 1) >= 0.85 * total[:, None]).argmax(1)]
    flat = np.exp(np.log(p).mean(1)) / p.mean(1)
    return {"centroid": centre.mean(), "bandwidth": width.mean(), "rolloff": roll.mean(), "flatness": flat.mean()}


def mel_filters(rate: float, bands: int = 20, size: int = FRAME) -> np.ndarray:
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / rate)
    up, down = (f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down))


def cosines(bands: int, count: int) -> np.ndarray:
    """The first rows of the orthonormal cosine transform."""
    basis = np.cos(np.pi / bands * (np.arange(bands) + 0.5)[None, :] * np.arange(count)[:, None]) * np.sqrt(2 / bands)
    basis[0] /= np.sqrt(2)
    return basis


def mfcc(x: np.ndarray, rate: float, count: int = 13) -> np.ndarray:
    """Frames by coefficients: orthonormal cosine transform of log mel energies."""
    energies = np.log(power(x) @ mel_filters(rate).T + 1e-10)
    return energies @ cosines(energies.shape[1], count).T


def yin(x: np.ndarray, rate: float, lowest: float, highest: float, limit: float = 0.1, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Pitch of each frame: the first dip of the normalised difference function under the limit, or its least; lag by lag for all frames."""
    half = size // 2
    lo, hi = max(1, int(rate / highest)), min(half, int(rate / lowest))
    f = frames(x, size, hop)
    d = np.zeros((len(f), hi + 1))
    for t in range(1, hi + 1):
        d[:, t] = ((f[:, :half] - f[:, t : t + half]) ** 2).sum(1)
    c = np.ones_like(d)
    c[:, 1:] = d[:, 1:] * np.arange(1, hi + 1) / np.maximum(np.cumsum(d[:, 1:], 1), 1e-12)
    under = c[:, lo:] < limit
    t = lo + np.where(under.any(1), under.argmax(1), c[:, lo:].argmin(1))
    row = np.arange(len(f))
    while (falls := (t < hi) & (c[row, np.minimum(t + 1, hi)] < c[row, t])).any():
        t = t + falls
    return rate / t


def finite_stats(name: str, values: np.ndarray) -> dict[str, float | None]:
    """Mean, population deviation, least and largest of the finite values; null if there is none."""
    v = np.asarray(values, float)
    v = v[np.isfinite(v)]
    made = (v.mean(), v.std(), v.min(), v.max()) if len(v) else (None,) * 4
    return {f"{name}_{s}": m if m is None else float(m) for s, m in zip(("mean", "std", "min", "max"), made, strict=True)}


def slopes(rows: np.ndarray, width: int = 9) -> np.ndarray:
    """Slope of a line through each frame and its neighbours, along the first axis; at the ends, of the first or last such line."""
    half = width // 2
    if len(rows) < width:
        return np.zeros_like(rows)
    k = np.arange(-half, half + 1)
    inner = np.tensordot(np.lib.stride_tricks.sliding_window_view(rows, width, axis=0), k, ([-1], [0])) / (k * k).sum()
    return np.concatenate([np.repeat(inner[:1], half, 0), inner, np.repeat(inner[-1:], half, 0)])


def log_mel(x: np.ndarray, rate: float, size: int = 2048, hop: int = 512, bands: int = 40) -> np.ndarray:
    """Frames by bands: decibels of mel energies of centred frames."""
    padded = np.pad(x, size // 2)
    energy = power(padded, size, hop) @ mel_filters(rate, bands, size).T
    return 10 * np.log10(np.maximum(energy, 1e-10))


#: The 84 acoustic columns, by family.
ACOUSTIC = [
    *(f"ac_time_{n}" for n in ("energy", "abs_mean", "peak", "crest_factor")),
    *(f"ac_{n}_{s}" for n in ("rms", "zcr", "spec_centroid", "spec_bandwidth", "spec_rolloff", "spec_flatness", "f0") for s in ("mean", "std", "min", "max")),
    *(f"ac_mfcc{k}_{s}" for k in range(1, 14) for s in ("mean", "std", "delta_mean", "delta_std")),
]


def acoustic(x: np.ndarray, rate: float, size: int = 2048, hop: int = 512, lowest: float = 65.406, highest: float = 2093.005) -> dict[str, float | None]:
    """All of ACOUSTIC for one signal: centred frames, pitch from C2 to C7 as far as the frame allows."""
    peak, energy = float(np.abs(x).max()), float((x * x).mean())
    out: dict[str, float | None] = {"ac_time_energy": energy, "ac_time_abs_mean": float(np.abs(x).mean()), "ac_time_peak": peak, "ac_time_crest_factor": peak / (energy**0.5 + 1e-12)}
    own = frames(np.pad(x, size // 2), size, hop)
    signs = np.signbit(frames(np.pad(x, size // 2, mode="edge"), size, hop))
    s = np.abs(np.fft.rfft(own * np.hanning(size + 1)[:-1], axis=1))
    f = np.fft.rfftfreq(size, 1 / rate)
    total = s.sum(1)
    share = s / np.where(total > 0, total, 1)[:, None]
    centre = share @ f
    p = np.maximum(s * s, 1e-10)
    out |= finite_stats("ac_rms", np.sqrt((own * own).mean(1)))
    out |= finite_stats("ac_zcr", (signs[:, 1:] != signs[:, :-1]).sum(1) / size)
    out |= finite_stats("ac_spec_centroid", centre)
    out |= finite_stats("ac_spec_bandwidth", np.sqrt((share * (f - centre[:, None]) ** 2).sum(1)))
    out |= finite_stats("ac_spec_rolloff", f[(np.cumsum(s, 1) >= 0.85 * total[:, None]).argmax(1)])
    out |= finite_stats("ac_spec_flatness", np.exp(np.log(p).mean(1)) / p.mean(1))
    lowest = max(lowest, rate / (size // 2))
    out |= finite_stats("ac_f0", yin(x, rate, lowest, min(highest, rate / 4), size=size, hop=hop) if highest > lowest else np.zeros(0))
    mel = log_mel(x, rate, size, hop)
    basis = cosines(mel.shape[1], 13)
    c = mel @ basis.T
    d = slopes(c)
    for k in range(13):
        out |= {f"ac_mfcc{k + 1}_{n}": float(v) for n, v in (("mean", c[:, k].mean()), ("std", c[:, k].std()), ("delta_mean", d[:, k].mean()), ("delta_std", d[:, k].std()))}
    return out


def _pairs(x: np.ndarray, m: int, r: float, cells: int = 4_000_000) -> np.ndarray:
    """How many templates of length m lie within r of each, itself included, pair by pair.

    Templates are sorted by their first value, so that a block meets only those
    whose first value can lie within r; blocks have bounded memory.
    """
    t = np.lib.stride_tricks.sliding_window_view(x, m)
    order = np.argsort(t[:, 0], kind="stable")
    t = t[order]
    first, reach, block = t[:, 0], r * (1 + 1e-9) + 1e-9 * np.abs(x).max(initial=0.0), max(1, cells // max(1, len(t)))
    found = np.zeros(len(t), np.int64)
    for i in range(0, len(t), block):
        own = t[i : i + block]
        a, b = np.searchsorted(first, own[0, 0] - reach), np.searchsorted(first, own[-1, 0] + reach, side="right")
        within = np.ones((len(own), b - a), bool)
        for k in range(m):
            within &= np.abs(own[:, k, None] - t[None, a:b, k]) <= r
        found[order[i : i + block]] = within.sum(1)
    return found


def reaches(x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rank of each value, and for each rank the first rank within r of it and the first beyond: rounded as the difference of two values is."""
    v, rank = np.unique(x, return_inverse=True)
    lo, hi = np.zeros(len(v), np.int64), np.arange(len(v))
    while (wide := lo < hi).any():
        mid = (lo + hi) // 2
        near = v - v[mid] <= r
        lo, hi = np.where(wide & ~near, mid + 1, lo), np.where(wide & near, mid, hi)
    return rank, lo, np.searchsorted(lo, np.arange(len(v)), side="right")


def below(values: np.ndarray, bits: int, start: np.ndarray, place: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of the first `place` values of the block at start are below limit; each block of 2^bits values has 0, 1, ... in some order.

    A wavelet tree, from the highest bit: values are parted by it in their order,
    so that each half of a block is a block again, and all questions go down together.
    """
    found, start, place = np.where(limit >> bits, place, 0), start.copy(), place.copy()
    ones = np.zeros(len(values) + 1, np.int32)
    for bit in reversed(range(bits)):
        high = (values >> bit & 1).astype(bool)
        np.cumsum(high, out=ones[1:])
        for i in range(0, len(start), SLICE):
            own = slice(i, i + SLICE)
            up = limit[own] >> bit & 1
            above = ones[start[own] + place[own]] - (start[own] >> 1)
            under = place[own] - above
            found[own] += under * up
            place[own] = np.where(up, above, under)
            start[own] += up << bit
        values = np.concatenate([values[~high].reshape(-1, 1 << bit), values[high].reshape(-1, 1 << bit)], 1).ravel()
    return found


def in_boxes(rows: np.ndarray, columns: np.ndarray, bits: int, base: np.ndarray, box: list[np.ndarray]) -> np.ndarray:
    """How many points of the block at base lie in each box [row, row), [column, column) of keys; both are keys of all points, rows and columns ascending by block."""
    order, at = np.argsort(rows, kind="stable"), np.argsort(columns, kind="stable")
    values = np.empty(len(rows), np.int32)
    values[at] = np.arange(len(rows)) & ((1 << bits) - 1)
    keys = (rows[order], rows[order], columns[at], columns[at])
    r0, r1, c0, c1 = ((np.searchsorted(k, b) - base).astype(np.int32) for k, b in zip(keys, box, strict=True))
    start = np.tile(base.astype(np.int32), 4)
    corner = below(values[order], bits, start, np.concatenate([r1, r0, r1, r0]), np.concatenate([c1, c1, c0, c0])).reshape(4, -1)
    return corner[0].astype(np.int64) - corner[1] - corner[2] + corner[3]


def _pairs_of_two(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Templates of length 2: boxes over one block of all points."""
    a, b, n = rank[:-1], rank[1:], len(rank) - 1
    bits = (n - 1).bit_length()
    pad = np.arange(len(lo), len(lo) + (1 << bits) - n)  # beyond every box
    return in_boxes(np.r_[a, pad], np.r_[b, pad], bits, np.zeros(n, np.int64), [lo[a], hi[a], lo[b], hi[b]])


def _pairs_of_three(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Templates of length 3, sorted by their first value: its range is cut into blocks of 2^k places, at most two of each size, with boxes over the others."""
    order = np.argsort(rank[:-2], kind="stable")
    a, b, c = rank[order], rank[order + 1], rank[order + 2]
    n, ranks, found = len(a), len(lo), np.zeros(len(a), np.int64)
    p, q = np.searchsorted(a, lo[a]), np.searchsorted(a, hi[a])
    left, right = -(-p >> LEAF), q >> LEAF
    turn = np.minimum(q, left << LEAF)
    for first, last in ((p, turn), (np.maximum(right << LEAF, turn), q)):  # less than a block at each end
        for i in range(0, n, SLICE >> LEAF):
            own = slice(i, i + (SLICE >> LEAF))
            at = first[own, None] + np.arange(1 << LEAF)
            inside = at < last[own, None]
            at = np.minimum(at, n - 1)
            for x in (b, c):
                y = x[at]
                inside &= (y >= lo[x[own], None]) & (y < hi[x[own], None])
            found[own] += inside.sum(1)
    level = LEAF
    while (live := left < right).any():
        starts, ends = np.flatnonzero(live & (left & 1 == 1)), np.flatnonzero(live & (right & 1 == 1))
        right[ends] -= 1
        who, block = np.r_[starts, ends], np.r_[left[starts], right[ends]]
        left[starts] += 1
        if len(who):
            whole = n >> level << level
            shift = (np.arange(whole) >> level) * ranks
            box = [block * ranks + bound[x[who]] for x in (b, c) for bound in (lo, hi)]
            met = in_boxes(shift + b[:whole], shift + c[:whole], level, block << level, box)
            found[starts] += met[: len(starts)]
            found[ends] += met[len(starts) :]
        left, right, level = left >> 1, right >> 1, level + 1
    out = np.empty(n, np.int64)
    out[order] = found
    return out


def _matches(x: np.ndarray, m: int, r: float) -> np.ndarray:
    """How many templates of length m lie within r of each, itself included: the same numbers as pair by pair, in n log(n)^2 steps for the usual lengths."""
    if len(x) < PAIRS or m not in (2, 3) or not r >= 0:
        return _pairs(x, m, r)
    return (_pairs_of_two if m == 2 else _pairs_of_three)(*reaches(x, r))


def entropies(x: np.ndarray, m: int = 2) -> tuple[float, float]:
    """Sample and approximate entropy, from one count of each length; the first leaves out the last template of length m."""
    r = 0.2 * x.std(ddof=1)
    short, long = _matches(x, m, r), _matches(x, m + 1, r)
    b, a = int((short - 1).sum() - 2 * (short[-1] - 1)), int((long - 1).sum())
    phi = lambda c: np.log(c / len(c)).mean()
    return float(-np.log(a / b)) if a > 0 and b > 0 else float("nan"), float(phi(short) - phi(long))


def sample_entropy(x: np.ndarray, m: int = 2) -> float:
    return entropies(x, m)[0]


def approximate_entropy(x: np.ndarray, m: int = 2) -> float:
    return entropies(x, m)[1]


def features(x: np.ndarray, rate: float) -> dict[str, float]:
    out = spectral_moments(x, rate)
    coefficients = mfcc(x, rate)
    out |= {f"mfcc{k + 1}_mean": v for k, v in enumerate(coefficients.mean(0))}
    out |= {f"mfcc{k + 1}_std": v for k, v in enumerate(coefficients.std(0))}
    out["f0_mean"] = yin(x, rate, rate / (FRAME // 2), rate / 4).mean()
    return out


FEATURES = ["centroid", "bandwidth", "rolloff", "flatness", *(f"mfcc{k}_{s}" for s in ("mean", "std") for k in range(1, 14)), "f0_mean"]


def extracted(s: DataFrame, rate: float) -> DataFrame:
    """key, status, error and the features of each series(key, i, x); a series is one signal, so one task can hold it.

    Entropies take each (rate // ENTROPY_RATE)th point, all below that rate. Status is ok, empty_signal, short_signal or failed.
    """
    names = [*FEATURES, "sample_entropy", "approximate_entropy"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("i")["x"].to_numpy(float)
        x = x[np.isfinite(x)]
        row: dict[str, object] = {"key": key[0], "status": "ok", "error": None} | {n: None for n in names}
        if len(x) < LEAST_SIGNAL:
            row["status"] = "short_signal" if len(x) else "empty_signal"
        else:
            try:
                row |= features(x, rate)
                thin = x[:: max(1, int(rate) // ENTROPY_RATE)]
                row |= dict(zip(("sample_entropy", "approximate_entropy"), entropies(thin), strict=True))
            except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
                row |= {"status": "failed", "error": str(e)}
        return pd.DataFrame([row])

    kind = s.schema["key"].dataType.simpleString()
    schema = f"key {kind}, status string, error string, " + ", ".join(f"{n} double" for n in names)
    parts = max(SPREAD, int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return s.select("key", "i", F.col("x").cast("double").alias("x")).repartition(parts, "key").groupBy("key").applyInPandas(one, schema)


def fluctuation(x: np.ndarray, scales: list[int], qs: list[float], order: int = 1) -> np.ndarray:
    """F_q(s), scales by q, of one signal's profile with polynomials of any order taken out of its segments, from both ends; NaN where none fits."""
    y = np.cumsum(x - x.mean())
    out = np.full((len(scales), len(qs)), np.nan)
    for i, s in enumerate(scales):
        if s <= order + 1 or len(y) < 2 * s:
            continue
        whole = len(y) // s * s
        parts = [y[:whole].reshape(-1, s)] + ([y[len(y) - whole :].reshape(-1, s)] if whole < len(y) else [])
        base = np.linalg.qr(np.vander(np.linspace(-1, 1, s), order + 1))[0]
        rows = np.concatenate(parts)
        f2 = ((rows - rows @ base @ base.T) ** 2).mean(1)
        f2 = f2[f2 > 0]
        if len(f2):
            out[i] = [np.exp(0.5 * np.log(f2).mean()) if q == 0 else (f2 ** (q / 2)).mean() ** (1 / q) for q in qs]
    return out


def acoustic_extracted(s: DataFrame, rate: float, size: int = 2048, hop: int = 512) -> DataFrame:
    """key, acoustic_status, acoustic_error and the 84 columns of ACOUSTIC of each series(key, i, x): ok, empty_signal or failed."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("i")["x"].to_numpy(float)
        x = x[np.isfinite(x)]
        row: dict[str, object] = {"key": key[0], "acoustic_status": "ok" if len(x) else "empty_signal", "acoustic_error": None} | dict.fromkeys(ACOUSTIC)
        if len(x):
            try:
                row |= acoustic(x, rate, size, hop)
            except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
                row |= {"acoustic_status": "failed", "acoustic_error": str(e)}
        return pd.DataFrame([row])

    kind = s.schema["key"].dataType.simpleString()
    schema = f"key {kind}, acoustic_status string, acoustic_error string, " + ", ".join(f"{n} double" for n in ACOUSTIC)
    return s.select("key", "i", F.col("x").cast("double").alias("x")).groupBy("key").applyInPandas(one, schema)
