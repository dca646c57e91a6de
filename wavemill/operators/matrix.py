"""The feature matrix of two-channel windows: one grouped pass packs the samples, then every family is a declared struct.

A window is a row with its two channels as arrays; families are expressions over those arrays, so after the pack there is
no shuffle, no join and no Python. A family that has nothing to measure (no beats, a flat channel) gives its stated default or
NULL in its own columns and leaves the others alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once per row, also inside of lambdas."""
    return F.transform(F.array(value), use)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def spread(a: Column) -> Column:
    """Population standard deviation."""
    return let(mean(a), lambda m: F.sqrt(mean(F.transform(a, lambda v: (v - m) * (v - m)))))


def median(a: Column) -> Column:
    n = F.size(a)
    at = lambda s, k: F.get(s, F.floor(k).cast("int"))
    return let(F.array_sort(a), lambda s: (at(s, (n - 1) / 2) + at(s, n / 2)) / 2)


def steps(a: Column) -> Column:
    """Differences of neighbours."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(2), n), F.slice(a, F.lit(1), n), lambda b, c: b - c)


def share(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_divide(F.size(F.filter(a, test)).cast("double"), F.size(a))


def places(n: Column | int) -> Column:
    """0 .. n - 1 for n > 0."""
    return F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1)


def normal(x: Column) -> Column:
    return let(mean(x), lambda m: let(spread(x), lambda s: F.transform(x, lambda v: (v - m) / (s + F.lit(1e-8)))))


def beats(x: Column, distance: int) -> Column:
    """Local maxima, the highest first (of equal ones the later); those nearer than the distance to a kept one go. In order of place."""
    up = F.filter(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("at"))), lambda p: (p["at"] > 0) & (p["at"] < F.size(x) - 1) & (p["v"] > F.get(x, p["at"] - 1)) & (p["v"] > F.get(x, p["at"] + 1)))
    ranked = F.reverse(F.array_sort(up))
    none = F.array().cast("array<int>")
    kept = F.aggregate(ranked, none, lambda kept, p: F.when(F.exists(kept, lambda q: F.abs(q - p["at"]) < distance), kept).otherwise(F.concat(kept, F.array(p["at"]))))
    return F.array_sort(kept)


def feet(x: Column, peaks: Column) -> Column:
    """Per peak the lowest sample since the peak before (or the start); of equal ones the earlier."""
    before = F.concat(F.array(F.lit(0)), F.slice(peaks, F.lit(1), F.greatest(F.size(peaks) - 1, F.lit(0))))
    low = lambda a, b: F.array_min(F.transform(F.sequence(a, b), lambda i: F.struct(F.get(x, i).alias("v"), i.alias("at"))))["at"]
    return F.transform(F.arrays_zip(before.alias("a"), peaks.alias("b")), lambda s: low(s["a"], s["b"]))


# ---------------------------------------------------------------- families: each gives a struct of named columns


def rate(name: str, pk: Column, n: int, fs: float) -> Column:
    """Count, count in the last 5 s, rate, spread, extremes and irregularity of the intervals, gaps to the end and at most."""
    two = F.size(pk) >= 2
    rr = F.transform(steps(pk), lambda d: d / F.lit(fs))
    of = lambda value, default: F.when(two, value).otherwise(F.lit(default))
    irregular = let(median(rr), lambda m: share(rr, lambda v: F.abs(v - m) > F.lit(0.2) * m))
    gaps = steps(F.concat(F.array(F.lit(0)), pk, F.array(F.lit(n))))
    found = {
        "n": F.size(pk), "n_last5s": F.size(F.filter(pk, lambda p: p >= n - 5 * fs)), "hr": of(F.lit(60.0) / median(rr), 0.0), "rr_cv": of(spread(rr) / (mean(rr) + F.lit(1e-8)), 0.0),
        "rr_max": of(F.array_max(rr), n / fs), "rr_min": of(F.array_min(rr), n / fs), "rmssd": F.when(F.size(pk) > 2, F.sqrt(mean(F.transform(steps(rr), lambda d: d * d)))).otherwise(0.0),
        "irregular_frac": of(irregular, 1.0), "gap_to_end": (F.lit(n) - F.coalesce(F.get(pk, F.size(pk) - 1), F.lit(0))) / F.lit(fs), "longest_gap": F.array_max(gaps) / F.lit(fs),
    }
    return F.struct(*(v.cast("double").alias(f"{name}_{k}") for k, v in found.items()))


def quality(name: str, x: Column, n: int, fs: float, band: tuple[float, float]) -> Column:
    """Excess kurtosis, skewness, spectral entropy, shares of power in the band, below 0.5 Hz and in the top, share of flat steps."""
    z = let(mean(x), lambda m: let(spread(x), lambda s: F.transform(x, lambda v: F.try_divide(v - m, s))))
    w = 2 * math.pi / n
    part = lambda turn, c, k: total(F.transform(c, lambda v, i: v * turn(k * i * F.lit(w))))
    power = lambda c: F.transform(places(n // 2 + 1), lambda k: F.pow(part(F.cos, c, k), F.lit(2)) + F.pow(part(F.sin, c, k), F.lit(2)))
    centred = let(mean(x), lambda m: F.transform(x, lambda v: v - m))
    spectrum = let(power(centred), lambda p: let(total(p) + F.lit(1e-12), lambda t: F.transform(p, lambda v: v / t)))
    hz = lambda k: k * F.lit(fs / n)
    within = lambda p, test: total(F.transform(p, lambda v, k: F.when(test(hz(k)), v).otherwise(0.0)))

    def made(p: Column) -> Column:
        entropy = -total(F.transform(p, lambda v: v * F.log(v + F.lit(1e-12)))) / F.lit(math.log(n // 2 + 1))
        found = {
            "kurt": mean(F.transform(z, lambda v: F.pow(v, F.lit(4)))) - 3, "skew": mean(F.transform(z, lambda v: F.pow(v, F.lit(3)))), "spec_entropy": entropy, "inband_power": within(p, lambda f: (f >= band[0]) & (f <= band[1])),
            "lowf_power": within(p, lambda f: f < 0.5), "highf_power": within(p, lambda f: f > 0.46 * fs), "flat_frac": share(steps(x), lambda d: F.abs(d) < 1e-3),
        }
        return F.struct(*(v.cast("double").alias(f"{name}_{k}") for k, v in found.items()))

    return let(spectrum, made)


def template(name: str, x: Column, pk: Column, n: int, half: int) -> Column:
    """Mean and least correlation of each beat with the point-wise median beat; 0 with fewer than three whole beats."""
    whole = F.filter(pk, lambda p: (p >= half) & (p + half <= n))
    cut = F.transform(whole, lambda p: F.slice(x, p - half + 1, F.lit(2 * half)))
    middle = lambda b: F.transform(places(2 * half), lambda o: median(F.transform(b, lambda v: F.get(v, o))))
    flat = lambda v: let(mean(v), lambda m: F.transform(v, lambda u: u - m))
    dot = lambda a, b: total(F.zip_with(a, b, lambda u, v: u * v))
    against = lambda v, t: let(flat(v), lambda c: F.coalesce(F.try_divide(dot(c, t), F.sqrt(dot(c, c) * dot(t, t))), F.lit(0.0)))
    found = let(cut, lambda b: let(flat(middle(b)), lambda t: F.transform(b, lambda v: against(v, t))))
    enough = F.size(whole) >= 3
    return let(F.when(enough, found), lambda c: F.struct(F.coalesce(mean(c), F.lit(0.0)).alias(f"{name}_tmpl_corr"), F.coalesce(F.array_min(c), F.lit(0.0)).alias(f"{name}_tmpl_corr_min")))


def period(name: str, x: Column, n: int, low: int, high: int) -> Column:
    """Largest autocorrelation at lags of a beat."""
    at = lambda z, lag: total(F.zip_with(F.slice(z, F.lit(1), F.lit(n) - lag), F.slice(z, lag + 1, F.lit(n) - lag), lambda a, b: a * b)) / F.lit(n)
    return F.struct(let(normal(x), lambda z: F.array_max(F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda lag: at(z, lag)))).alias(f"{name}_acf_peak"))


def agreement(ecg: Column, r: Column, pk: Column, ft: Column, n: int, fs: float) -> Column:
    """What the two channels' beats say of each other: rates, counts, delays from a beat to the first foot, beats without a partner."""
    hr = lambda p: F.when(F.size(p) >= 2, F.lit(60.0 * fs) / median(F.transform(steps(p), lambda d: d.cast("double")))).otherwise(0.0)
    last = lambda p: F.size(F.filter(p, lambda v: v >= n - 5 * fs))
    delay = lambda p: F.array_min(F.filter(F.transform(ft, lambda f: (f - p) / F.lit(fs)), lambda d: (d >= 0.08) & (d <= 0.6)))
    delays = lambda p: F.filter(F.transform(p, delay), lambda d: d.isNotNull())
    recent = F.slice(r, F.greatest(F.size(r) - 5, F.lit(1)), F.lit(6))
    led = share(pk, lambda p: F.exists(r, lambda b: ((p - b) / F.lit(fs) > 0.1) & ((p - b) / F.lit(fs) < 0.9)))
    top = F.transform(r, lambda i: F.abs(F.get(ecg, i)))

    def made(d: Column) -> Column:
        found = {
            "ecg_amp_cv": F.when(F.size(r) > 0, spread(top) / (mean(top) + F.lit(1e-8))).otherwise(0.0), "hr_abs_diff": F.abs(hr(r) - hr(pk)), "beat_count_ratio": (F.size(r) + 1) / (F.size(pk) + 1), "beat_count_last5s_diff": last(r) - last(pk),
            "ecg_beats_with_pulse_frac": F.size(d) / F.greatest(F.size(r), F.lit(1)), "recent_beats_with_pulse_frac": F.size(delays(recent)) / F.greatest(F.least(F.size(r), F.lit(6)), F.lit(1)),
            "ptt_mean": F.coalesce(mean(d), F.lit(-1.0)), "ptt_std": F.when(F.size(d) > 1, spread(d)).otherwise(-1.0), "ptt_median": F.coalesce(median(d), F.lit(-1.0)),
            "ptt_cv": F.when(F.size(d) > 1, spread(d) / (mean(d) + F.lit(1e-8))).otherwise(-1.0), "ppg_peaks_with_r_frac": F.coalesce(led, F.lit(0.0)),
        }
        return F.struct(*(v.cast("double").alias(k) for k, v in found.items()))

    return let(delays(r), made)


def coupling(r: Column, pulse: Column, n: int, fs: float, sigma: float, reach: int) -> Column:
    """Peak and lag of the correlation between the smoothed train of beats and the pulse, over lags up to 0.8 s."""
    bump = lambda d: F.when(F.abs(d) <= reach, F.exp(-(d * d).cast("double") / F.lit(2 * sigma * sigma))).otherwise(0.0)
    train = F.transform(places(n), lambda i: total(F.transform(r, lambda p: bump(i - p))))
    at = lambda a, b, lag: total(F.zip_with(F.slice(a, F.lit(1), F.lit(n) - lag), F.slice(b, lag + 1, F.lit(n) - lag), lambda u, v: u * v)) / (F.lit(n) - lag)
    lags = F.sequence(F.lit(0), F.lit(int(0.8 * fs) - 1))
    tried = lambda a, b: F.transform(lags, lambda lag: F.struct(F.round(at(a, b, lag), 9).alias("c"), (-lag).alias("late")))
    best = let(normal(train), lambda a: let(normal(pulse), lambda b: F.array_max(tried(a, b))))
    return let(best, lambda m: F.struct(m["c"].alias("xcorr_peak"), (-m["late"] / F.lit(fs)).alias("xcorr_lag_s")))


def pack(rows: DataFrame, key: str, channel: Column) -> DataFrame:
    """Long rows (key, i, x) to one row per key with the arrays ecg (channel 0) and pulse (channel 1)."""
    side = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("_c") == c, F.struct("i", "x")))), lambda s: s["x"])
    return rows.withColumn("_c", channel).groupBy(key).agg(side(0).alias("ecg"), side(1).alias("pulse"))


def feature_matrix(packed: DataFrame, key: str, n: int, fs: float, distance: int) -> DataFrame:
    """(key, 53 columns) of windows of n samples a channel; others get NULL in every column. Not finite is NULL, the rest is held within 1e6."""
    whole = (F.size("ecg") == n) & (F.size("pulse") == n)
    side = lambda c: F.when(whole, F.col(c))
    rows = packed.select(key, side("ecg").alias("ecg"), side("pulse").alias("pulse"))
    rows = rows.select("*", beats(F.col("ecg"), distance).alias("r"), beats(F.col("pulse"), distance).alias("pk"))
    rows = rows.select("*", feet(F.col("pulse"), F.col("pk")).alias("ft"))
    ecg, pulse, r, pk, ft = (F.col(c) for c in ("ecg", "pulse", "r", "pk", "ft"))
    low, high = max(1, int(0.3 * fs)), int(1.5 * fs)
    families = [
        rate("ecg", r, n, fs), rate("ppg", pk, n, fs), quality("ecg", ecg, n, fs, (0.1 * fs, 0.3 * fs)), quality("ppg", pulse, n, fs, (0.02 * fs, 0.1 * fs)),
        template("ecg", ecg, r, n, max(2, int(0.25 * fs))), template("ppg", pulse, pk, n, max(2, int(0.4 * fs))), period("ecg", ecg, n, low, high), period("ppg", pulse, n, low, high),
        agreement(ecg, r, pk, ft, n, fs), coupling(r, pulse, n, fs, max(0.5, 0.02 * fs), max(1, int(0.05 * fs))),
    ]
    rows = rows.select(key, ecg.isNotNull().alias("whole"), *(f.alias(f"family{k}") for k, f in enumerate(families)))
    names = [f"family{k}.{c}" for k in range(len(families)) for c in rows.schema[f"family{k}"].dataType.names]
    finite = lambda c: F.when(F.col("whole") & ~F.isnan(c) & (F.abs(c) != float("inf")), F.least(F.lit(1e6), F.greatest(F.lit(-1e6), F.col(c)))).alias(c.split(".")[1])
    return rows.select(key, *map(finite, names))
