"""Per-window feature tables from beats (key, t) and samples (key, i, x). Units of t are the caller's."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .beats import samples_of


def intervals(beats: DataFrame, key: str) -> DataFrame:
    """(key, k, t, rr, d): beat number, interval to the previous beat, change of the interval."""
    w = W.partitionBy(key).orderBy("t")
    rows = beats.select(key, "t").distinct().withColumn("k", F.row_number().over(w)).withColumn("rr", F.col("t") - F.lag("t").over(w))
    return rows.withColumn("d", F.col("rr") - F.lag("rr").over(w))


def rate_stats(beats: DataFrame, key: str, start: float, end: float) -> DataFrame:
    """Count (all, and in the last 5 units), rate, variability, irregularity and gaps, borders included in the longest gap.

    With fewer than two beats there is no interval: rate and variation are 0, the longest and shortest interval the whole
    span, everything irregular.
    """
    rr = intervals(beats, key)
    med = rr.groupBy(key).agg(F.percentile("rr", 0.5).alias("med"))
    rows = rr.join(med, key)
    agg = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.col("t") >= end - 5.0).alias("n_last5"), F.first("med").alias("med"), (F.stddev_pop("rr") / F.avg("rr")).alias("rr_cv"), F.max("rr").alias("rr_max"), F.min("rr").alias("rr_min"),
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"), F.avg((F.abs(F.col("rr") - F.col("med")) > 0.2 * F.col("med")).cast("int")).alias("irregular"),
        (F.lit(end) - F.max("t")).alias("gap_to_end"), F.greatest(F.lit(end) - F.max("t"), F.min("t") - F.lit(start), F.coalesce(F.max("rr"), F.lit(0.0))).alias("longest_gap"),
    )
    agg = agg.withColumn("rate", F.lit(60.0) / F.nullif("med", F.lit(0.0)))
    alone = {"rate": 0.0, "rr_cv": 0.0, "rr_max": end - start, "rr_min": end - start, "irregular": 1.0}
    agg = agg.withColumns({c: F.when(F.col("n") < 2, F.lit(v)).otherwise(F.col(c)) for c, v in alone.items()})
    return agg.select(key, "n", "n_last5", "rate", "rr_cv", "rr_max", "rr_min", F.coalesce("rmssd", F.lit(0.0)).alias("rmssd"), "irregular", "gap_to_end", "longest_gap")


def hrv_features(beats: DataFrame, key: str, near: float, nearer: float, bin_width: float = 1 / 128) -> DataFrame:
    """Variability of the intervals. rr_tri: intervals over those in the fullest bin of bin_width, null where all are equal."""
    rr = intervals(beats, key)
    w = W.partitionBy(key)
    rows = rr.withColumn("med", F.percentile("rr", 0.5).over(w)).withColumn("n", F.count("rr").over(w)).withColumn("j", F.count("rr").over(w.orderBy("t")))
    rows = rows.withColumn("dev", F.abs(F.col("rr") - F.col("med"))).withColumn("bin", F.floor((F.col("rr") - F.min("rr").over(w)) / F.lit(bin_width)))
    rows = rows.withColumn("full", F.count("rr").over(W.partitionBy(key, "bin")))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    d, r = F.col("d"), F.col("rr")
    first, last = F.avg(F.when(r.isNotNull() & (F.col("j") <= third), r)), F.avg(F.when(r.isNotNull() & (F.col("j") > F.col("n") - third), r))
    var_d, var_r = F.var_pop("d"), F.var_pop("rr")
    return rows.groupBy(key).agg(
        F.stddev_pop("rr").alias("sdnn"), F.sqrt(F.avg(d * d)).alias("rmssd"), F.avg((F.abs(d) > near).cast("int")).alias("pnn50"), F.avg((F.abs(d) > nearer).cast("int")).alias("pnn20"),
        (F.max("rr") - F.min("rr")).alias("rr_range"), F.percentile("dev", 0.5).alias("rr_mad"), F.sqrt(var_d / 2).alias("sd1"), F.sqrt(F.greatest(F.lit(0.0), 2 * var_r - var_d / 2)).alias("sd2"),
        F.max_by("rr", "t").alias("last_rr"), (last / first).alias("last_first"), F.skewness("rr").alias("rr_skew"),
        F.when(F.max("rr") > F.min("rr"), F.count("rr") / F.max(F.when(r.isNotNull(), F.col("full")))).alias("rr_tri"),
    )


def rr_histogram_entropy(beats: DataFrame, key: str, low: float, high: float, bins: int = 12) -> DataFrame:
    """Shannon entropy of the interval histogram on [low, high], last edge inclusive."""
    rr = intervals(beats, key).where((F.col("rr") >= low) & (F.col("rr") <= high))
    b = F.least(F.lit(bins - 1), F.floor((F.col("rr") - low) / F.lit((high - low) / bins))).alias("b")
    n = rr.groupBy(key, b).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy(key))
    return n.withColumn("p", p).groupBy(key).agg(F.sum(-F.col("p") * F.log("p")).alias("entropy"))


def linear_trend(beats: DataFrame, key: str) -> DataFrame:
    rr = intervals(beats, key).where("rr > 0")
    return rr.groupBy(key).agg(F.regr_slope("rr", "k").alias("rr_slope"), F.regr_slope(F.lit(60.0) / F.col("rr"), "k").alias("hr_slope"))


def template_cells(rows: DataFrame, key: str, m: int, share: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of near templates on (key, cell), for keys that are not flat.

    Templates of m + 1 samples with equal values are one row with its number c. A cell is share * deviation wide in each of
    the first m samples, so templates within that distance lie in the same or in adjoining cells: the right side stands in
    its own cell, the left one goes to all 3 ** m around its own.
    """
    names = ["x", *(f"x{k}" for k in range(1, m + 1))]
    w, whole = W.partitionBy(key).orderBy("i"), W.partitionBy(key)
    t = rows.select(key, F.row_number().over(w).alias("rn"), F.count("*").over(whole).alias("n"), F.stddev_pop("x").over(whole).alias("s"), "x", *(F.lead("x", k).over(w).alias(f"x{k}") for k in range(1, m + 1)))
    t = t.where((F.col("rn") <= F.col("n") - m) & (F.col("s") >= 1e-8)).groupBy(key, (F.col("s") * share).alias("r"), *names).agg(F.count("*").alias("c"))
    # a little wider than the tolerance, so that rounding moves no near template by two cells
    t = t.withColumns({f"g{k}": F.floor(F.col(c) / (F.col("r") * 1.0001)) for k, c in enumerate(names[:m])})
    left = t.select(key, "r", F.struct(*names).alias("a"), F.col("c").alias("ca"), *(f"g{k}" for k in range(m)))
    for k in range(m):
        left = left.withColumn(f"g{k}", F.explode(F.sequence(F.col(f"g{k}") - 1, F.col(f"g{k}") + 1)))
    return left, t.select(key, F.struct(*names).alias("b"), F.col("c").alias("cb"), *(f"g{k}" for k in range(m)))


def sample_entropy(rows: DataFrame, key: str, m: int = 2, share: float = 0.2) -> DataFrame:
    """-ln(A / B) over the n - m templates of both lengths, Chebyshev distance <= share * deviation, one row per key.

    0 for a flat signal, ln(B) where no longer pair is left, NULL without any pair or with fewer than m + 4 samples. Only
    templates of adjoining cells meet, and equal ones are counted without meeting, so a long or repetitive signal makes no
    square of its samples.
    """
    left, right = template_cells(rows, key, m, share)
    near = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= F.col("r")
    pairs = left.join(right, [key, *(f"g{k}" for k in range(m))]).where((F.col("a") <= F.col("b")) & near("x"))
    for k in range(1, m):
        pairs = pairs.where(near(f"x{k}"))
    n = F.when(F.col("a") == F.col("b"), F.expr("ca * (ca - 1) div 2")).otherwise(F.col("ca") * F.col("cb"))
    c = pairs.groupBy(key).agg(F.sum(n).alias("B"), F.sum(F.when(near(f"x{m}"), n).otherwise(0)).alias("A"))
    all_ = rows.groupBy(key).agg(F.count("*").alias("n"), F.stddev_pop("x").alias("s")).join(c, key, "left")
    value = F.when(F.col("n") < m + 4, None).when(F.col("s") < 1e-8, 0.0).when(F.col("A") > 0, -F.log(F.col("A") / F.col("B"))).when(F.col("B") > 0, F.log("B"))
    return all_.select(key, value.alias("sampen"))


def rr_irregularity(beats: DataFrame, key: str, low: float, high: float, near: float, nearer: float) -> DataFrame:
    """Screen for an irregular rhythm from plausible intervals; NULL with fewer than 4 peaks or 3 intervals."""
    all_ = intervals(beats, key)
    peaks = all_.groupBy(key).agg(F.count("*").alias("peaks"))
    w = W.partitionBy(key).orderBy("t")
    rr = all_.where((F.col("rr") > low) & (F.col("rr") < high)).withColumn("d", F.col("rr") - F.lag("rr").over(w))
    f = rr.groupBy(key).agg(
        F.count("*").alias("n_rr"), (F.stddev_pop("rr") / F.avg("rr")).alias("cv"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"), (F.sqrt(F.avg(F.col("d") * F.col("d"))) / F.avg("rr")).alias("nrmssd"),
        F.avg((F.abs("d") > near).cast("int")).alias("pnn50"), F.avg((F.abs("d") > nearer).cast("int")).alias("pnn20"), F.percentile(F.abs("d"), 0.5).alias("mad_diff"), (F.max("rr") - F.min("rr")).alias("range"),
    )
    ok = (F.col("peaks") >= 4) & (F.coalesce("n_rr", F.lit(0)) >= 3)
    return peaks.join(f, key, "left").select(key, *(F.when(ok, F.col(c)).alias(c) for c in ("cv", "rmssd", "nrmssd", "pnn50", "pnn20", "mad_diff", "range")))


def stats_pack(rows: DataFrame, key: str, value: str) -> DataFrame:
    med = F.percentile(value, 0.5).over(W.partitionBy(key))
    rows = rows.withColumn("_m", med).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.first("_m").alias("med"), F.min(value).alias("min"), F.max(value).alias("max"), F.percentile("_d", 0.5).alias("mad"), (F.stddev_pop(value) / F.abs(F.nullif(F.avg(value), F.lit(0.0)))).alias("cv"))


def template_corr(beats: DataFrame, rows: DataFrame, key: str, reach: int, least: int = 3) -> DataFrame:
    """Correlation of each beat's snippet with the point-wise median beat; beats whose snippet leaves the window are left out."""
    spans = beats.select(key, F.col("i").alias("beat"), (F.col("i") - reach).alias("_a"), (F.col("i") + reach).alias("_z"))
    snip = samples_of(spans, rows.select(key, "i", "x"), [key], 2 * reach + 1).withColumn("o", F.col("i") - F.col("beat"))
    snip = snip.withColumn("_n", F.count("*").over(W.partitionBy(key, "beat"))).where(F.col("_n") == 2 * reach + 1)
    snip = snip.withColumn("med", F.percentile("x", 0.5).over(W.partitionBy(key, "o")))
    per = snip.groupBy(key, "beat").agg(F.corr("x", "med").alias("c"))
    return per.groupBy(key).agg(F.count("*").alias("beats"), F.avg("c").alias("mean"), F.min("c").alias("min"), F.stddev_pop("c").alias("std"), F.max_by("c", "beat").alias("last")).select(key, "beats", *(F.when(F.col("beats") >= least, F.col(c)).alias(c) for c in ("mean", "min", "std", "last")))


def lag_products(a: DataFrame, b: DataFrame, key: str, lags: list[int]) -> DataFrame:
    """(key, lag, c): sum of a[i] * b[i + lag] over n, both centred and scaled; lags without a common sample have no row.

    Each window is packed once and all its lags come from one Fourier transform in Arrow batches, n log n a window; no row is
    copied per lag. Samples that are missing count as nothing.
    """
    packed = lambda t, name: t.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x")))).alias(name))
    both = packed(a, "a").join(packed(b, "b"), key)
    both = both.select(key, *(F.col(f"{side}.{f}").alias(f"{side}_{f}") for side in ("a", "b") for f in ("i", "x")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, ai, ax, bi, bx in zip(*(frame[c] for c in (key, "a_i", "a_x", "b_i", "b_x"))):
                ai, bi = np.asarray(ai, np.int64), np.asarray(bi, np.int64)
                first, last = min(ai[0], bi[0]), max(ai[-1], bi[-1])
                size = 1 << int(2 * (last - first) + 1).bit_length()
                wave = np.zeros((4, size))
                for row, at, x in ((0, ai, ax), (2, bi, bx)):
                    x = np.asarray(x, float)
                    wave[row, at - first] = (x - x.mean()) / (x.std() + 1e-8)
                    wave[row + 1, at - first] = 1.0
                f = np.fft.rfft(wave)
                c, n = np.fft.irfft(f[0].conj() * f[2], size) / len(ai), np.fft.irfft(f[1].conj() * f[3], size)
                out += [(k, lag, c[lag % size]) for lag in lags if abs(lag) <= last - first and n[lag % size] > 0.5]
            yield pd.DataFrame(out, columns=[key, "lag", "c"])

    return both.mapInPandas(run, f"{key} {a.schema[key].dataType.simpleString()}, lag int, c double")


def peak_lag(products: DataFrame, key: str) -> DataFrame:
    best = F.max_by(F.struct("lag", "c"), F.struct(F.round("c", 9), -F.col("lag")))
    return products.groupBy(key).agg(best.alias("b")).select(key, F.col("b.c").alias("peak"), F.col("b.lag").alias("lag"))


def dft_power(rows: DataFrame, key: str, n: int, top: int | None = None) -> DataFrame:
    """(key, k, power) of the n-sample windows: rows meet a bounded table of n / 2 frequencies."""
    k = F.explode(F.sequence(F.lit(0), F.lit(top if top is not None else n // 2))).alias("k")
    rows = rows.select(key, "i", (F.col("x") - F.avg("x").over(W.partitionBy(key))).alias("x"), k)
    angle = F.col("k") * F.col("i") * F.lit(2 * math.pi / n)
    s = rows.groupBy(key, "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    return s.select(key, "k", (F.col("re") ** 2 + F.col("im") ** 2).alias("power"))


def spectrum_summary(power: DataFrame, key: str, bands: dict[str, tuple[int, int]]) -> DataFrame:
    """Band shares, entropy, dominant bin, centroid, bandwidth and the bin below which 90 % of the power lies (bin 0 left out)."""
    p = power.where("k > 0").withColumn("total", F.sum("power").over(W.partitionBy(key)))
    p = p.withColumn("q", F.col("power") / F.nullif("total", F.lit(0.0))).withColumn("run", F.sum("q").over(W.partitionBy(key).orderBy("k")))
    centroid = F.sum(F.col("k") * F.col("q"))
    return p.groupBy(key).agg(
        *(F.sum(F.when(F.col("k").between(a, b), F.col("q")).otherwise(0.0)).alias(name) for name, (a, b) in bands.items()),
        F.sum(F.when(F.col("q") > 0, -F.col("q") * F.log("q"))).alias("entropy"), F.max_by("k", F.struct(F.round("q", 9), -F.col("k"))).alias("dominant"), centroid.alias("centroid"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("k") * F.col("k") * F.col("q")) - centroid * centroid)).alias("bandwidth"), F.min(F.when(F.col("run") >= 0.9 - 1e-9, F.col("k"))).alias("edge90"),
    )


def vf_spectral(power: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Concentration at the dominant bin, leakage outside it and its first harmonic, share of [low, high]."""
    p = power.where("k > 0").withColumn("dom", F.max_by("k", F.struct(F.round("power", 9), -F.col("k"))).over(W.partitionBy(key)))
    near = F.abs(F.col("k") - F.col("dom")) <= 1
    harmonic = F.abs(F.col("k") - 2 * F.col("dom")) <= 1
    total = F.nullif(F.sum("power"), F.lit(0.0))
    return p.groupBy(key).agg((F.sum(F.when(near, F.col("power")).otherwise(0.0)) / total).alias("concentration"), (F.sum(F.when(~near & ~harmonic, F.col("power")).otherwise(0.0)) / total).alias("leakage"), (F.sum(F.when(F.col("k").between(low, high), F.col("power")).otherwise(0.0)) / total).alias("vf_share"))


def sqi_moments(rows: DataFrame, key: str) -> DataFrame:
    w = W.partitionBy(key).orderBy("i")
    rows = rows.withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("dd", F.col("dx") - F.lag("dx").over(w)).withColumn("sc", (F.signum("x") != F.signum(F.lag("x").over(w))).cast("int"))
    mob, mob2 = F.sqrt(F.var_pop("dx") / F.nullif(F.var_pop("x"), F.lit(0.0))), F.sqrt(F.var_pop("dd") / F.nullif(F.var_pop("dx"), F.lit(0.0)))
    return rows.groupBy(key).agg(F.kurtosis("x").alias("kurtosis"), F.skewness("x").alias("skewness"), F.avg((F.abs("dx") < 1e-3).cast("int")).alias("flat"), F.max(F.abs("dx")).alias("max_step"), F.sum(F.abs("dx")).alias("line_length"), F.avg("sc").alias("zero_crossings"), mob.alias("mobility"), (mob2 / mob).alias("complexity"))


def qrs_morphology(beats: DataFrame, rows: DataFrame, key: str, reach: int, t: tuple[int, int, int], p: tuple[int, int], least: int = 5) -> DataFrame:
    """Per window, over its beats: mean amplitude, peak-to-peak, samples above half of the beat's maximum; T and P wave, last beats.

    The T wave is the largest |x| from t[0] samples after the beat to t[1] after it, ending t[2] before the next beat (or the
    window's end); the P wave lies from p[0] to p[1] samples before it. Both are divided by |x| at the beat and left out where
    at most least samples are there. last_vs_all: |x| at the last three beats over that of all, null with a single beat.
    """
    w = W.partitionBy(key).orderBy("i")
    ends = rows.groupBy(key).agg((F.max("i") + 1).alias("_end"))
    spans = beats.select(key, "i", F.lead("i").over(w).alias("_next"), F.row_number().over(W.partitionBy(key).orderBy(F.col("i").desc())).alias("_last")).join(ends, key)
    spans = spans.withColumns({"_t0": F.col("i") + t[0], "_t1": F.least(F.col("i") + t[1], F.coalesce("_next", "_end") - t[2]), "_p0": F.greatest(F.col("i") - p[0], F.lit(0)), "_p1": F.col("i") - p[1]})
    spans = spans.select(key, F.col("i").alias("beat"), "_last", "_t0", "_t1", "_p0", "_p1", (F.col("i") - max(reach, p[0])).alias("_a"), (F.col("i") + max(reach, t[1])).alias("_z"))
    near = samples_of(spans, rows.select(key, "i", "x"), [key], max(reach, p[0]) + max(reach, t[1]) + 1)
    size, inside = F.abs("x"), F.abs(F.col("i") - F.col("beat")) <= reach
    near = near.withColumn("top", F.max(F.when(inside, size)).over(W.partitionBy(key, "beat")))
    part = lambda a, z: F.max(F.when((F.col("i") >= F.col(a)) & (F.col("i") < F.col(z)) & (F.col(z) - F.col(a) > least), size))
    per = near.groupBy(key, "beat").agg(
        F.max("top").alias("amplitude"), (F.max(F.when(inside, F.col("x"))) - F.min(F.when(inside, F.col("x")))).alias("ptp"), F.count_if(inside & (size >= F.col("top") / 2)).alias("width"),
        F.max(F.when(F.col("i") == F.col("beat"), size)).alias("own"), part("_t0", "_t1").alias("tw"), part("_p0", "_p1").alias("pw"), F.first("_last").alias("last"),
    )
    own = F.nullif(F.col("own"), F.lit(0.0))
    return per.groupBy(key).agg(
        F.count("*").alias("beats"), *(F.avg(c).alias(c) for c in ("amplitude", "ptp", "width")), F.avg(F.col("tw") / own).alias("t_ratio"), F.avg(F.col("pw") / own).alias("p_ratio"),
        F.when(F.count("own") > 1, F.avg(F.when(F.col("last") <= 3, F.col("own"))) / F.nullif(F.avg("own"), F.lit(0.0))).alias("last_vs_all"),
    )


def first_bump(x: Column, skip: int, prominence: Column) -> Column:
    """The first value of an array, more than skip places in, that stands above its neighbours by the prominence; null without one.

    The prominence of a value is what it rises above the higher of the lowest values on either side, up to a higher value.
    """

    def floor(side: Column, v: Column) -> Column:
        start = F.struct(v.alias("low"), F.lit(False).alias("over"))
        step = lambda s, u: F.struct(F.when(s["over"] | (u > v), s["low"]).otherwise(F.least(s["low"], u)).alias("low"), (s["over"] | (u > v)).alias("over"))
        return F.aggregate(side, start, step, lambda s: s["low"])

    def stands(k: Column) -> Column:
        v = F.element_at(x, k)
        peak = (v > F.element_at(x, k - 1)) & (v > F.element_at(x, k + 1))
        high = v - F.greatest(floor(F.reverse(F.slice(x, 1, k - 1)), v), floor(F.slice(x, k + 1, F.size(x)), v))
        return F.when(peak, high >= prominence).otherwise(False)

    first, last = F.lit(skip + 2), F.size(x) - 1
    found = F.filter(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), stands)
    return F.when(F.size(found) > 0, F.element_at(x, F.try_element_at(found, F.lit(1))))


def pulse_morphology(feet: DataFrame, rows: DataFrame, key: str, most: int, least: int = 5, skip: int = 3) -> DataFrame:
    """From (key, peak, foot): shape of a window's pulses, as means over them.

    amplitude, rise, trapezoid area from foot to peak and steepest up-slope; half_width: samples from the foot to the next
    foot (at most `most` samples after the peak) that reach half the amplitude; dicrotic: height over the amplitude of the
    first bump of the falling limb more than skip samples after the peak, 0 without one. The last two need more than least
    falling samples. Of the amplitudes: last_vs_all (the last two), amp_rmssd and perfusion (over the deviation of the
    window), null with a single pulse.
    """
    w = W.partitionBy(key).orderBy("i")
    at = rows.select(key, "i", "x", F.lead("x").over(w).alias("x2"))
    whole = rows.groupBy(key).agg((F.max("i") + 1).alias("_end"), F.stddev_pop("x").alias("_sd"))
    after = F.lead("foot").over(W.partitionBy(key).orderBy("peak"))
    spans = feet.select(key, "peak", "foot", after.alias("_after")).join(whole, key)
    spans = spans.withColumn("_next", F.when(F.col("_after") > F.col("peak"), F.col("_after")).otherwise(F.least(F.col("peak") + most, F.col("_end"))))
    near = samples_of(spans.withColumns({"_a": F.col("foot"), "_z": F.greatest(F.col("peak"), F.col("_next") - 1)}), at, [key])
    here = W.partitionBy(key, "peak")
    near = near.withColumns({"base": F.max(F.when(F.col("i") == F.col("foot"), F.col("x"))).over(here), "top": F.max(F.when(F.col("i") == F.col("peak"), F.col("x"))).over(here)})
    inner, falling = F.col("i") < F.col("peak"), (F.col("i") >= F.col("peak")) & (F.col("i") < F.col("_next"))
    limb = F.transform(F.array_sort(F.collect_list(F.when(falling, F.struct("i", "x")))), lambda s: s["x"])
    per = near.groupBy(key, "peak", "foot").agg(
        (F.max("top") - F.max("base")).alias("amplitude"), F.coalesce(F.sum(F.when(inner, (F.col("x") + F.col("x2")) / 2 - F.col("base"))), F.lit(0.0)).alias("area"), F.max(F.when(inner, F.col("x2") - F.col("x"))).alias("slope"),
        F.count_if((F.col("i") < F.col("_next")) & (F.col("x") >= F.col("base") + (F.col("top") - F.col("base")) / 2)).alias("wide"), limb.alias("limb"), F.max("base").alias("base"), F.first("_next").alias("_next"), F.first("_sd").alias("_sd"),
    )
    whole_limb = F.col("_next") > F.col("peak") + least
    bump = (first_bump(F.col("limb"), skip, 0.03 * (F.abs("amplitude") + 1e-8)) - F.col("base")) / (F.col("amplitude") + 1e-8)
    order = W.partitionBy(key).orderBy("peak")
    per = per.withColumns({"rise": F.col("peak") - F.col("foot"), "half_width": F.when(whole_limb, F.col("wide")), "dicrotic": F.when(whole_limb, F.coalesce(bump, F.lit(0.0))), "step": F.col("amplitude") - F.lag("amplitude").over(order), "last": F.row_number().over(W.partitionBy(key).orderBy(F.col("peak").desc()))})
    several = lambda c: F.when(F.count("*") > 1, c)
    return per.groupBy(key).agg(
        F.count("*").alias("pulses"), *(F.avg(c).alias(c) for c in ("amplitude", "rise", "area", "slope", "half_width", "dicrotic")),
        several(F.avg(F.when(F.col("last") <= 2, F.col("amplitude"))) / (F.avg("amplitude") + 1e-8)).alias("last_vs_all"), several(F.sqrt(F.avg(F.col("step") * F.col("step")))).alias("amp_rmssd"), several(F.avg("amplitude") / (F.first("_sd") + 1e-8)).alias("perfusion"),
    )


def alarm_detectors(beats: DataFrame, key: str, gap: float, slow: float, fast: float, over: int = 5) -> DataFrame:
    """Longest gap, its excess over a limit, extremes of the rolling mean rate over complete runs of intervals, and counts of fast and slow beats."""
    rr = intervals(beats, key).where("rr > 0")
    w = W.partitionBy(key).orderBy("t").rowsBetween(-(over - 1), 0)
    rr = rr.withColumn("hr", F.lit(60.0) / F.col("rr")).withColumn("roll", F.when(F.count("rr").over(w) == over, F.lit(60.0) / F.avg("rr").over(w)))
    return rr.groupBy(key).agg(F.max("rr").alias("longest"), (F.max("rr") > gap).alias("asystole"), F.min("roll").alias("roll_min"), F.max("roll").alias("roll_max"), F.count_if(F.col("hr") > fast).alias("n_fast"), F.count_if(F.col("hr") < slow).alias("n_slow"))


def hr_in_range(beats: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """Count-based and median-interval rate of the beats in [low, high)."""
    rr = intervals(beats.where((F.col("t") >= low) & (F.col("t") < high)), key)
    return rr.groupBy(key).agg((F.count("*") * F.lit(60.0 / (high - low))).alias("hr_count"), (F.lit(60.0) / F.nullif(F.percentile("rr", 0.5), F.lit(0.0))).alias("hr_median"))


def category_ids(rows: DataFrame, column: str) -> DataFrame:
    """Stable ids of the sorted distinct values, joined back."""
    ids = rows.select(column).distinct().withColumn("id", (F.row_number().over(W.orderBy(column)) - 1).cast("int"))
    return rows.join(ids, column)


def one_hot(column: Column, values: list) -> list[Column]:
    return [(column == v).cast("int").alias(f"is_{k}") for k, v in enumerate(values)]
