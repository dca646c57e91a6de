"""Perturbations of sample windows (key, i, x) and their summaries. Every draw is an MD5 of the key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.kernels import per_window_samples


def shift(rows: DataFrame, key: str, n: int, by: int) -> DataFrame:
    """Circular: sample i comes from i - by."""
    return rows.withColumn("i", F.pmod(F.col("i") + by, F.lit(n)).cast("int"))


def delay(rows: DataFrame, key: str, n: int, by: int) -> DataFrame:
    """Later by ``by`` samples, the first value held."""
    moved = rows.withColumn("i", F.explode(F.when(F.col("i") == 0, F.sequence(F.lit(0), F.lit(by))).otherwise(F.array((F.col("i") + by).cast("int")))))
    return moved.where(F.col("i") < n)


def reverse(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.withColumn("i", (F.lit(n - 1) - F.col("i")).cast("int"))


def dropout(rows: DataFrame, key: str, n: int, share: float, hold: bool = False, seed: str = "drop") -> DataFrame:
    """A contiguous share of the window, from a drawn start, becomes zero or the last value before it."""
    width = int(round(n * share))
    start = draw(F.lit(seed), F.col(key)) % (n - width + 1)
    rows = rows.withColumn("_s", start)
    gone = (F.col("i") >= F.col("_s")) & (F.col("i") < F.col("_s") + width)
    if not hold:
        return rows.withColumn("x", F.when(gone, F.lit(0.0)).otherwise(F.col("x"))).drop("_s")
    last = F.max(F.when(F.col("i") == F.greatest(F.lit(0), F.col("_s") - 1), F.col("x"))).over(W.partitionBy(key))
    return rows.withColumn("x", F.when(gone, last).otherwise(F.col("x"))).drop("_s")


def block_dropout(rows: DataFrame, key: str, block: int, share: float, seed: str = "block") -> DataFrame:
    """Each block of the window is zeroed with the given probability."""
    hit = draw(F.lit(seed), F.col(key), F.floor(F.col("i") / block)) < int(share * (1 << 32))
    return rows.withColumn("x", F.when(hit, F.lit(0.0)).otherwise(F.col("x")))


def noise_snr(rows: DataFrame, noise: DataFrame, key: str, n: int, snr_db: float, seed: str = "noise") -> DataFrame:
    """Adds a drawn slice of a noise bank (channel, i, v), demeaned and scaled to the SNR, then z-normalises again."""
    bank = noise.groupBy("channel").agg(F.count("*").alias("len")).where(F.col("len") >= n)
    bank = bank.withColumn("c", F.row_number().over(W.orderBy("channel")) - 1)
    count = bank.agg(F.count("*").alias("banks"))
    picks = rows.select(key).distinct().join(F.broadcast(count)).withColumn("c", draw(F.lit(seed), F.col(key)) % F.col("banks")).join(F.broadcast(bank), "c")
    picks = picks.select(key, "channel", (draw(F.lit(seed + "-at"), F.col(key)) % (F.col("len") - n + 1)).alias("off"), F.when(draw(F.lit(seed + "-sign"), F.col(key)) % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
    # a slice lies in at most two buckets of its own length, so a long channel is read bucket by bucket
    first, last = F.floor(F.col("off") / n), F.floor((F.col("off") + n - 1) / n)
    picks = picks.withColumn("bucket", F.explode(F.array_distinct(F.array(first, last))))
    bank = noise.select("channel", F.col("i").alias("ni"), "v", F.floor(F.col("i") / n).alias("bucket"))
    slice_ = picks.join(bank, ["channel", "bucket"]).where((F.col("ni") >= F.col("off")) & (F.col("ni") < F.col("off") + n)).select(key, (F.col("ni") - F.col("off")).alias("i"), (F.col("v") * F.col("sign")).alias("v"))
    w = W.partitionBy(key)
    both = rows.join(slice_, [key, "i"]).withColumn("v", F.col("v") - F.avg("v").over(w))
    scale = F.sqrt(F.var_pop("x").over(w) / (F.var_pop("v").over(w) * F.lit(10 ** (snr_db / 10)) + F.lit(1e-12)))
    both = both.withColumn("x", F.col("x") + F.col("v") * scale)
    return both.withColumn("x", (F.col("x") - F.avg("x").over(w)) / (F.stddev_pop("x").over(w) + F.lit(1e-8))).drop("v")


def jitter(rows: DataFrame, key: str, n: int, step: float, most: float, seed: str = "jitter") -> DataFrame:
    """Random-walk time warp: summed drawn steps, clipped, then a straight line between the two samples met."""
    w = W.partitionBy(key).orderBy("i")
    u = draw(F.lit(seed), F.col(key), F.col("i")) / F.lit(float(1 << 32)) - F.lit(0.5)
    walk = F.sum(u * F.lit(step)).over(w.rowsBetween(W.unboundedPreceding, 0))
    pos = F.least(F.lit(float(n - 1)), F.greatest(F.lit(0.0), F.col("i") + F.least(F.lit(most), F.greatest(F.lit(-most), walk))))
    asked = rows.select(key, "i", F.round(pos, 9).alias("pos")).withColumn("a", F.floor("pos").cast("int"))
    have = rows.select(key, F.col("i").alias("a"), F.col("x").alias("xa"), F.lead("x").over(w).alias("xb"))
    share = F.col("pos") - F.col("a")
    return asked.join(have, [key, "a"]).select(key, "i", (F.col("xa") + F.when(share > 0, (F.col("xb") - F.col("xa")) * share).otherwise(F.lit(0.0))).alias("x"))


def missing(rows: DataFrame, which: Column) -> DataFrame:
    return rows.withColumn("x", F.when(which, F.lit(0.0)).otherwise(F.col("x")))


def phase_scramble(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Keeps the amplitude spectrum, draws the phases from the seed and the window's key; windows come in Arrow batches."""

    def kernel(x: np.ndarray, window: int) -> np.ndarray:
        spectrum = np.fft.rfft(x)
        phase = np.random.default_rng([seed, int(window) & 0x7FFFFFFF]).uniform(-np.pi, np.pi, len(spectrum))
        phase[0] = 0.0
        if len(x) % 2 == 0:
            phase[-1] = 0.0
        return np.fft.irfft(spectrum * np.exp(1j * phase), len(x))

    return per_window_samples(rows, key, kernel, with_key=True)


def unit(*keys: Column | str | int) -> Column:
    """A drawn number in (0, 1]."""
    return (draw(*keys) + 1) / F.lit(float(1 << 32))


def gaussian(tag: str, *keys: Column | str | int) -> Column:
    """A drawn standard normal value, from a radius and an angle."""
    return F.sqrt(F.lit(-2.0) * F.log(unit(F.lit(tag + "-radius"), *keys))) * F.cos(F.lit(2.0 * np.pi) * unit(F.lit(tag + "-angle"), *keys))


def beta_share(alpha: float, tag: str, *keys: Column | str | int, tries: int = 16) -> Column:
    """A drawn value of Beta(alpha, alpha), 0 < alpha <= 1: the first of the tries whose two powers of drawn numbers sum to at most one.

    A try fails with at most one half (alpha = 1; one in ten at 0.4); where all fail the share is one half.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha lies above 0 and at most at 1")

    def attempt(k: Column) -> Column:
        side = [F.pow(unit(F.lit(f"{tag}-{s}"), *keys, k), F.lit(1.0 / alpha)).alias(s) for s in ("a", "b")]
        return F.struct(*side)

    found = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), attempt), lambda t: (t["a"] + t["b"] <= 1) & (t["a"] + t["b"] > 0)), F.lit(0))
    return F.coalesce(found["a"] / (found["a"] + found["b"]), F.lit(0.5))


def augment(rows: DataFrame, key: str, n: int, copies: int, seed: str = "aug", scale: float = 0.15, noise: float = 0.1, drop: float = 0.3, chunk: int | None = None) -> DataFrame:
    """Training copies (copy 0 is the window itself): log-normal amplitude, noise of a drawn level, a lost chunk, a circular shift.

    The shift, the amplitude and the noise level belong to the copy. With probability ``drop`` one chunk (an eighth of the
    window unless given) of the copy is zero. Null samples stay null outside the chunk.
    """
    chunk = chunk or max(1, n // 8)
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    by = draw(F.lit(seed), F.col(key), F.col("copy")) % n
    level = unit(F.lit(seed + "-level"), F.col(key), F.col("copy")) * F.lit(noise)
    changed = F.col("x") * F.exp(gaussian(seed + "-amp", F.col(key), F.col("copy")) * F.lit(scale)) + gaussian(seed + "-noise", F.col(key), F.col("copy"), F.col("i")) * level
    start = draw(F.lit(seed + "-from"), F.col(key), F.col("copy")) % (n - chunk + 1)
    lost = (unit(F.lit(seed + "-drop"), F.col(key), F.col("copy")) <= drop) & (F.col("i") >= start) & (F.col("i") < start + chunk)
    real = F.col("copy") == 0
    x = F.when(real, F.col("x")).when(lost, F.lit(0.0)).otherwise(changed)
    return many.withColumn("x", x).withColumn("i", F.when(real, F.col("i")).otherwise(F.pmod(F.col("i") + by, F.lit(n))).cast("int"))


def mixup(rows: DataFrame, key: str, fold: str, y: str, alpha: float = 0.4, seed: str = "mix", per: int = 1000) -> DataFrame:
    """Each training window of a fold blended with a drawn partner of the same fold, samples and labels by one Beta(alpha, alpha) share.

    ``rows`` holds a window's samples (i from 0 without gaps, x) once for each fold it trains in; other roles are left out
    before, so no fold sees what it is tested on. Partners are a permutation of the fold: windows fall by their draw into
    parts of some ``per`` windows, are ordered by it there, and each meets the next one, the last the first. No part grows
    with the table, no window is joined with itself or copied more than once. A window alone in its part is its own
    partner. A missing or null sample counts as zero, a null label gives a null label. Returns fold, key, partner, share, y, i, x.
    """
    packed = rows.groupBy(fold, key).agg(F.first(y, ignorenulls=True).cast("double").alias("_y"), F.array_sort(F.collect_list(F.struct("i", F.coalesce("x", F.lit(0.0)).alias("x")))).alias("_s"))
    sizes = rows.groupBy(fold).agg(F.countDistinct(key).alias("_n")).withColumnRenamed(fold, "_f")  # one row per fold
    packed = packed.join(F.broadcast(sizes), F.col(fold).eqNullSafe(F.col("_f"))).withColumn("_d", draw(F.lit(seed), F.col(fold), F.col(key)))
    packed = packed.withColumn("_p", F.floor(F.col("_d") * F.ceil(F.col("_n") / per) / F.lit(float(1 << 32))))
    part = W.partitionBy(fold, "_p")
    turn, mate = part.orderBy("_d", key), F.struct(F.col(key).alias("partner"), F.col("_y").alias("y"), F.col("_s").alias("s"))
    first = F.first(mate).over(turn.rowsBetween(W.unboundedPreceding, W.currentRow))
    pairs = packed.withColumn("_m", F.coalesce(F.lead(mate).over(turn), first)).withColumn("share", beta_share(alpha, seed, F.col(fold), F.col(key)))
    here, there = F.col("share"), F.lit(1.0) - F.col("share")
    blend = F.zip_with("_s", F.col("_m.s"), lambda a, b: F.struct(F.coalesce(a["i"], b["i"]).alias("i"), (here * F.coalesce(a["x"], F.lit(0.0)) + there * F.coalesce(b["x"], F.lit(0.0))).alias("x")))
    return pairs.select(fold, key, F.col("_m.partner").alias("partner"), "share", (here * F.col("_y") + there * F.col("_m.y")).alias(y), F.inline(blend))


#: Perturbation registry: kind -> (rows, key, n) -> rows.
PERTURBATIONS: dict[str, Callable[[DataFrame, str, int], DataFrame]] = {
    "shift": lambda rows, key, n: shift(rows, key, n, n // 8), "delay": lambda rows, key, n: delay(rows, key, n, n // 8), "reverse": reverse,
    "dropout": lambda rows, key, n: dropout(rows, key, n, 0.25), "hold": lambda rows, key, n: dropout(rows, key, n, 0.25, hold=True),
    "blocks": lambda rows, key, n: block_dropout(rows, key, n // 8, 0.3), "missing": lambda rows, key, n: missing(rows, F.lit(True)),
}


def stress_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean over draws within a fold, then mean and sample deviation over folds."""
    fold = rows.groupBy(*by, "fold").agg(F.avg(value).alias("v"))
    return fold.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("*").alias("folds"))


def degradation(summary: DataFrame, model: str, kind: str, value: str, clean: str = "clean") -> DataFrame:
    """Clean value, mean and worst value under stress, and the mean drop of each model."""
    c, s = F.col(kind) == clean, F.col(kind) != clean
    out = summary.groupBy(model).agg(F.max(F.when(c, F.col(value))).alias("clean"), F.avg(F.when(s, F.col(value))).alias("stressed"), F.min(F.when(s, F.col(value))).alias("worst"))
    return out.withColumn("mean_drop", F.col("clean") - F.col("stressed"))


def alignment_indices(table: DataFrame) -> DataFrame:
    """From (model, identity, swap, scramble, noise, shift_1 ..): what each destroyed relation costs."""
    shifts = [F.col(c) for c in table.columns if c.startswith("shift_")]
    low = F.least(*shifts) if len(shifts) > 1 else shifts[0]
    i = F.col("identity")
    return table.select("model", (i - F.col("swap")).alias("swap_cost"), (i - F.col("scramble")).alias("scramble_cost"), (i - low).alias("shift_cost"), (i - F.col("noise")).alias("noise_cost"))
