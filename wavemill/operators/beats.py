"""Beat tables (key, t) and the joins between electrical beats and the pulses that follow them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def energy(rows: DataFrame, by: list[str], width: int = 30) -> DataFrame:
    """Squared first difference, summed over ``width`` samples around each one and divided by the full width."""
    w = W.partitionBy(*by).orderBy("i")
    d = F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(0.0))
    return rows.withColumn("_d", d * d).withColumn("energy", F.sum("_d").over(w.rowsBetween(-(width // 2), (width - 1) // 2)) / F.lit(float(width))).drop("_d")


def adaptive_threshold(rows: DataFrame, by: list[str], value: str = "energy", share: float = 0.3) -> DataFrame:
    return rows.groupBy(*by).agg((F.percentile(value, 0.99) * F.lit(share)).alias("threshold"), F.max(value).alias("top")).where("top > 0").drop("top")


def local_maxima(rows: DataFrame, by: list[str], value: str = "x") -> DataFrame:
    """Peaks strictly above what stands on either side; of a plateau the middle sample."""
    w = W.partitionBy(*by).orderBy("i")
    v = F.col(value)
    rows = rows.withColumn("_new", F.when(v == F.lag(value).over(w), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy(*by, "_run").agg(F.first(value).alias(value), F.floor((F.min("i") + F.max("i")) / 2).alias("i"))
    order = W.partitionBy(*by).orderBy("_run")
    runs = runs.withColumn("_p", F.lag(value).over(order)).withColumn("_n", F.lead(value).over(order))
    return runs.where((v > F.col("_p")) & (v > F.col("_n"))).select(*by, "i", value)


def suppress_by_frame(peaks: DataFrame, by: list[str], distance: int, value: str = "x") -> DataFrame:
    """Parallel form: a peak stays if none within the distance is higher (approximate: a suppressed peak still suppresses)."""
    w = W.partitionBy(*by).orderBy("i").rangeBetween(-(distance - 1), distance - 1)
    return peaks.withColumn("_m", F.max(value).over(w)).where(F.col(value) >= F.col("_m")).drop("_m")


#: Longer runs of peaks are solved in Arrow batches, shorter ones by a fold.
RUN_PEAKS = 64


def suppress_exact(peaks: DataFrame, by: list[str], distance: int, value: str = "x") -> DataFrame:
    """Sequential form: the highest first (of equal ones the later), its neighbours nearer than the distance go.

    Peaks in a row whose gaps are all shorter than the distance are a run; runs do not touch each other, so each is solved
    alone, as a fold over its peaks from the highest down. Runs of more than RUN_PEAKS peaks are walked in Arrow batches, each
    kept peak striking out its neighbours on either side, in time linear in the run but for one sort.
    """
    order, columns = W.partitionBy(*by).orderBy("i"), peaks.columns
    new = F.when(F.col("i") - F.lag("i").over(order) < distance, 0).otherwise(1)
    rows = peaks.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    peak = F.struct(F.col(value).alias("v"), F.col("i").alias("at"), F.struct(*columns).alias("row"))
    runs = rows.groupBy(*by, "_run").agg(F.sort_array(F.collect_list(peak), asc=False).alias("peaks"), F.count("*").alias("n"))
    none = F.slice("peaks", 1, 0)
    clear = lambda kept, p: ~F.exists(kept, lambda q: F.abs(q["at"] - p["at"]) < distance)
    kept = F.aggregate("peaks", none, lambda kept, p: F.when(clear(kept, p), F.concat(kept, F.array(p))).otherwise(kept))
    short = runs.where(F.col("n") <= RUN_PEAKS).select(F.explode(kept).alias("p")).select("p.row.*")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i").reset_index(drop=True)
        at, open_, keep = frame["i"].to_numpy(), np.ones(len(frame), bool), np.zeros(len(frame), bool)
        for k in np.argsort(frame[value].to_numpy(), kind="stable")[::-1]:
            if open_[k]:
                keep[k] = True
                open_[np.searchsorted(at, at[k] - distance, "right") : np.searchsorted(at, at[k] + distance)] = False
        return frame.loc[keep, columns]

    dense = rows.groupBy(*by, "_run").agg(F.count("*").alias("n")).where(F.col("n") > RUN_PEAKS).drop("n")
    long = rows.join(dense, [*by, "_run"], "left_semi").groupBy(*by, "_run").applyInPandas(run, peaks.schema)
    return short.unionByName(long)


def peaks_by_prominence(rows: DataFrame, by: list[str], distance: int, share: float = 0.4) -> DataFrame:
    """Pulse peaks: the minimum distance first, then a prominence of at least share * deviation."""

    def peaks(x: np.ndarray) -> np.ndarray:
        up = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])) + 1
        keep = np.ones(len(up), bool)
        for k in np.argsort(x[up], kind="stable")[::-1]:
            if keep[k]:
                close = np.abs(up - up[k]) < distance
                close[k] = False
                keep &= ~close
        up = up[keep]
        out = []
        for p in up:
            higher_left, higher_right = np.flatnonzero(x[:p] > x[p]), np.flatnonzero(x[p + 1 :] > x[p])
            a = higher_left[-1] if len(higher_left) else 0
            b = p + 1 + higher_right[0] if len(higher_right) else len(x) - 1
            if x[p] - max(x[a : p + 1].min(), x[p : b + 1].min()) >= share * x.std():
                out.append(p)
        return np.array(out, int)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i").reset_index(drop=True)
        return frame.iloc[peaks(frame["x"].to_numpy())][[*by, "i", "x"]]

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*by, "i", "x"))
    return rows.select(*by, "i", "x").groupBy(*by).applyInPandas(run, schema)


#: Samples of one bucket where spans have no length of their own.
BUCKET = 256


def samples_of(spans: DataFrame, rows: DataFrame, by: list[str], bucket: int = BUCKET) -> DataFrame:
    """spans (by, _a, _z, ...) with each sample (by, i, ...) of the closed range from _a to _z.

    Equality is on (by, bucket of samples), so a long recording is dealt to many tasks and a span meets its own buckets only.
    """
    dealt = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_a") / bucket), F.floor(F.col("_z") / bucket))))
    own = rows.withColumn("_b", F.floor(F.col("i") / bucket))
    return dealt.join(own, [*by, "_b"]).where(F.col("i").between(F.col("_a"), F.col("_z"))).drop("_a", "_z", "_b")


def refine(candidates: DataFrame, rows: DataFrame, by: list[str], reach: int) -> DataFrame:
    """Each candidate moves to the largest |x| within reach (ties: the earlier sample); equal results fall together."""
    spans = candidates.select(*by, F.col("i").alias("c"), (F.col("i") - reach).alias("_a"), (F.col("i") + reach).alias("_z"))
    near = samples_of(spans, rows.select(*by, "i", "x"), by, 2 * reach + 1)
    return near.groupBy(*by, "c").agg(F.max_by("i", F.struct(F.abs("x"), -F.col("i"))).alias("i")).select(*by, "i").distinct()


def feet(peaks: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """The lowest sample between the previous peak (or the start) and each peak; ties: the earlier."""
    before = F.coalesce(F.lag("i").over(W.partitionBy(*by).orderBy("i")), F.lit(0))
    spans = peaks.select(*by, F.col("i").alias("peak"), before.alias("_a"), F.col("i").alias("_z"))
    near = samples_of(spans, rows.select(*by, "i", "x"), by)
    return near.groupBy(*by, "peak").agg(F.min_by("i", F.struct("x", "i")).alias("foot"))


def interval_join(left: DataFrame, right: DataFrame, key: str, low: float, high: float, closed: bool = True) -> DataFrame:
    """left (key, t, ...) with right (key, t2) where t2 - t lies in [low, high].

    Equality is on (key, time bucket of one interval's length), so a long recording spreads over many tasks; the range
    stays as a residual condition of that join.
    """
    step = float(high - low) or 1.0
    spread = left.withColumn("_b", F.explode(F.sequence(F.floor((F.col("t") + low) / step), F.floor((F.col("t") + high) / step))))
    dealt = right.select(F.col(key).alias("_k"), F.col("t").alias("t2"), F.floor(F.col("t") / step).alias("_rb"))
    gap = F.col("t2") - F.col("t")
    inside = (gap >= low) & (gap <= high) if closed else (gap > low) & (gap < high)
    return spread.join(dealt, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_rb")) & inside).drop("_b", "_k", "_rb")


def first_after(beats: DataFrame, pulses: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """Per matched beat the gap to its first pulse."""
    return interval_join(beats.select(key, "t"), pulses, key, low, high).groupBy(key, "t").agg(F.min(F.col("t2") - F.col("t")).alias("ptt"))


def per_beat(beats: DataFrame, pulses: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """Every beat with its gap, NULL where no pulse follows."""
    return beats.select(key, "t").distinct().join(first_after(beats, pulses, key, low, high), [key, "t"], "left")


def match_mutual(reference: DataFrame, detected: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Pairs that are each other's nearest within the tolerance (equals greedy matching when beats are far apart)."""
    near = interval_join(reference.select(key, "t").distinct(), detected.select(key, "t").distinct(), key, -tolerance, tolerance)
    gap = F.round(F.abs(F.col("t2") - F.col("t")), 9)
    near = near.withColumn("_a", F.row_number().over(W.partitionBy(key, "t").orderBy(gap, "t2"))).withColumn("_b", F.row_number().over(W.partitionBy(key, "t2").orderBy(gap, "t")))
    return near.where("_a = 1 and _b = 1").select(key, "t", "t2")


#: Longer chains of beats are solved in Arrow batches, shorter ones by a fold.
CHAIN_BEATS = 64


def match_greedy(reference: DataFrame, detected: DataFrame, key: str, tolerance: float) -> DataFrame:
    """(key, tp, fp, fn) by taking reference beats in order, each with the nearest free detection (of equally near ones the earlier).

    Beats of both sides in order of time fall into chains: a gap above the tolerance parts two, and no pair reaches across. Each
    chain is solved alone, as a fold over its reference beats; chains of more than CHAIN_BEATS beats are walked in Arrow batches,
    where a beat looks at the detections within its tolerance only.
    """
    both = reference.select(key, F.col("t").cast("double"), F.lit(0).alias("side")).unionByName(detected.select(key, F.col("t").cast("double"), F.lit(1).alias("side")))
    order = W.partitionBy(key).orderBy("t", "side")
    both = both.withColumn("_new", F.when(F.col("t") - F.lag("t").over(order) <= tolerance, 0).otherwise(1))
    both = both.withColumn("_chain", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    times = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("t"))))
    chains = both.groupBy(key, "_chain").agg(times(0).alias("ref"), times(1).alias("det"), F.count("*").alias("n"))
    start = F.struct(F.transform("det", lambda t, k: F.struct(t.alias("t"), k.alias("k"))).alias("free"), F.lit(0).alias("tp"))

    def take(acc, t):
        near = F.array_min(F.transform(acc["free"], lambda d: F.struct(F.abs(d["t"] - t).alias("gap"), d["k"].alias("k"))))
        hit = F.coalesce(near["gap"] <= tolerance, F.lit(False))
        return F.struct(F.when(hit, F.filter(acc["free"], lambda d: d["k"] != near["k"])).otherwise(acc["free"]).alias("free"), (acc["tp"] + hit.cast("int")).alias("tp"))

    short = chains.where(F.col("n") <= CHAIN_BEATS).select(key, F.size("ref").alias("n_ref"), F.size("det").alias("n_det"), F.aggregate("ref", start, take)["tp"].alias("tp"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ref, det = (np.sort(frame.loc[frame["side"] == s, "t"].to_numpy()) for s in (0, 1))
        free, tp = np.ones(len(det), bool), 0
        for t in ref:
            a, b = np.searchsorted(det, t - tolerance - 1e-6), np.searchsorted(det, t + tolerance + 1e-6, "right")
            gaps = np.where(free[a:b], np.abs(det[a:b] - t), np.inf)
            if len(gaps) and gaps.min() <= tolerance:
                free[a + gaps.argmin()] = False
                tp += 1
        return pd.DataFrame({key: [frame[key].iloc[0]], "n_ref": [len(ref)], "n_det": [len(det)], "tp": [tp]})

    dense = chains.where(F.col("n") > CHAIN_BEATS).select(key, "_chain")
    schema = f"{key} {reference.schema[key].dataType.simpleString()}, n_ref int, n_det int, tp int"
    long = both.join(dense, [key, "_chain"], "left_semi").groupBy(key, "_chain").applyInPandas(run, schema)
    sums = short.unionByName(long).groupBy(key).agg(*(F.sum(c).alias(c) for c in ("tp", "n_ref", "n_det")))
    return sums.select(key, "tp", (F.col("n_det") - F.col("tp")).alias("fp"), (F.col("n_ref") - F.col("tp")).alias("fn"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    r = lambda a, b: F.when(b > 0, a / b.cast("double"))
    return [r(tp, tp + fn).alias("sensitivity"), r(tp, tp + fp).alias("ppv"), F.coalesce(r(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1")]

