"""Calibration, certified suppression and decision tables over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(p / (F.lit(1.0) - p))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def temperature_grid(val: DataFrame, by: list[str], low: float = -3.0, high: float = 3.0, steps: int = 25) -> DataFrame:
    """(by, log_t, nll): mean negative log-likelihood at each temperature of a bounded grid."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_k")
    rows = val.select(*by, logit(F.col("prob")).alias("z"), F.col("y").cast("double").alias("y"), grid)
    log_t = F.lit(low) + F.col("_k") * F.lit((high - low) / (steps - 1))
    q = F.least(F.greatest(sigmoid(F.col("z") / F.exp(log_t)), F.lit(1e-12)), F.lit(1 - 1e-12))
    return rows.groupBy(*by, log_t.alias("log_t")).agg(F.avg(-(F.col("y") * F.log(q) + (F.lit(1.0) - F.col("y")) * F.log(F.lit(1.0) - q))).alias("nll"))


def temperature_fit(val: DataFrame, by: list[str], rounds: int = 3) -> DataFrame:
    """(by, log_t): coarse-to-fine; each round is one aggregation over all groups with a grid of its own per group."""
    centre = val.select(*by).distinct().withColumn("c", F.lit(0.0)).withColumn("w", F.lit(3.0))
    z, y = logit(F.col("prob")), F.col("y").cast("double")
    for _ in range(rounds):
        rows = val.join(centre, by).select(*by, "c", "w", z.alias("z"), y.alias("y"), F.explode(F.sequence(F.lit(-12), F.lit(12))).alias("_k"))
        log_t = F.least(F.lit(3.0), F.greatest(F.lit(-3.0), F.col("c") + F.col("w") * F.col("_k") / F.lit(12.0)))
        q = F.least(F.greatest(sigmoid(F.col("z") / F.exp(log_t)), F.lit(1e-12)), F.lit(1 - 1e-12))
        nll = rows.groupBy(*by, "w", log_t.alias("log_t")).agg(F.avg(-(F.col("y") * F.log(q) + (F.lit(1.0) - F.col("y")) * F.log(F.lit(1.0) - q))).alias("nll"))
        centre = nll.groupBy(*by).agg(F.min_by("log_t", F.struct(F.round("nll", 12), F.abs("log_t"))).alias("c"), (F.max("w") / 8).alias("w"))
    return centre.select(*by, F.col("c").alias("log_t"))


def ece_brier(preds: DataFrame, by: list[str], n_bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins, and the Brier score."""
    cell = F.least(F.lit(n_bins - 1), F.floor(F.col("prob") * n_bins)).alias("cell")
    cells = preds.groupBy(*by, cell).agg(F.count("*").alias("n"), F.avg("prob").alias("p"), F.avg("y").alias("o"), F.sum((F.col("prob") - F.col("y")) ** 2).alias("sq"))
    return cells.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("o"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"))


def risk_threshold(val: DataFrame, by: list[str], alpha: float, delta: float) -> DataFrame:
    """(by, n, k, t_low): the most misses k whose binomial tail certifies a miss rate of at most alpha at 1 - delta, and its threshold.

    The Clopper-Pearson bound is at most alpha exactly when BinomCDF(k; n, alpha) <= delta. Scores below t_low are
    suppressed; without a certificate k and t_low are NULL.
    """
    rank = F.row_number().over(W.partitionBy(*by).orderBy("prob"))
    pos = val.where("y = 1").withColumn("rn", rank).withColumn("n", F.count("*").over(W.partitionBy(*by)))
    sizes = pos.groupBy(*by).agg(F.max("n").alias("n"))
    # log terms by a running sum over k: ln C(n, k) grows by ln((n - k + 1) / k); k beyond alpha * n cannot certify
    terms = sizes.select(*by, "n", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.ceil(F.col("n") * F.lit(alpha))).cast("int"))).alias("k"))
    step = F.when(F.col("k") == 0, F.col("n") * F.lit(_ln(1 - alpha))).otherwise(F.log((F.col("n") - F.col("k") + 1).cast("double") / F.col("k")) + F.lit(_ln(alpha) - _ln(1 - alpha)))
    upto = W.partitionBy(*by).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    cdf = terms.withColumn("lp", F.sum(step).over(upto)).withColumn("cdf", F.sum(F.exp("lp")).over(upto))
    best = cdf.where(F.col("cdf") <= delta).groupBy(*by).agg(F.max("k").alias("k"))
    found = sizes.join(best, by, "left")
    at = pos.select(*by, (F.col("rn") - 1).alias("k"), F.col("prob").alias("t_low"))
    return found.join(at, [*by, "k"], "left").select(*by, "n", "k", F.when(F.col("k") == F.col("n"), F.lit(1 + 1e-9)).otherwise(F.col("t_low")).alias("t_low"))


def _ln(x: float) -> float:
    import math

    return math.log(x)


def triage(preds: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """Below t_low suppress, from max(0.5, t_low) high, between defer; without a certificate everything is high."""
    rows = preds.join(thresholds.select(*by, "t_low"), by, "left")
    band = F.when(F.col("t_low").isNull(), "high").when(F.col("prob") < F.col("t_low"), "suppress").when(F.col("prob") >= F.greatest(F.lit(0.5), "t_low"), "high").otherwise("defer")
    return rows.withColumn("band", band)


def clinical_utility(banded: DataFrame, by: list[str]) -> DataFrame:
    """Per 100 alarms suppressed and deferred; per 1000 true alarms missed; share of false alarms held back."""
    s, t = F.col("band") == "suppress", F.col("y") == 1
    n = F.count("*")
    return banded.groupBy(*by).agg(
        n.alias("alarms"), (F.count_if(s) * 100.0 / n).alias("suppressed_per_100"), (F.count_if(F.col("band") == "defer") * 100.0 / n).alias("deferred_per_100"),
        F.when(F.count_if(t) > 0, F.count_if(s & t) * 1000.0 / F.count_if(t)).alias("missed_per_1000"), F.when(F.count_if(~t) > 0, F.count_if(s & ~t) / F.count_if(~t).cast("double")).alias("fa_suppressed"),
    )


def decision_curve(preds: DataFrame, by: list[str]) -> DataFrame:
    """Net benefit of the model and of alarming always at 91 thresholds; rows are summed into cells first."""
    cell = F.least(F.lit(100), F.floor(F.round(F.col("prob") * 100, 9))).cast("int").alias("cell")
    cells = preds.groupBy(*by, cell).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("q"))
    totals = cells.groupBy(*by).agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    at = cells.select(*by, "cell", "p", "q", F.explode(F.sequence(F.lit(5), F.lit(95))).alias("k"))
    at = at.groupBy(*by, "k").agg(F.sum(F.when(F.col("cell") >= F.col("k"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("cell") >= F.col("k"), F.col("q")).otherwise(0)).alias("fp")).join(totals, by)
    t = F.col("k") / F.lit(100.0)
    n = F.col("np") + F.col("nq")
    return at.select(*by, t.alias("threshold"), (F.col("tp") / n - F.col("fp") / n * t / (F.lit(1.0) - t)).alias("model"), (F.col("np") / n - F.col("nq") / n * t / (F.lit(1.0) - t)).alias("always"))
