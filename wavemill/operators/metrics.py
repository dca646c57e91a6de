"""Evaluation aggregates over prediction tables. A prediction is positive when prob >= threshold."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Operating points: sensitivity each must reach on validation rows; t50 is the fixed threshold.
TARGETS = {"s95": 0.95, "s99": 0.99, "s100": 1.0}


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as a double, NULL on an empty denominator."""
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double"))


def confusion(preds: DataFrame, by: list[str], threshold: Column | float = 0.5) -> DataFrame:
    hit, y = F.col("prob") >= threshold, F.col("y") == 1
    return preds.groupBy(*by).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"))


def sensitivity() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def specificity() -> Column:
    return ratio(F.col("tn"), F.col("tn") + F.col("fp"))


def f1() -> Column:
    return F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))


def accuracy() -> Column:
    return ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))


def suppression() -> Column:
    """False alarms that are held back."""
    return specificity()


def challenge_score() -> Column:
    """A missed true alarm weighs five times."""
    return ratio(100 * (F.col("tp") + F.col("tn")), F.col("tp") + F.col("tn") + F.col("fp") + 5 * F.col("fn"))


#: Metric registry: each makes a column from tp, fp, tn, fn.
METRICS: dict[str, Callable[[], Column]] = {"sensitivity": sensitivity, "specificity": specificity, "f1": f1, "accuracy": accuracy, "suppression": suppression, "score": challenge_score}


#: Ranges of [0, 1] in which the distinct scores of one AUC are put in order; scores outside lie in the outer ones.
SCORE_RANGES = 4096


def _areas(preds: DataFrame, by: list[str], threshold: float, weight: str | None = None) -> DataFrame:
    """(by, tp, fp, tn, fn, auc) in one pass.

    Rows are summed per distinct score. A task puts the scores of one range in order, the area under a range's own steps is
    known there, and only the ranges' sums meet per group, so a group's scores need not fit into a task.
    """
    w = F.col(weight) if weight else F.lit(1)
    place = F.least(F.lit(SCORE_RANGES - 1), F.greatest(F.lit(0), F.floor(F.col("prob") * SCORE_RANGES)))
    place = F.when(F.col("prob").isNull(), -1).when(F.isnan("prob"), SCORE_RANGES - 1).otherwise(place).cast("int")
    per = preds.groupBy(*by, place.alias("_range"), "prob").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") != 1, w).otherwise(0)).alias("neg"))
    before = lambda *within: W.partitionBy(*by, *within[:-1]).orderBy(within[-1]).rowsBetween(W.unboundedPreceding, -1)
    under = F.coalesce(F.sum("neg").over(before("_range", "prob")), F.lit(0))
    hit = F.col("prob") >= threshold
    at = lambda cond, n, name: F.sum(F.when(cond, F.col(n)).otherwise(0)).alias(name)
    counts = [at(hit, "pos", "tp"), at(hit, "neg", "fp"), at(~hit, "neg", "tn"), at(~hit, "pos", "fn")]
    own = F.sum(F.col("pos") * (F.col("_under") + F.col("neg") / F.lit(2.0))).alias("won")
    ranges = per.withColumn("_under", under).groupBy(*by, "_range").agg(own, F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), *counts)
    ranges = ranges.withColumn("_under", F.coalesce(F.sum("neg").over(before("_range")), F.lit(0)))
    sums = ranges.groupBy(*by).agg(F.sum(F.col("won") + F.col("pos").cast("double") * F.col("_under")).alias("won"), *(F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp", "tn", "fn")))
    return sums.select(*by, "tp", "fp", "tn", "fn", ratio(F.col("won"), F.col("pos") * F.col("neg")).alias("auc"))


def auc(preds: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """ROC AUC with ties at mid-rank; NULL on a single class. Rows are summed per distinct score before any ordering."""
    return _areas(preds, by, 0.5, weight).select(*by, "auc")


def same(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in by))


def binary_metrics(preds: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in by), F.lit(True))
    return _areas(preds.where(known), by, threshold).select(*by, "tp", "fp", "tn", "fn", sensitivity().alias("sensitivity"), specificity().alias("specificity"), f1().alias("f1"), "auc", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"), (F.col("tp") + F.col("fn")).alias("n_pos"))


def threshold_for_sensitivity(val: DataFrame, by: list[str], targets: dict[str, float] = TARGETS) -> DataFrame:
    """(by, op, threshold): the k-th largest positive score, k = clamp(ceil(target * positives)); 0.5 without positives."""
    largest = W.partitionBy(*by).orderBy(F.col("prob").desc())
    pos = val.where("y = 1").withColumn("rn", F.row_number().over(largest)).withColumn("n", F.count("*").over(W.partitionBy(*by)))
    ops = F.explode(F.map_from_arrays(F.array(*map(F.lit, targets)), F.array(*(F.lit(float(t)) for t in targets.values())))).alias("op", "target")
    k = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.round(F.col("target") * F.col("n"), 9))))
    found = pos.select(*by, "prob", "rn", "n", ops).where(F.col("rn") == k).select(*by, "op", F.col("prob").alias("threshold"))
    every = val.select(*by).distinct().select(*by, F.explode(F.array(*map(F.lit, targets))).alias("op"))
    return every.join(found, [*by, "op"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))


def operating_points(preds: DataFrame, by: list[str], targets: dict[str, float] = TARGETS, extra: list[str] | None = None) -> DataFrame:
    """Thresholds from validation rows applied to test rows, t50 included: by, extra, op, threshold, tp, fp, tn, fn."""
    found = threshold_for_sensitivity(preds.where("role = 'val'"), by, targets)
    t50 = preds.where("role = 'test'").select(*by).distinct().select(*by, F.lit("t50").alias("op"), F.lit(0.5).alias("threshold"))
    at = preds.where("role = 'test'").join(found.unionByName(t50), by)
    return confusion(at, [*by, *(extra or []), "op", "threshold"], F.col("threshold"))


def fold_summary(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and population deviation of each value, NULLs skipped."""
    return rows.groupBy(*by).agg(*(a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"))))


def bins_by_edges(value: Column, edges: Column) -> Column:
    """Number of edges that are <= value."""
    return F.size(F.filter(edges, lambda e: e <= value))


def mid_rank(by: list[str], value: str) -> Column:
    """Average rank of ties within a partition."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / F.lit(2.0)


def spearman(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    ranked = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_ra", mid_rank(by, a)).withColumn("_rb", mid_rank(by, b))
    return ranked.groupBy(*by).agg(F.corr("_ra", "_rb").alias("spearman"))


def regression_quality(rows: DataFrame, by: list[str], y: str, fitted: str) -> DataFrame:
    """Pearson correlation, R squared and mean absolute error, in one aggregation."""
    around = F.var_pop(y) * F.count(y)  # squares around the mean
    return rows.groupBy(*by).agg(F.corr(y, fitted).alias("pearson"), (F.lit(1.0) - F.sum((F.col(y) - F.col(fitted)) ** 2) / around).alias("r2"), F.avg(F.abs(F.col(y) - F.col(fitted))).alias("mae"))


def entropy(prob: Column) -> Column:
    p = F.least(F.greatest(prob, F.lit(1e-6)), F.lit(1 - 1e-6))
    return -p * F.log(p) - (F.lit(1.0) - p) * F.log(F.lit(1.0) - p)


def best_f1_threshold(val: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold): of 91 thresholds from 0.05 to 0.95 the one with the largest F1, ties to the nearest of 0.5, then the smaller."""
    grid = F.explode(F.transform(F.sequence(F.lit(5), F.lit(95)), lambda k: k / F.lit(100.0))).alias("threshold")
    # rows are summed into the 91 cells first; the grid never multiplies them
    cell = F.least(F.lit(95), F.floor(F.round(F.col("prob") * 100, 9))).cast("int")
    cells = val.groupBy(*by, cell.alias("cell")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("q"))
    totals = cells.groupBy(*by).agg(F.sum("p").alias("n_pos"))
    at = cells.select(*by, "cell", "p", "q", grid)
    at = at.groupBy(*by, "threshold").agg(F.sum(F.when(F.col("cell") >= F.round(F.col("threshold") * 100), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("cell") >= F.round(F.col("threshold") * 100), F.col("q")).otherwise(0)).alias("fp"))
    at = at.join(totals, by).withColumn("fn", F.col("n_pos") - F.col("tp")).withColumn("f1", f1())
    best = W.partitionBy(*by).orderBy(F.col("f1").desc(), F.round(F.abs(F.col("threshold") - 0.5), 9), "threshold")
    return at.withColumn("rn", F.row_number().over(best)).where("rn = 1").select(*by, "threshold", F.col("f1").alias("val_f1"))
