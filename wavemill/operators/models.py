"""Feature preparation and Spark ML classifiers per fold, their search and their importances."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.quantiles import exact_quantiles
from ..functions.ranking import ranked
from .metrics import auc

#: name -> (hyperparameters -> estimator). MLP has no weights; all others balance the classes by weightCol.
ESTIMATORS: dict[str, Callable] = {
    "logreg": lambda p: LogisticRegression(featuresCol="f", labelCol="y", weightCol="w", regParam=p.get("reg", 0.01), maxIter=30),
    "rf": lambda p: RandomForestClassifier(featuresCol="f", labelCol="y", weightCol="w", numTrees=p.get("trees", 20), maxDepth=p.get("depth", 5), seed=7),
    "boost": lambda p: GBTClassifier(featuresCol="f", labelCol="y", weightCol="w", maxIter=p.get("rounds", 8), maxDepth=p.get("depth", 3), seed=7),
    "svc": lambda p: LinearSVC(featuresCol="f", labelCol="y", weightCol="w", regParam=p.get("reg", 0.01), maxIter=20),
    "mlp": lambda p: MultilayerPerceptronClassifier(featuresCol="f", labelCol="y", layers=[p["inputs"], p.get("hidden", 8), 2], maxIter=40, seed=7),
}


def prep_pipeline(rows: DataFrame, features: list[str], by: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Median for NULL, clip to percentiles, standardise; everything learned on role = 'fit' of each ``by`` only."""
    fit = rows.where("role = 'fit'")
    edges = exact_quantiles(fit, features, [low, 0.5, high], by).withColumnsRenamed({f"q_{c}": f"_q_{c}" for c in features})
    filled = lambda t: t.select(*[c for c in rows.columns if c not in features], *(F.least(F.greatest(F.coalesce(F.nanvl(c, F.lit(None)), F.col(f"_q_{c}")[1]), F.col(f"_q_{c}")[0]), F.col(f"_q_{c}")[2]).alias(c) for c in features))
    clipped = filled(rows.join(edges, by, "left"))
    stats = clipped.where("role = 'fit'").groupBy(*by).agg(*(s for c in features for s in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    out = clipped.join(stats, by)
    return out.select(*[c for c in rows.columns if c not in features], *(((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + F.lit(1e-6))).alias(c) for c in features))


def standardize_clip(rows: DataFrame, features: list[str], by: list[str], most: float = 5.0) -> DataFrame:
    stats = rows.where("role = 'fit'").groupBy(*by).agg(*(s for c in features for s in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    z = lambda c: F.least(F.lit(most), F.greatest(F.lit(-most), (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + F.lit(1e-6))))
    return rows.join(stats, by).select(*[c for c in rows.columns if c not in features], *(z(c).alias(c) for c in features))


def _vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="f", handleInvalid="keep").transform(rows.fillna(0.0, subset=features))


def _score(model, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows)
    if "probability" in scored.columns:
        return scored.withColumn("prob", vector_to_array("probability")[1])
    return scored.withColumn("prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-vector_to_array("rawPrediction")[1])))


def fit_fold(rows: DataFrame, features: list[str], name: str, params: dict | None = None):
    """A model of the named estimator on role = 'fit', classes balanced by weight."""
    fit = _vectors(rows.where("role = 'fit'"), features).withColumn("y", F.col("y").cast("double"))
    counts = fit.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    pos, neg = max(counts.p or 0.0, 1.0), max((counts.n or 0) - (counts.p or 0.0), 1.0)
    weighted = fit.withColumn("w", F.when(F.col("y") == 1, counts.n / (2 * pos)).otherwise(counts.n / (2 * neg)))
    return ESTIMATORS[name]({"inputs": len(features)} | (params or {})).fit(weighted)


def predict_fold(model, rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    return _score(model, _vectors(rows.where("role <> 'fit'"), features)).select(*keep, "role", "y", "prob")


def cross_predict(rows: DataFrame, features: list[str], names: list[str], folds: list[int], keep: list[str]) -> DataFrame:
    """Predictions (variant, fold, keep, role, y, prob) of every named estimator and fold; folds and names are few."""
    out = None
    for fold in folds:
        part = rows.where(F.col("fold") == fold)
        for name in names:
            one = predict_fold(fit_fold(part, features, name), part, features, keep).withColumns({"variant": F.lit(name), "fold": F.lit(fold)})
            out = one if out is None else out.unionByName(one)
    return out


def permutation_importance(model, rows: DataFrame, features: list[str], key: str, reps: int = 2, seed: str = "imp") -> DataFrame:
    """(feature, drop): loss of AUC when one feature's values are dealt anew among the rows, mean over repetitions.

    All repetitions of all features are one plan: a row is scored once for each, with the value that its place in that
    repetition's shuffled order brings.
    """
    real = auc(_score(model, _vectors(rows, features)).withColumn("k", F.lit(1)), ["k"]).first().auc
    trial = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(r).alias("rep")) for c in features for r in range(reps)))).alias("trial")
    value = reduce(lambda x, c: F.when(F.col("trial.feature") == c, F.col(c)).otherwise(x), features, F.lit(None).cast("double"))
    ends = float(1 << 32)
    fixed = ranked(rows, [], draw(F.lit(seed), F.col(key)), [key], 0.0, ends, "_a")
    trials = rows.select("*", trial).select(F.col("trial.feature").alias("feature"), F.col("trial.rep").alias("rep"), key, value.alias("_v"))
    dealt = ranked(trials, ["feature", "rep"], draw(F.concat_ws("-", F.lit(seed), "feature", "rep"), F.col(key)), [key], 0.0, ends, "_a").select("feature", "rep", "_v", "_a")
    mixed = fixed.join(dealt, "_a").withColumns({c: F.when(F.col("feature") == c, F.col("_v")).otherwise(F.col(c)) for c in features})
    found = auc(_score(model, _vectors(mixed, features)), ["feature", "rep"])
    return found.groupBy("feature").agg(F.avg(F.lit(real) - F.col("auc")).alias("drop"))
