"""Combining members of a prediction table; each combiner maps a table with several variants to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import stored
from .metrics import auc
from .safety import logit, sigmoid

KEY = ["seed", "fold", "role", "record_id"]


def ens_mean(preds: DataFrame) -> DataFrame:
    return preds.groupBy(*KEY).agg(F.avg("prob").alias("prob"), F.max("y").alias("y"))


def ens_logit(preds: DataFrame) -> DataFrame:
    return preds.groupBy(*KEY).agg(sigmoid(F.avg(logit(F.col("prob")))).alias("prob"), F.max("y").alias("y"))


def ens_topk(preds: DataFrame, k: int) -> DataFrame:
    """Mean of the k members with the best validation AUC of each seed and fold."""
    ranked = auc(preds.where("role = 'val'"), ["seed", "fold", "variant"])
    best = ranked.withColumn("rn", F.row_number().over(W.partitionBy("seed", "fold").orderBy(F.round("auc", 9).desc_nulls_last(), "variant"))).where(F.col("rn") <= k)
    return ens_mean(preds.join(best.select("seed", "fold", "variant"), ["seed", "fold", "variant"], "left_semi"))


def ens_greedy(preds: DataFrame, rounds: int = 12, gain: float = 1e-9) -> list[str]:
    """Forward selection with replacement by mean validation AUC; one job a round scores all candidates. Members are few.

    The validation rows of a record are met and stored once, so that a round reads them where they stand: the selection so far
    and every candidate added to it are sums over the record's own members.
    """
    member = F.struct("variant", "prob", "y")
    val = stored(preds.where("role = 'val'").groupBy("seed", "fold", "record_id").agg(F.sort_array(F.collect_list(member)).alias("members")))
    chosen: list[str] = []
    best = -1.0
    while len(chosen) < rounds:
        held = val.select("seed", "fold", F.inline("members"))
        if chosen:
            weight = lambda v: sum((F.when(v == c, F.lit(float(chosen.count(c)))).otherwise(0.0) for c in sorted(set(chosen))), F.lit(0.0))
            total = F.aggregate("members", F.lit(0.0), lambda acc, m: acc + F.coalesce(weight(m["variant"]) * m["prob"], F.lit(0.0)))
            added = F.transform("members", lambda m: F.struct(m["variant"].alias("variant"), ((F.col("sum") + m["prob"]) / F.lit(len(chosen) + 1.0)).alias("prob"), m["y"].alias("y")))
            # rows without a key meet no selection
            held = val.dropna(subset=["seed", "fold", "record_id"]).withColumn("sum", total).select("seed", "fold", F.inline(added))
        scored = auc(held, ["variant", "seed", "fold"]).groupBy("variant").agg(F.avg("auc").alias("auc"))
        top = scored.orderBy(F.col("auc").desc_nulls_last(), "variant").first()
        if top is None or top.auc is None or top.auc - best <= gain:
            break
        chosen.append(top.variant)
        best = top.auc
    return chosen


COMBINERS = {"mean": ens_mean, "logit": ens_logit}
