"""Metric plans over the prediction views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..operators import metrics as m
from . import fixtures as fx
from .fixtures import query

FOLD = ["variant", "seed", "fold"]


def oof(spark, d) -> DataFrame:
    """Out-of-fold test predictions with the attributes of their alarm."""
    a = fx.alarms(spark, d).select("record_id", "seed", "alarm_type", "quality", "lead_signature")
    return fx.predictions(spark, d).where("role = 'test'").join(a, ["record_id", "seed"])


def test_rows(spark, d) -> DataFrame:
    return fx.predictions(spark, d).where("role = 'test'")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# confusion counts of a grouping at one half, in the oracle's SQL
def _conf(view: str, by: str, threshold: str = "0.5") -> str:
    return f"SELECT {by}, count(*) FILTER (prob >= {threshold} AND y = 1) AS tp, count(*) FILTER (prob >= {threshold} AND y = 0) AS fp, count(*) FILTER (prob < {threshold} AND y = 0) AS tn, count(*) FILTER (prob < {threshold} AND y = 1) AS fn FROM {view} GROUP BY {by}"


def _auc(view: str, by: str) -> str:
    return f"SELECT {by}, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE END AS auc FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY prob) + (count(*) OVER (PARTITION BY {by}, prob) - 1) / 2.0::DOUBLE AS r FROM {view}) GROUP BY {by}"


_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END"
_SENS = "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END"
_SPEC = "CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) END"
_ACC = "(tp + tn)::DOUBLE / (tp + fp + tn + fn)"
_SCORE = "100.0::DOUBLE * (tp + tn) / (tp + tn + fp + 5 * fn)"
# thresholds from validation rows for every operating point
_THR = """
  pos AS (SELECT *, row_number() OVER (PARTITION BY variant, seed, fold ORDER BY prob DESC) AS rn, count(*) OVER (PARTITION BY variant, seed, fold) AS n FROM fx_predictions WHERE role = 'val' AND y = 1),
  tg(op, target) AS (VALUES ('s95', 0.95::DOUBLE), ('s99', 0.99::DOUBLE), ('s100', 1.0::DOUBLE)),
  thr AS (SELECT v.variant, v.seed, v.fold, t.op, coalesce(max(p.prob), 0.5) AS threshold FROM (SELECT DISTINCT variant, seed, fold FROM fx_predictions WHERE role = 'val') v CROSS JOIN tg t
          LEFT JOIN pos p ON p.variant = v.variant AND p.seed = v.seed AND p.fold = v.fold AND p.rn = greatest(1, least(p.n, ceil(round(t.target * p.n, 9)))) GROUP BY ALL)"""
_OPS = f"""{_THR},
  lim AS (SELECT * FROM thr UNION ALL SELECT DISTINCT variant, seed, fold, 't50', 0.5::DOUBLE FROM fx_predictions WHERE role = 'test'),
  ops AS (SELECT p.variant, p.seed, p.fold, l.op, l.threshold, count(*) FILTER (prob >= threshold AND y = 1) AS tp, count(*) FILTER (prob >= threshold AND y = 0) AS fp,
          count(*) FILTER (prob < threshold AND y = 0) AS tn, count(*) FILTER (prob < threshold AND y = 1) AS fn FROM fx_predictions p JOIN lim l USING (variant, seed, fold) WHERE p.role = 'test' GROUP BY ALL)"""


@query("confusion", _conf("(SELECT * FROM fx_predictions WHERE role = 'test')", "variant, seed, fold"))
def confusion(spark, d):
    return m.confusion(test_rows(spark, d), FOLD)


@query("binary_metrics", f"WITH c AS ({_conf('fx_oof', 'variant, seed')}), a AS ({_auc('fx_oof', 'variant, seed')}) SELECT variant, seed, tp, fp, tn, fn, round({_SENS}, 6) AS sensitivity, round({_SPEC}, 6) AS specificity, round({_F1}, 6) AS f1, round(auc, 6) AS auc, tp + fp + tn + fn AS n, tp + fn AS n_pos FROM c JOIN a USING (variant, seed)")
def binary_metrics(spark, d):
    rows = m.binary_metrics(test_rows(spark, d), ["variant", "seed"])
    return rows.select("variant", "seed", "tp", "fp", "tn", "fn", *r6("sensitivity", "specificity", "f1", "auc"), "n", "n_pos")


@query("auc_rank", f"SELECT variant, seed, fold, round(auc, 6) AS auc FROM ({_auc('(SELECT * FROM fx_predictions WHERE role = ' + chr(39) + 'test' + chr(39) + ')', 'variant, seed, fold')})")
def auc_rank(spark, d):
    return m.auc(test_rows(spark, d), FOLD).select(*FOLD, *r6("auc"))


@query("challenge_score", f"SELECT variant, round({_SCORE}, 6) AS score FROM ({_conf('fx_oof', 'variant')})")
def challenge_score(spark, d):
    return m.confusion(test_rows(spark, d), ["variant"]).select("variant", F.round(m.challenge_score(), 6).alias("score"))


@query("accuracy", f"SELECT variant, seed, round({_ACC}, 6) AS accuracy FROM ({_conf('fx_oof', 'variant, seed')})")
def accuracy(spark, d):
    return m.confusion(test_rows(spark, d), ["variant", "seed"]).select("variant", "seed", F.round(m.accuracy(), 6).alias("accuracy"))


@query("suppression_rate", f"SELECT variant, alarm_type, round({_SPEC}, 6) AS suppression FROM ({_conf('fx_oof', 'variant, alarm_type')})")
def suppression_rate(spark, d):
    return m.confusion(oof(spark, d), ["variant", "alarm_type"]).select("variant", "alarm_type", F.round(m.suppression(), 6).alias("suppression"))


@query("threshold_for_sensitivity", f"WITH {_THR} SELECT variant, seed, fold, op, round(threshold, 9) AS threshold FROM thr")
def threshold_for_sensitivity(spark, d):
    return m.threshold_for_sensitivity(fx.predictions(spark, d).where("role = 'val'"), FOLD).select(*FOLD, "op", F.round("threshold", 9).alias("threshold"))


@query("operating_points", f"WITH {_OPS} SELECT variant, seed, fold, op, round(threshold, 9) AS threshold, tp, fp, tn, fn FROM ops")
def operating_points(spark, d):
    return m.operating_points(fx.predictions(spark, d), FOLD).withColumn("threshold", F.round("threshold", 9))


@query("fold_summary", f"WITH c AS (SELECT variant, seed, fold, {_F1} AS f1, {_SENS} AS sensitivity FROM ({_conf('fx_oof', 'variant, seed, fold')})) SELECT variant, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std, round(avg(sensitivity), 6) AS sensitivity_mean, round(stddev_pop(sensitivity), 6) AS sensitivity_std FROM c GROUP BY variant")
def fold_summary(spark, d):
    rows = m.confusion(test_rows(spark, d), FOLD).select(*FOLD, m.f1().alias("f1"), m.sensitivity().alias("sensitivity"))
    return m.fold_summary(rows, ["variant"], ["f1", "sensitivity"]).select("variant", *r6("f1_mean", "f1_std", "sensitivity_mean", "sensitivity_std"))


@query("comparison_table", f"""WITH {_OPS}, macro AS (SELECT variant, avg({_F1}) AS f1 FROM ops WHERE op = 't50' GROUP BY variant),
  micro AS (SELECT variant, op, sum(tn)::DOUBLE / sum(tn + fp) AS suppression, sum(tp)::DOUBLE / sum(tp + fn) AS realised FROM ops GROUP BY variant, op)
  SELECT variant, op, round(f1, 6) AS f1, round(suppression, 6) AS suppression, round(realised, 6) AS realised_sensitivity FROM micro JOIN macro USING (variant)""")
def comparison_table(spark, d):
    ops = m.operating_points(fx.predictions(spark, d), FOLD)
    macro = ops.where("op = 't50'").groupBy("variant").agg(F.avg(m.f1()).alias("f1"))
    pooled = ops.groupBy("variant", "op").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")))
    micro = pooled.select("variant", "op", m.suppression().alias("suppression"), m.sensitivity().alias("realised_sensitivity"))
    return micro.join(F.broadcast(macro), "variant").select("variant", "op", *r6("f1", "suppression", "realised_sensitivity"))


@query("oof_pool", "SELECT variant, seed, fold, record_id, round(prob, 9) AS prob, y, alarm_type, round(quality, 9) AS quality, lead_signature FROM fx_oof")
def oof_pool(spark, d):
    return oof(spark, d).select(*FOLD, "record_id", F.round("prob", 9).alias("prob"), "y", "alarm_type", F.round("quality", 9).alias("quality"), "lead_signature")


@query("per_alarm_type", f"""WITH c AS ({_conf('fx_oof', 'variant, alarm_type')}), a AS ({_auc('fx_oof', 'variant, alarm_type')}), s AS (SELECT variant, alarm_type, count(DISTINCT seed) AS seeds FROM fx_oof GROUP BY ALL)
  SELECT variant, alarm_type, (tp + fp + tn + fn) // seeds AS n, round({_SENS}, 6) AS sensitivity, round({_SPEC}, 6) AS specificity, round({_F1}, 6) AS f1, round(auc, 6) AS auc, round({_SCORE}, 6) AS score
  FROM c JOIN a USING (variant, alarm_type) JOIN s USING (variant, alarm_type)""")
def per_alarm_type(spark, d):
    """How well each variant verifies each type of alarm; n counts windows, not window-seed pairs."""
    rows, by = oof(spark, d), ["variant", "alarm_type"]
    seeds = rows.groupBy(*by).agg(F.countDistinct("seed").alias("seeds"))
    out = m.binary_metrics(rows, by).join(seeds, by).withColumn("score", m.challenge_score())
    return out.select(*by, F.floor(F.col("n") / F.col("seeds")).alias("n"), *r6("sensitivity", "specificity", "f1", "auc", "score"))


@query("quality_stratified", f"""WITH e AS (SELECT quantile_cont(quality, 0.25) AS a, quantile_cont(quality, 0.5) AS b, quantile_cont(quality, 0.75) AS c FROM fx_alarms),
  q AS (SELECT o.*, (quality >= a)::INT + (quality >= b)::INT + (quality >= c)::INT AS bin FROM fx_oof o CROSS JOIN e)
  SELECT variant, bin, tp + fp + tn + fn AS n, round({_SENS}, 6) AS sensitivity, round({_SPEC}, 6) AS specificity, round({_F1}, 6) AS f1 FROM ({_conf('q', 'variant, bin')})""")
def quality_stratified(spark, d):
    edges = exact_quantiles(fx.alarms(spark, d), ["quality"], [0.25, 0.5, 0.75]).withColumnRenamed("q_quality", "edges")  # one row
    rows = oof(spark, d).join(F.broadcast(edges)).withColumn("bin", m.bins_by_edges(F.col("quality"), F.col("edges")))
    out = m.confusion(rows, ["variant", "bin"])
    return out.select("variant", "bin", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"), F.round(m.sensitivity(), 6).alias("sensitivity"), F.round(m.specificity(), 6).alias("specificity"), F.round(m.f1(), 6).alias("f1"))


@query("per_type_suppression", f"""WITH {_THR} SELECT o.variant, o.alarm_type, t.op, count(*) FILTER (prob >= threshold AND y = 1) AS tp, count(*) FILTER (prob >= threshold AND y = 0) AS fp, count(*) FILTER (prob < threshold AND y = 0) AS tn,
  count(*) FILTER (prob < threshold AND y = 1) AS fn, round(count(*) FILTER (prob < threshold AND y = 0)::DOUBLE / nullif(count(*) FILTER (y = 0), 0), 6) AS suppression FROM fx_oof o JOIN thr t USING (variant, seed, fold) GROUP BY ALL""")
def per_type_suppression(spark, d):
    found = m.threshold_for_sensitivity(fx.predictions(spark, d).where("role = 'val'"), FOLD)
    pooled = m.confusion(oof(spark, d).join(found, FOLD), ["variant", "alarm_type", "op"], F.col("threshold"))
    return pooled.withColumn("suppression", F.round(m.suppression(), 6))


@query("record_tallies", f"WITH {_THR} SELECT o.variant, o.seed, o.record_id, count(*) FILTER (prob >= threshold AND y = 1) AS tp, count(*) FILTER (prob >= threshold AND y = 0) AS fp, count(*) FILTER (prob < threshold AND y = 0) AS tn, count(*) FILTER (prob < threshold AND y = 1) AS fn FROM fx_oof o JOIN thr t USING (variant, seed, fold) WHERE op = 's95' GROUP BY ALL")
def record_tallies(spark, d):
    found = m.threshold_for_sensitivity(fx.predictions(spark, d).where("role = 'val'"), FOLD, {"s95": 0.95})
    return m.confusion(test_rows(spark, d).join(found, FOLD), ["variant", "seed", "record_id"], F.col("threshold"))


@query("subject_probs", "SELECT variant, record_id, round(avg(prob), 9) AS prob, max(y) AS y, count(*) AS windows FROM fx_oof GROUP BY variant, record_id")
def subject_probs(spark, d):
    return test_rows(spark, d).groupBy("variant", "record_id").agg(F.round(F.avg("prob"), 9).alias("prob"), F.max("y").alias("y"), F.count("*").alias("windows"))


@query("val_best_f1_threshold", f"""WITH g AS (SELECT unnest(range(5, 96)) / 100.0::DOUBLE AS threshold), v AS (SELECT * FROM fx_predictions WHERE role = 'val'),
  c AS (SELECT variant, seed, fold, threshold, count(*) FILTER (floor(round(prob * 100, 9)) >= round(threshold * 100) AND y = 1) AS tp, count(*) FILTER (floor(round(prob * 100, 9)) >= round(threshold * 100) AND y = 0) AS fp,
    count(*) FILTER (floor(round(prob * 100, 9)) < round(threshold * 100) AND y = 1) AS fn FROM v CROSS JOIN g GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY variant, seed, fold ORDER BY {_F1} DESC, round(abs(threshold - 0.5), 9), threshold) AS rn FROM c)
  SELECT variant, seed, fold, threshold, round({_F1}, 6) AS val_f1 FROM b WHERE rn = 1""")
def val_best_f1_threshold(spark, d):
    return m.best_f1_threshold(fx.predictions(spark, d).where("role = 'val'"), FOLD).withColumn("val_f1", F.round("val_f1", 6))


@query("entropy_uncertainty", "SELECT variant, seed, fold, record_id, round(-p * ln(p) - (1 - p) * ln(1 - p), 6) AS entropy FROM (SELECT *, least(greatest(prob, 1e-6::DOUBLE), 1.0::DOUBLE - 1e-6::DOUBLE) AS p FROM fx_oof)")
def entropy_uncertainty(spark, d):
    return test_rows(spark, d).select(*FOLD, "record_id", F.round(m.entropy(F.col("prob")), 6).alias("entropy"))


_REL = """WITH v AS (SELECT event_id, avg(decision) AS frac, count(*) AS n FROM fx_votes WHERE NOT is_adjudication GROUP BY event_id HAVING count(*) >= 2),
  p AS (SELECT record_id, round(avg(prob), 9) AS prob, max(y) AS y FROM fx_oof WHERE variant = 'A' GROUP BY record_id),
  j AS (SELECT p.record_id, p.prob, p.y, 1 - abs(2 * frac - 1) AS dis, CASE WHEN abs(2 * frac - 1) < 1 THEN 'split' ELSE 'unanimous' END AS grp,
    round(-p9 * ln(p9) - (1 - p9) * ln(1 - p9), 9) AS h
    FROM (SELECT *, least(greatest(prob, 1e-6::DOUBLE), 1.0::DOUBLE - 1e-6::DOUBLE) AS p9 FROM p) p JOIN v ON p.record_id = v.event_id)"""


def _reliability(spark, d):
    v = fx.votes(spark, d).where("not is_adjudication").groupBy("event_id").agg(F.avg("decision").alias("frac"), F.count("*").alias("n")).where("n >= 2")
    p = test_rows(spark, d).where("variant = 'A'").groupBy("record_id").agg(F.round(F.avg("prob"), 9).alias("prob"), F.max("y").alias("y"))
    split = F.abs(2 * F.col("frac") - 1)
    return p.join(v, p["record_id"] == v["event_id"]).select("record_id", "prob", "y", (F.lit(1.0) - split).alias("dis"), F.when(split < 1, "split").otherwise("unanimous").alias("grp"), F.round(m.entropy(F.col("prob")), 9).alias("h"))


@query("label_reliability", f"{_REL}, c AS ({_conf('j', 'grp')}), a AS ({_auc('j', 'grp')}) SELECT grp, tp + fp + tn + fn AS n, round({_F1}, 6) AS f1, round({_ACC}, 6) AS accuracy, round(auc, 6) AS auc FROM c JOIN a USING (grp) WHERE tp + fp + tn + fn >= 5")
def label_reliability(spark, d):
    rows = _reliability(spark, d)
    return m.binary_metrics(rows, ["grp"]).where("n >= 5").select("grp", "n", *r6("f1"), F.round(m.accuracy(), 6).alias("accuracy"), *r6("auc"))


@query("spearman", f"{_REL}, r AS (SELECT rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY dis) + (count(*) OVER (PARTITION BY dis) - 1) / 2.0::DOUBLE AS b FROM j) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman(spark, d):
    rows = _reliability(spark, d).withColumn("k", F.lit(1))
    return m.spearman(rows, ["k"], "h", "dis").select(*r6("spearman"))


@query("regression_quality", "WITH o AS (SELECT *, avg(quality) OVER (PARTITION BY variant) AS mq FROM fx_oof) SELECT variant, round(corr(quality, prob), 6) AS pearson, round(1 - sum((quality - prob) * (quality - prob)) / sum((quality - mq) * (quality - mq)), 6) AS r2, round(avg(abs(quality - prob)), 6) AS mae FROM o GROUP BY variant")
def regression_quality(spark, d):
    return m.regression_quality(oof(spark, d), ["variant"], "quality", "prob").select("variant", *r6("pearson", "r2", "mae"))


@query("soft_vs_hard", f"""WITH c AS (SELECT variant, seed, {_F1} AS f1 FROM ({_conf('fx_oof', 'variant, seed')})), a AS ({_auc('fx_oof', 'variant, seed')})
  SELECT h.seed, round(s.f1 - h.f1, 6) AS d_f1, round(sa.auc - ha.auc, 6) AS d_auc FROM c h JOIN c s ON h.seed = s.seed AND h.variant = 'A' AND s.variant = 'B' JOIN a ha ON ha.seed = h.seed AND ha.variant = 'A' JOIN a sa ON sa.seed = h.seed AND sa.variant = 'B'""")
def soft_vs_hard(spark, d):
    """Paired differences of two label treatments per seed (variant B against A)."""
    per = m.binary_metrics(test_rows(spark, d), ["variant", "seed"])
    hard, soft = (per.where(F.col("variant") == v).select("seed", F.col("f1").alias(f"f1_{v}"), F.col("auc").alias(f"auc_{v}")) for v in "AB")
    return hard.join(soft, "seed").select("seed", F.round(F.col("f1_B") - F.col("f1_A"), 6).alias("d_f1"), F.round(F.col("auc_B") - F.col("auc_A"), 6).alias("d_auc"))


@query("protocol_gap", f"""WITH f AS (SELECT variant, seed, fold, {_F1} AS f1 FROM ({_conf('fx_oof', 'variant, seed, fold')})), s AS (SELECT variant, seed, avg(f1) AS f1 FROM f GROUP BY ALL), v AS (SELECT variant, avg(f1) AS mean, stddev_samp(f1) AS sd FROM s GROUP BY variant)
  SELECT variant, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - (SELECT mean FROM v WHERE variant = 'A'), 6) AS gap FROM v""")
def protocol_gap(spark, d):
    folds = m.confusion(test_rows(spark, d), FOLD).select(*FOLD, m.f1().alias("f1"))
    seeds = folds.groupBy("variant", "seed").agg(F.avg("f1").alias("f1"))
    v = seeds.groupBy("variant").agg(F.avg("f1").alias("mean"), F.stddev_samp("f1").alias("sd"))
    base = v.where("variant = 'A'").select(F.col("mean").alias("base"))
    return v.join(F.broadcast(base)).select("variant", *r6("mean", "sd"), F.round(F.col("mean") - F.col("base"), 6).alias("gap"))


@query("paired_ablation", f"""WITH f AS (SELECT variant, seed, fold, {_F1} AS f1 FROM ({_conf('fx_oof', 'variant, seed, fold')})), p AS (SELECT b.variant, b.seed, b.fold, b.f1 - a.f1 AS d FROM f b JOIN f a USING (seed, fold) WHERE a.variant = 'A' AND b.variant <> 'A'),
  s AS (SELECT variant, seed, avg(d) AS d FROM p GROUP BY ALL) SELECT variant, round((SELECT avg(d) FROM p WHERE p.variant = s.variant), 6) AS mean_diff, round(stddev_samp(d) / sqrt(count(*)), 6) AS se FROM s GROUP BY variant""")
def paired_ablation(spark, d):
    """Mean paired difference over folds; the standard error comes from seed-level means."""
    folds = m.confusion(test_rows(spark, d), FOLD).select(*FOLD, m.f1().alias("f1"))
    pairs = folds.where("variant <> 'A'").join(folds.where("variant = 'A'").select("seed", "fold", F.col("f1").alias("f1_a")), ["seed", "fold"]).withColumn("d", F.col("f1") - F.col("f1_a"))
    seeds = pairs.groupBy("variant", "seed").agg(F.avg("d").alias("d"), F.sum("d").alias("total"), F.count("*").alias("n"))
    return seeds.groupBy("variant").agg(F.round(F.sum("total") / F.sum("n"), 6).alias("mean_diff"), F.round(F.stddev_samp("d") / F.sqrt(F.count("*")), 6).alias("se"))


@query("grid_summary", f"""WITH f AS (SELECT variant || '-' || seed AS config, variant AS family, fold, auc FROM ({_auc('fx_oof', 'variant, seed, fold')})), g AS (SELECT config, family, avg(auc) AS mean, stddev_samp(auc) AS sd, stddev_samp(auc) / sqrt(count(*)) AS se FROM f GROUP BY ALL)
  SELECT config, family, round(mean, 6) AS mean, round(sd, 6) AS sd, round(se, 6) AS se, row_number() OVER (ORDER BY round(mean, 9) DESC, config) = 1 AS best, row_number() OVER (PARTITION BY family ORDER BY round(mean, 9) DESC, config) = 1 AS best_in_family FROM g""")
def grid_summary(spark, d):
    rows = m.auc(test_rows(spark, d), FOLD).select(F.concat_ws("-", "variant", "seed").alias("config"), F.col("variant").alias("family"), "auc")
    g = rows.groupBy("config", "family").agg(F.avg("auc").alias("mean"), F.stddev_samp("auc").alias("sd"), (F.stddev_samp("auc") / F.sqrt(F.count("*"))).alias("se"))
    order = (F.round("mean", 9).desc(), F.col("config"))
    return g.select("config", "family", *r6("mean", "sd", "se"), (F.row_number().over(W.orderBy(*order)) == 1).alias("best"), (F.row_number().over(W.partitionBy("family").orderBy(*order)) == 1).alias("best_in_family"))


@query("transfer_matrix", f"""WITH o AS (SELECT variant, CASE WHEN seed <= 3 THEN 'a' ELSE 'b' END || '_to_' || CASE WHEN fold < 2 THEN 'a' ELSE 'b' END AS direction, prob, y FROM fx_oof), a AS ({_auc('o', 'variant, direction')})
  SELECT variant, round(max(auc) FILTER (direction = 'a_to_a'), 6) AS a_to_a, round(max(auc) FILTER (direction = 'a_to_b'), 6) AS a_to_b, round(max(auc) FILTER (direction = 'b_to_a'), 6) AS b_to_a, round(max(auc) FILTER (direction = 'b_to_b'), 6) AS b_to_b FROM a GROUP BY variant""")
def transfer_matrix(spark, d):
    side = lambda c: F.when(c, "a").otherwise("b")
    rows = test_rows(spark, d).withColumn("direction", F.concat_ws("_to_", side(F.col("seed") <= 3), side(F.col("fold") < 2)))
    return m.auc(rows, ["variant", "direction"]).groupBy("variant").pivot("direction", ["a_to_a", "a_to_b", "b_to_a", "b_to_b"]).agg(F.round(F.first("auc"), 6))


@query("label_efficiency", f"""WITH f AS (SELECT variant AS init, seed AS fraction, fold, {_F1} AS f1 FROM ({_conf('fx_oof', 'variant, seed, fold')})), p AS (SELECT x.init, x.fraction, x.f1, x.f1 - s.f1 AS d FROM f x LEFT JOIN f s ON s.init = 'A' AND s.fraction = x.fraction AND s.fold = x.fold)
  SELECT init, fraction, round(avg(f1), 6) AS f1, CASE WHEN count(d) >= 5 AND init <> 'A' THEN round(avg(d), 6) END AS d_scratch FROM p GROUP BY init, fraction""")
def label_efficiency(spark, d):
    """F1 by initialisation and label fraction, and its paired gain over training from scratch (variant A)."""
    f = m.confusion(test_rows(spark, d), FOLD).select(F.col("variant").alias("init"), F.col("seed").alias("fraction"), "fold", m.f1().alias("f1"))
    scratch = f.where("init = 'A'").select("fraction", "fold", F.col("f1").alias("base"))
    p = f.join(scratch, ["fraction", "fold"], "left").withColumn("d", F.col("f1") - F.col("base"))
    return p.groupBy("init", "fraction").agg(F.round(F.avg("f1"), 6).alias("f1"), F.when((F.count("d") >= 5) & (F.col("init") != "A"), F.round(F.avg("d"), 6)).alias("d_scratch"))


@query("leak_before_after", f"""WITH b AS (SELECT variant, {_F1} AS f1 FROM ({_conf("(SELECT * FROM fx_predictions WHERE role = 'val')", 'variant')})), a AS (SELECT variant, {_F1} AS f1 FROM ({_conf('fx_oof', 'variant')})) SELECT variant, round(b.f1, 6) AS before, round(a.f1, 6) AS after, round(a.f1 - b.f1, 6) AS change FROM b JOIN a USING (variant)""")
def leak_before_after(spark, d):
    """One variant's F1 on the rows that chose its threshold and on rows that did not."""
    p = fx.predictions(spark, d)
    before, after = (m.confusion(p.where(F.col("role") == r), ["variant"]).select("variant", m.f1().alias(r)) for r in ("val", "test"))
    return before.join(after, "variant").select("variant", F.round("val", 6).alias("before"), F.round("test", 6).alias("after"), F.round(F.col("test") - F.col("val"), 6).alias("change"))
