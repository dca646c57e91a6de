"""Plans of calibration, suppression, ensembles and the error taxonomy."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..operators import ensemble as en
from ..operators import errors as er
from ..operators import features as ft
from ..operators import metrics as m
from ..operators import safety as sf
from ..operators import stats as st
from ..operators import subgroups as sg
from ..sources.tables import stored
from . import fixtures as fx
from .beat_plans import _BT, HIGH, LOW, kind
from .evaluation import FOLD, _auc, oof, r6, test_rows
from .feature_plans import _Z
from .fixtures import query
from .statistics import _FISH

_L = "ln(least(greatest(prob, 1e-6::DOUBLE), 1.0::DOUBLE - 1e-6::DOUBLE) / (1.0::DOUBLE - least(greatest(prob, 1e-6::DOUBLE), 1.0::DOUBLE - 1e-6::DOUBLE)))"


@query("temperature_fit", f"""WITH g AS (SELECT variant, fold, -3.0::DOUBLE + k * 0.25::DOUBLE AS log_t, y, {_L} AS z FROM fx_predictions CROSS JOIN (SELECT unnest(range(25)) AS k) WHERE role = 'val'),
  n AS (SELECT variant, fold, log_t, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS nll FROM (SELECT *, least(greatest(1 / (1 + exp(-z / exp(log_t))), 1e-12::DOUBLE), 1.0::DOUBLE - 1e-12::DOUBLE) AS q FROM g) GROUP BY ALL)
  SELECT variant, fold, log_t, round(nll, 6) AS nll FROM (SELECT *, row_number() OVER (PARTITION BY variant, fold ORDER BY round(nll, 12), abs(log_t)) AS rn FROM n) WHERE rn = 1""")
def temperature_fit(spark, d):
    """The first grid; ``safety.temperature_fit`` refines it."""
    g = sf.temperature_grid(fx.predictions(spark, d).where("role = 'val'"), ["variant", "fold"])
    rn = F.row_number().over(W.partitionBy("variant", "fold").orderBy(F.round("nll", 12), F.abs("log_t")))
    return g.withColumn("rn", rn).where("rn = 1").select("variant", "fold", "log_t", *r6("nll"))


@query("ece_brier", "WITH c AS (SELECT variant, least(9, floor(prob * 10)) AS cell, count(*) AS n, avg(prob) AS p, avg(y) AS o, sum((prob - y) * (prob - y)) AS sq FROM fx_oof GROUP BY ALL) SELECT variant, round(sum(n * abs(p - o)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier FROM c GROUP BY variant")
def ece_brier(spark, d):
    return sf.ece_brier(test_rows(spark, d), ["variant"]).select("variant", *r6("ece", "brier"))


_RISK = """pos AS (SELECT variant, seed, fold, prob, row_number() OVER (PARTITION BY variant, seed, fold ORDER BY prob) AS rn, count(*) OVER (PARTITION BY variant, seed, fold) AS n FROM fx_predictions WHERE role = 'val' AND y = 1),
  sz AS (SELECT variant, seed, fold, max(n) AS n FROM pos GROUP BY ALL), tm AS (SELECT *, unnest(range(0, least(n, ceil(n * 0.1::DOUBLE))::BIGINT + 1)) AS k FROM sz),
  lp AS (SELECT *, sum(CASE WHEN k = 0 THEN n * ln(0.9::DOUBLE) ELSE ln((n - k + 1)::DOUBLE / k) + ln(0.1::DOUBLE) - ln(0.9::DOUBLE) END) OVER w AS lp FROM tm WINDOW w AS (PARTITION BY variant, seed, fold ORDER BY k ROWS UNBOUNDED PRECEDING)),
  cd AS (SELECT *, sum(exp(lp)) OVER (PARTITION BY variant, seed, fold ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM lp), bk AS (SELECT variant, seed, fold, max(k) AS k FROM cd WHERE cdf <= 0.1 GROUP BY ALL),
  rt AS (SELECT sz.variant, sz.seed, sz.fold, sz.n, bk.k::INT AS k, CASE WHEN bk.k = sz.n THEN 1.0::DOUBLE + 1e-9::DOUBLE ELSE pos.prob END AS t_low FROM sz LEFT JOIN bk USING (variant, seed, fold) LEFT JOIN pos ON pos.variant = sz.variant AND pos.seed = sz.seed AND pos.fold = sz.fold AND pos.rn = bk.k + 1),
  bd AS (SELECT o.*, CASE WHEN t_low IS NULL THEN 'high' WHEN prob < t_low THEN 'suppress' WHEN prob >= greatest(0.5, t_low) THEN 'high' ELSE 'defer' END AS band FROM fx_oof o LEFT JOIN rt USING (variant, seed, fold))"""


def _risk(spark, d):
    return sf.risk_threshold(fx.predictions(spark, d).where("role = 'val'"), FOLD, 0.1, 0.1)


@query("risk_threshold", f"WITH {_RISK} SELECT variant, seed, fold, n, k, round(t_low, 9) AS t_low FROM rt")
def risk_threshold(spark, d):
    return _risk(spark, d).select(*FOLD, "n", "k", F.round("t_low", 9).alias("t_low"))


@query("triage_bands", f"WITH {_RISK} SELECT variant, seed, fold, record_id, band FROM bd")
def triage_bands(spark, d):
    return sf.triage(test_rows(spark, d), _risk(spark, d), FOLD).select(*FOLD, "record_id", "band")


@query("clinical_utility", f"WITH {_RISK} SELECT variant, count(*) AS alarms, round(count(*) FILTER (band = 'suppress') * 100.0::DOUBLE / count(*), 6) AS suppressed_per_100, round(count(*) FILTER (band = 'defer') * 100.0::DOUBLE / count(*), 6) AS deferred_per_100, round(count(*) FILTER (band = 'suppress' AND y = 1) * 1000.0::DOUBLE / sum(y), 6) AS missed_per_1000, round(count(*) FILTER (band = 'suppress' AND y = 0)::DOUBLE / sum(1 - y), 6) AS fa_suppressed FROM bd GROUP BY variant")
def clinical_utility(spark, d):
    out = sf.clinical_utility(sf.triage(test_rows(spark, d), _risk(spark, d), FOLD), ["variant"])
    return out.select("variant", "alarms", *r6("suppressed_per_100", "deferred_per_100", "missed_per_1000", "fa_suppressed"))


@query("decision_curve", """WITH g AS (SELECT unnest(range(5, 96)) AS k), t AS (SELECT variant, sum(y) AS np, sum(1 - y) AS nq FROM fx_oof GROUP BY variant),
  c AS (SELECT variant, k, count(*) FILTER (floor(round(prob * 100, 9)) >= k AND y = 1) AS tp, count(*) FILTER (floor(round(prob * 100, 9)) >= k AND y = 0) AS fp FROM fx_oof CROSS JOIN g GROUP BY ALL)
  SELECT variant, k / 100.0::DOUBLE AS threshold, round(tp / (np + nq)::DOUBLE - fp / (np + nq)::DOUBLE * (k / 100.0::DOUBLE) / (1 - k / 100.0::DOUBLE), 6) AS model, round(np / (np + nq)::DOUBLE - nq / (np + nq)::DOUBLE * (k / 100.0::DOUBLE) / (1 - k / 100.0::DOUBLE), 6) AS always FROM c JOIN t USING (variant)""")
def decision_curve(spark, d):
    return sf.decision_curve(test_rows(spark, d), ["variant"]).select("variant", "threshold", *r6("model", "always"))


@query("ens_mean", "SELECT seed, fold, role, record_id, round(avg(prob), 8) AS prob, max(y) AS y FROM fx_predictions GROUP BY ALL")
def ens_mean(spark, d):
    return en.ens_mean(fx.predictions(spark, d)).withColumn("prob", F.round("prob", 8))


@query("clf_avg", "SELECT fold, record_id, seed, round(avg(prob), 8) AS prob, max(y) AS y FROM fx_oof WHERE variant <> 'C' GROUP BY ALL")
def clf_avg(spark, d):
    return en.ens_mean(fx.predictions(spark, d).where("role = 'test' and variant <> 'C'")).select("fold", "record_id", "seed", F.round("prob", 8).alias("prob"), "y")


@query("ens_logit", f"SELECT seed, fold, role, record_id, round(1 / (1 + exp(-avg({_L}))), 8) AS prob, max(y) AS y FROM fx_predictions GROUP BY ALL")
def ens_logit(spark, d):
    return en.ens_logit(fx.predictions(spark, d)).withColumn("prob", F.round("prob", 8))


@query("ens_topk", f"""WITH v AS (SELECT * FROM fx_predictions WHERE role = 'val'), a AS ({_auc('v', 'seed, fold, variant')}), k AS (SELECT seed, fold, variant FROM (SELECT *, row_number() OVER (PARTITION BY seed, fold ORDER BY round(auc, 9) DESC NULLS LAST, variant) AS rn FROM a) WHERE rn <= 2)
  SELECT seed, fold, role, record_id, round(avg(prob), 8) AS prob, max(y) AS y FROM fx_predictions JOIN k USING (seed, fold, variant) GROUP BY ALL""")
def ens_topk(spark, d):
    return en.ens_topk(fx.predictions(spark, d), 2).withColumn("prob", F.round("prob", 8))


@query("ens_greedy")
def ens_greedy(spark, d):
    """The members in order of selection and the mean of the selection; a driver loop of at most twelve jobs."""
    preds = fx.predictions(spark, d)
    chosen = en.ens_greedy(preds)
    weights = F.element_at(F.create_map(*(x for v in set(chosen) for x in (F.lit(v), F.lit(float(chosen.count(v)))))), F.col("variant"))
    return preds.where(F.col("variant").isin(*set(chosen))).groupBy(*en.KEY).agg((F.sum(weights * F.col("prob")) / F.lit(float(len(chosen)))).alias("prob"), F.max("y").alias("y")).withColumn("members", F.lit(",".join(chosen)))


_CONS = """er AS (SELECT variant, record_id, avg(((prob >= 0.5)::INT <> y)::INT) AS error, round(avg(prob), 9) AS prob, max(y) AS y, count(*) AS seeds FROM fx_oof GROUP BY variant, record_id),
  ct AS (SELECT *, CASE WHEN error >= 0.8 AND y = 1 THEN 'persistent_fn' WHEN error >= 0.8 THEN 'persistent_fp' WHEN error <= 0.2 THEN 'stable_correct' ELSE 'unstable' END AS category FROM er)"""


def _errors(spark, d):
    rows = er.consensus_error(test_rows(spark, d), ["variant", "record_id"]).withColumn("prob", F.round("prob", 9))
    return rows.withColumn("category", er.error_category(F.col("error"), F.col("y")))


@query("consensus_error", f"WITH {_CONS} SELECT variant, record_id, round(error, 6) AS error, prob, y, seeds FROM er")
def consensus_error(spark, d):
    return _errors(spark, d).select("variant", "record_id", *r6("error"), "prob", "y", "seeds")


@query("error_category", f"WITH {_CONS} SELECT variant, y, category, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY variant, y), 6) AS percent FROM ct GROUP BY variant, y, category")
def error_category(spark, d):
    rows = _errors(spark, d).groupBy("variant", "y", "category").agg(F.count("*").alias("n"))
    return rows.select("variant", "y", "category", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("variant", "y")), 6).alias("percent"))


_FACT = f"""{_CONS}, atr AS (SELECT record_id, min(alarm_type) AS alarm_type, min(lead_signature) AS lead_signature, round(avg(quality), 9) AS quality FROM fx_alarms GROUP BY record_id),
  ed AS (SELECT quantile_cont(quality, 1.0::DOUBLE / 3) AS a, quantile_cont(quality, 2.0::DOUBLE / 3) AS b FROM atr),
  fc AS (SELECT ct.*, alarm_type, lead_signature, CASE WHEN quality < a THEN 'low' WHEN quality < b THEN 'mid' ELSE 'high' END AS quality_level, CASE WHEN quality < 0.6 THEN 'yes' ELSE 'no' END AS degraded FROM ct JOIN atr USING (record_id) CROSS JOIN ed)"""


def _record_factors(spark, d, channels=()):
    """The factors of a record's own rows, made and stored once; channels: (quality, column) whose terciles come from the same pass."""
    means = [F.round(F.avg(column), 9).alias(name) for name, column in (("quality", "quality"), *channels)]
    at = stored(fx.alarms(spark, d).groupBy("record_id").agg(F.min("alarm_type").alias("alarm_type"), F.min("lead_signature").alias("lead_signature"), *means))
    at = er.tercile_levels(at, {name: f"{name}_level" for name in ("quality", *(name for name, _ in channels))})
    return at.withColumn("degraded", F.when(F.col("quality") < 0.6, "yes").otherwise("no"))


def _factors(spark, d):
    """Errors with the factors of a record's own rows."""
    return _errors(spark, d).join(_record_factors(spark, d), "record_id")


@query("terciles", f"WITH {_FACT} SELECT DISTINCT record_id, quality_level FROM fc WHERE variant = 'A'")
def terciles(spark, d):
    return _factors(spark, d).where("variant = 'A'").select("record_id", "quality_level")


APART, RATES, FASTEST = 0.5, [(1.0, "HR<1"), (1.5, "HR1-1.5"), (2.0, "HR1.5-2")], "HR>=2"  # beats an hour times 60
# a recording has many alarms: alarm r belongs to recording r % recordings, whose beats and windows give four factors
_MORE = f"""{_BT}, {_Z}, {_FACT.removeprefix('WITH ')}, rec AS (SELECT max(record_id) + 1 AS n FROM fx_beats),
  hr AS (SELECT record_id, kind, count(*) AS n, coalesce(60 / nullif(median(rr), 0), 0) AS hr FROM (SELECT record_id, kind, t - lag(t) OVER (PARTITION BY record_id, kind ORDER BY t) AS rr FROM (SELECT DISTINCT record_id, kind, t_h AS t FROM fx_beats WHERE kind IN ('ecg', 'pulse'))) GROUP BY ALL),
  cv AS (SELECT ec.record_id, count(ptt)::DOUBLE / count(*) AS coverage FROM ec LEFT JOIN pt ON pt.record_id = ec.record_id AND pt.t = ec.t GROUP BY ec.record_id),
  ac AS (SELECT record_id, max(c) AS peak FROM (SELECT a.record_id, a.window_id, b.i - a.i AS lag, sum(a.z * b.z) / 64 AS c FROM zz a JOIN zz b ON a.window_id = b.window_id AND b.i - a.i BETWEEN 4 AND 20 GROUP BY ALL) GROUP BY record_id),
  ids AS (SELECT record_id FROM hr UNION SELECT record_id FROM ac),
  sf AS (SELECT ids.record_id AS recording, CASE WHEN e.n IS NULL AND p.n IS NULL THEN NULL WHEN abs(coalesce(e.hr, 0) - coalesce(p.hr, 0)) < {APART}::DOUBLE THEN 'agree' ELSE 'disagree' END AS detector_disagree,
    CASE WHEN coverage < 0.5 THEN 'low' WHEN coverage IS NOT NULL THEN 'high' END AS pulse_coverage, CASE WHEN peak < 0.3::DOUBLE THEN 'weak' WHEN peak IS NOT NULL THEN 'clear' END AS pulse_acf,
    CASE WHEN e.n IS NULL AND p.n IS NULL THEN NULL WHEN coalesce(e.n, 0) < 3 THEN 'few beats' {' '.join(f"WHEN coalesce(e.hr, 0) < {end}::DOUBLE THEN '{name}'" for end, name in RATES)} ELSE '{FASTEST}' END AS hr_regime
    FROM ids LEFT JOIN hr e ON e.record_id = ids.record_id AND e.kind = 'ecg' LEFT JOIN hr p ON p.record_id = ids.record_id AND p.kind = 'pulse' LEFT JOIN cv ON cv.record_id = ids.record_id LEFT JOIN ac ON ac.record_id = ids.record_id),
  chn AS (SELECT record_id, round(avg(l_quantity), 9) AS ecg_quality, round(avg(l_extendedprice), 9) AS pulse_quality FROM fx_alarms GROUP BY record_id),
  che AS (SELECT quantile_cont(ecg_quality, 1.0::DOUBLE / 3) AS ea, quantile_cont(ecg_quality, 2.0::DOUBLE / 3) AS eb, quantile_cont(pulse_quality, 1.0::DOUBLE / 3) AS pa, quantile_cont(pulse_quality, 2.0::DOUBLE / 3) AS pb FROM chn),
  fa AS (SELECT fc.*, CASE WHEN ecg_quality < ea THEN 'low' WHEN ecg_quality < eb THEN 'mid' ELSE 'high' END AS ecg_quality_level, CASE WHEN pulse_quality < pa THEN 'low' WHEN pulse_quality < pb THEN 'mid' ELSE 'high' END AS pulse_quality_level,
    CASE WHEN lead_signature = 'P' THEN 'ABP' ELSE 'PPG' END AS pulse_source, CASE WHEN lead_signature = 'O' THEN 'no' ELSE 'yes' END AS abp_recorded, detector_disagree, pulse_coverage, pulse_acf, hr_regime
    FROM fc JOIN chn ON chn.record_id = fc.record_id CROSS JOIN che CROSS JOIN rec LEFT JOIN sf ON sf.recording = fc.record_id % rec.n)"""


def _all_factors(spark, d):
    """The factors of a record's own rows and those of its recording's signals; levels without signals are null."""
    beats, w = fx.beats(spark, d), fx.windows(spark, d)
    peaks = ft.lag_products(w, w, "window_id", list(range(4, 21))).groupBy("window_id").agg(F.max("c").alias("peak"))
    peaks = peaks.groupBy(F.floor(F.col("window_id") / 2).alias("record_id")).agg(F.max("peak").alias("peak"))
    found = sg.signal_factors(kind(spark, d, "ecg"), kind(spark, d, "pulse"), peaks, "record_id", LOW, HIGH, APART, rates=RATES, fastest=FASTEST).withColumnRenamed("record_id", "recording")
    recordings = beats.agg((F.max("record_id") + 1).alias("recordings"))  # one row
    rows = _record_factors(spark, d, (("ecg_quality", "l_quantity"), ("pulse_quality", "l_extendedprice"))).join(F.broadcast(recordings)).withColumn("recording", F.col("record_id") % F.col("recordings"))
    source = F.when(F.col("lead_signature") == "P", "ABP").otherwise("PPG").alias("pulse_source")
    # a record meets its recording before its variants' errors, so one row of it is moved
    rows = rows.join(found, "recording", "left").select("*", source, F.when(F.col("lead_signature") == "O", "no").otherwise("yes").alias("abp_recorded")).drop("recording", "recordings")
    return _errors(spark, d).join(rows, "record_id")


FACTORS = ["alarm_type", "lead_signature", "quality_level", "degraded", "ecg_quality_level", "pulse_quality_level", "detector_disagree", "pulse_coverage", "pulse_acf", "pulse_source", "abp_recorded", "hr_regime"]


@query("subgroup_factors", f"WITH {_MORE} SELECT variant, record_id, category, {', '.join(FACTORS)} FROM fa")
def subgroup_factors(spark, d):
    return _all_factors(spark, d).select("variant", "record_id", "category", *FACTORS)


_BRK = f"""{_MORE}, bk AS (SELECT variant, y, CASE {' '.join(f"WHEN grouping({f}) = 0 THEN '{f}'" for f in FACTORS)} END AS factor, coalesce({', '.join(FACTORS)}, 'none') AS level,
  count(*) AS n, count(*) FILTER (category LIKE 'persistent%') AS persistent, avg(error) AS mean_error FROM fa GROUP BY GROUPING SETS ({', '.join(f'(variant, y, {f})' for f in FACTORS)}))"""


@query("subgroup_breakdown", f"WITH {_BRK} SELECT variant, y, factor, level, n, persistent, round(persistent * 100.0::DOUBLE / n, 6) AS percent, round(mean_error, 6) AS mean_error FROM bk")
def subgroup_breakdown(spark, d):
    return er.subgroup_breakdown(_all_factors(spark, d), FACTORS, ["variant", "y"]).withColumn("percent", F.round("percent", 6)).withColumn("mean_error", F.round("mean_error", 6))


@query("subgroup_tests", f"""WITH {_BRK}, tt AS (SELECT variant, y, factor, sum(n) AS n, sum(persistent) AS p FROM bk GROUP BY ALL),
  tab AS (SELECT variant || '|' || y || '|' || bk.factor || '|' || level AS name, variant, y, bk.persistent::BIGINT AS a, (bk.n - bk.persistent)::BIGINT AS b, (tt.p - bk.persistent)::BIGINT AS c, (tt.n - bk.n - tt.p + bk.persistent)::BIGINT AS d FROM bk JOIN tt USING (variant, y, factor) WHERE bk.n >= 5 AND tt.n - bk.n >= 5), {_FISH},
  s AS (SELECT name, variant, y, round(p, 9) AS p FROM tab JOIN pv USING (name)), h AS (SELECT *, (count(*) OVER (PARTITION BY variant, y) - row_number() OVER (PARTITION BY variant, y ORDER BY p, name) + 1) * p AS x FROM s)
  SELECT name, round(p, 6) AS p, round(least(1.0, max(x) OVER (PARTITION BY variant, y ORDER BY p, name ROWS UNBOUNDED PRECEDING)), 6) AS holm FROM h""")
def subgroup_tests(spark, d):
    """Each level against the rest of its factor: Fisher's exact test, adjusted within variant and class."""
    bk = er.subgroup_breakdown(_all_factors(spark, d), FACTORS, ["variant", "y"])
    rest = W.partitionBy("variant", "y", "factor")
    tab = bk.withColumn("tn", F.sum("n").over(rest)).withColumn("tp", F.sum("persistent").over(rest)).where("n >= 5 and tn - n >= 5")
    tab = tab.select(F.concat_ws("|", "variant", F.col("y").cast("string"), "factor", "level").alias("name"), "variant", "y", F.col("persistent").alias("a"), (F.col("n") - F.col("persistent")).alias("b"), (F.col("tp") - F.col("persistent")).alias("c"), (F.col("tn") - F.col("n") - F.col("tp") + F.col("persistent")).alias("d"))
    p = st.fisher_exact(tab, ["name", "variant", "y"]).withColumn("p", F.round("p", 9))
    return st.holm(p, ["variant", "y"], "p", "name").select("name", *r6("p", "holm"))


_RULES = f"""{_FACT}, p9 AS (SELECT quantile_cont(quality, 0.9) AS q9 FROM atr), ta AS (SELECT fc.variant, fc.record_id, fc.category, list_filter([CASE WHEN degraded = 'yes' THEN 'degraded signal' END, CASE WHEN atr.quality >= q9 THEN 'clean signal' END, CASE WHEN prob BETWEEN 0.4 AND 0.6 THEN 'borderline score' END, CASE WHEN error > 0 AND error < 1 THEN 'seeds disagree' END], lambda x: x IS NOT NULL)[1:3] AS tags FROM fc JOIN atr USING (record_id) CROSS JOIN p9)"""
TAGS = ["degraded signal", "clean signal", "borderline score", "seeds disagree"]


def _annotated(spark, d):
    rows = _factors(spark, d)
    edge = exact_quantiles(rows.where("variant = 'A'"), ["quality"], [0.9]).select(F.col("q_quality")[0].alias("q9"))  # one row
    rules = [F.col("degraded") == "yes", F.col("quality") >= F.col("q9"), F.col("prob").between(0.4, 0.6), (F.col("error") > 0) & (F.col("error") < 1)]
    return er.rule_annotations(rows.join(F.broadcast(edge)), list(zip(TAGS, rules)))


@query("rule_annotations", f"WITH {_RULES} SELECT variant, record_id, array_to_string(tags, '; ') AS tags FROM ta")
def rule_annotations(spark, d):
    return _annotated(spark, d).select("variant", "record_id", "tags")


@query("tag_rates", f"WITH {_RULES}, tg AS (SELECT unnest(['degraded signal', 'clean signal', 'borderline score', 'seeds disagree']) AS tag) SELECT variant, category, tag, round(avg(list_contains(tags, tag)::INT), 6) AS rate FROM ta CROSS JOIN tg GROUP BY variant, category, tag")
def tag_rates(spark, d):
    return er.tag_rates(_annotated(spark, d), TAGS, ["variant", "category"]).withColumn("rate", F.round("rate", 6))


@query("overlap_jaccard", f"WITH {_CONS}, w AS (SELECT variant, record_id FROM ct WHERE category LIKE 'persistent%') SELECT x.variant AS a, y.variant AS b, count(*) FILTER (x.record_id = y.record_id) AS shared, round(count(*) FILTER (x.record_id = y.record_id)::DOUBLE / nullif(count(DISTINCT x.record_id) + count(DISTINCT y.record_id) - count(*) FILTER (x.record_id = y.record_id), 0), 6) AS jaccard FROM w x JOIN w y ON x.variant < y.variant GROUP BY ALL")
def overlap_jaccard(spark, d):
    """Overlap of the error sets of each pair of variants by counts: one self join on the record, set sizes aside."""
    w = _errors(spark, d).where(F.col("category").startswith("persistent")).select("variant", "record_id")
    sizes = w.groupBy("variant").agg(F.count("*").alias("n"))
    both = w.select(F.col("variant").alias("a"), "record_id").join(w.select(F.col("variant").alias("b"), "record_id"), "record_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = sizes.select(F.col("variant").alias("a"), F.col("n").alias("na")).join(sizes.select(F.col("variant").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b")).join(both, ["a", "b"], "left")
    shared = F.coalesce("shared", F.lit(0))
    return pairs.select("a", "b", shared.alias("shared"), F.round(shared / (F.col("na") + F.col("nb") - shared).cast("double"), 6).alias("jaccard"))


@query("shared_unique", f"WITH {_CONS}, p AS (SELECT record_id, bool_and(error >= 0.5) AS all_wrong, max((variant = 'A' AND error >= 0.5)::INT) AS a, max((variant = 'B' AND error >= 0.5)::INT) AS b, max((variant = 'C' AND error >= 0.5)::INT) AS c FROM er GROUP BY record_id) SELECT count(*) FILTER (all_wrong) AS all_wrong, count(*) FILTER (a = 1 AND b = 0 AND c = 0) AS only_a, count(*) FILTER (b = 1 AND a = 0 AND c = 0) AS only_b, count(*) FILTER (c = 1 AND a = 0 AND b = 0) AS only_c, count(*) FILTER (c = 1 AND (a = 0 OR b = 0)) AS c_wrong_other_right FROM p")
def shared_unique(spark, d):
    wrong = F.col("error") >= 0.5
    p = _errors(spark, d).groupBy("record_id").agg(F.bool_and(wrong).alias("all_wrong"), *(F.coalesce(F.bool_or(wrong & (F.col("variant") == v)), F.lit(False)).alias(v.lower()) for v in fx.VARIANTS))
    a, b, c = (F.col(x) for x in "abc")
    return p.agg(F.count_if("all_wrong").alias("all_wrong"), F.count_if(a & ~b & ~c).alias("only_a"), F.count_if(b & ~a & ~c).alias("only_b"), F.count_if(c & ~a & ~b).alias("only_c"), F.count_if(c & (~a | ~b)).alias("c_wrong_other_right"))


@query("diversified_cases", f"WITH {_CONS}, atr AS (SELECT record_id, min(alarm_type) AS alarm_type FROM fx_alarms GROUP BY record_id), k AS (SELECT variant, record_id, alarm_type, round(error, 6) AS error, row_number() OVER (PARTITION BY variant, alarm_type ORDER BY error DESC, record_id) AS rn FROM er JOIN atr USING (record_id)) SELECT variant, record_id, alarm_type, error FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY rn, error DESC, record_id) AS pick FROM k) WHERE pick <= 12")
def diversified_cases(spark, d):
    """Twelve cases with the highest error per variant, every alarm type once before any repeats."""
    at = fx.alarms(spark, d).groupBy("record_id").agg(F.min("alarm_type").alias("alarm_type"))
    rows = _errors(spark, d).join(at, "record_id").withColumn("rn", F.row_number().over(W.partitionBy("variant", "alarm_type").orderBy(F.col("error").desc(), "record_id"))).where("rn <= 12")
    pick = F.row_number().over(W.partitionBy("variant").orderBy("rn", F.round("error", 6).desc(), "record_id"))
    return rows.withColumn("pick", pick).where("pick <= 12").select("variant", "record_id", "alarm_type", *r6("error"))
