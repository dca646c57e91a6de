"""Plans of statistics over the prediction views."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import stats as st
from . import fixtures as fx
from .evaluation import _F1, _SENS, _SPEC, FOLD, _auc, _conf, oof, r6, test_rows
from .fixtures import query

_H = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
_DIFFS = f"f AS (SELECT variant, seed, fold, {_F1} AS f1 FROM ({_conf('fx_oof', 'variant, seed, fold')})), p AS (SELECT b.variant, b.f1 - a.f1 AS d FROM f b JOIN f a USING (seed, fold) WHERE a.variant = 'A' AND b.variant <> 'A')"


def _diffs(spark, d):
    f = m.confusion(test_rows(spark, d), FOLD).select(*FOLD, m.f1().alias("f1"))
    return f.where("variant <> 'A'").join(f.where("variant = 'A'").select("seed", "fold", F.col("f1").alias("base")), ["seed", "fold"]).select("variant", (F.col("f1") - F.col("base")).alias("d"))


@query("nb_ttest", f"WITH {_DIFFS} SELECT variant, count(d) AS j, round(avg(d), 6) AS mean, CASE WHEN var_samp(d) > 1e-18 THEN round(avg(d) / sqrt((1.0::DOUBLE / count(d) + 0.25::DOUBLE) * var_samp(d)), 5) END AS t FROM p GROUP BY variant")
def nb_ttest(spark, d):
    return st.corrected_t(_diffs(spark, d), ["variant"], "d", 0.25).select("variant", "j", *r6("mean"), F.round("t", 5).alias("t"))


DRAWS = 2000
# one weight of a record in a replicate; four of them come from one MD5
_W = f"(SELECT record_id, b, {' + '.join(f'(u >= {c}::DOUBLE)::INT' for c in st.POISSON)} AS weight FROM (SELECT record_id, b, CAST('0x' || substr(md5('boot:' || (b // 4) || ':' || record_id), 1 + 8 * (b % 4), 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT record_id FROM fx_oof) CROSS JOIN (SELECT unnest(range({DRAWS})) AS b)))"
_SUMS = ", ".join(f"sum({c} * weight)::BIGINT AS {c}" for c in st.COUNTS)


@query("record_bootstrap", f"""WITH t AS ({_conf("(SELECT * FROM fx_oof WHERE variant IN ('A', 'B'))", 'variant, seed, record_id')}), w AS (SELECT * FROM {_W} WHERE weight > 0), s AS (SELECT b, variant, seed, {_SUMS} FROM t JOIN w USING (record_id) GROUP BY ALL),
  v AS (SELECT b, variant, avg({_F1}) AS m FROM s GROUP BY ALL), x AS (SELECT b, max(m) FILTER (variant = 'B') - max(m) FILTER (variant = 'A') AS diff FROM v GROUP BY b)
  SELECT round(avg(diff), 6) AS mean, round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high, least(1.0, 2 * least(avg((diff <= 0)::INT), avg((diff >= 0)::INT)))::DOUBLE AS p FROM x""")
def record_bootstrap(spark, d):
    """2,000 replicates: the difference of F1 on the same drawn records, per seed, then averaged over seeds."""
    tallies = m.confusion(test_rows(spark, d).where("variant in ('A', 'B')"), ["variant", "seed", "record_id"])
    sums = st.replicate_sums(tallies, "record_id", ["variant", "seed"], DRAWS)
    reps = st.paired_differences(sums, "variant", [("A", "B")], [], {"f1": m.f1()})
    return st.interval(reps, [], "diff").select(*r6("mean", "low", "high"), "p")


@query("cluster_bootstrap", f"""WITH t AS ({_conf("(SELECT * FROM fx_oof WHERE variant = 'A')", 'record_id')}), w AS (SELECT * FROM {_W} WHERE weight > 0), s AS (SELECT b, {_SUMS} FROM t JOIN w USING (record_id) GROUP BY b),
  v AS (SELECT 'sensitivity' AS metric, {_SENS} AS v FROM s UNION ALL SELECT 'specificity', {_SPEC} FROM s) SELECT metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM v GROUP BY metric""")
def cluster_bootstrap(spark, d):
    """Records are drawn and bring all their windows; both measures are shares within one class. 2,000 replicates."""
    tallies = m.confusion(test_rows(spark, d).where("variant = 'A'"), ["record_id"]).withColumn("all", F.lit(0))
    sums = st.replicate_sums(tallies, "record_id", ["all"], DRAWS)
    long = sums.select(m.sensitivity().alias("sensitivity"), m.specificity().alias("specificity")).unpivot([], ["sensitivity", "specificity"], "metric", "v")
    return st.interval(long, ["metric"], "v").select("metric", *r6("mean", "low", "high"))


WINDOW_DRAWS = 300
_U = "CAST('0x' || substr(md5('{0}:' || (b // 4) || ':' || {1}), 1 + 8 * (b % 4), 8) AS BIGINT)"


@query("window_bootstrap_auc", f"""WITH u AS (SELECT variant, seed, prob, y, b, {_U.format('boot', "variant || ':' || seed || ':' || record_id")} / 4294967296.0::DOUBLE AS u FROM fx_oof CROSS JOIN (SELECT unnest(range({WINDOW_DRAWS})) AS b)),
  g AS (SELECT b, variant, seed, prob, sum(weight * y) AS pos, sum(weight * (1 - y)) AS neg FROM (SELECT *, {' + '.join(f'(u >= {c}::DOUBLE)::INT' for c in st.POISSON)} AS weight FROM u) GROUP BY ALL),
  c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY b, variant, seed ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM g),
  a AS (SELECT b, variant, seed, sum(pos * (under + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE AS auc FROM c GROUP BY b, variant, seed HAVING sum(pos) > 0 AND sum(neg) > 0)
  SELECT variant, seed, round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM a GROUP BY variant, seed""")
def window_bootstrap_auc(spark, d):
    """Windows of every variant and seed are drawn anew, 300 replicates; a seed has one window per record."""
    by = ["variant", "seed"]
    reps = st.auc_replicates(test_rows(spark, d).select(*by, "record_id", "prob", "y"), "record_id", by, "prob", "y", WINDOW_DRAWS)
    return st.interval(reps.where("auc is not null"), by, "auc").select(*by, *r6("mean", "low", "high"))


@query("permutation_test", f"""WITH x AS (SELECT record_id, avg(quality) AS quality, round(avg(prob), 9) AS prob FROM fx_oof WHERE variant = 'A' GROUP BY record_id),
  t AS (SELECT corr(quality, prob) AS rho, count(*) AS n, avg(quality) AS mq, avg(prob) AS mp, stddev_pop(quality) AS sq, stddev_pop(prob) AS sp FROM x),
  k AS (SELECT record_id, quality - mq AS a, prob - mp AS b_, {_H.format("'perm:block:' || record_id")} % ceil(n / {st.BLOCK_ROWS}.0)::BIGINT AS block FROM x CROSS JOIN t), l AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY record_id) AS place FROM k),
  s AS (SELECT b, block, b_, row_number() OVER (PARTITION BY b, block ORDER BY {_U.format('perm', 'record_id')}, record_id) AS place FROM k CROSS JOIN (SELECT unnest(range({DRAWS})) AS b)),
  c AS (SELECT s.b, sum(l.a * s.b_) AS s FROM l JOIN s USING (block, place) GROUP BY s.b) SELECT round(rho, 6) AS rho, avg((abs(s / (n * sq * sp)) >= abs(rho) - 1e-12)::INT) AS p FROM c CROSS JOIN t GROUP BY rho""")
def permutation_test(spark, d):
    """2,000 permutations of the records' mean scores against their quality."""
    rows = oof(spark, d).where("variant = 'A'").groupBy("record_id").agg(F.avg("quality").alias("quality"), F.round(F.avg("prob"), 9).alias("prob"))
    return st.permutation_test(rows, "quality", "prob", "record_id", DRAWS).select(*r6("rho"), "p")


@query("holm", f"""WITH {_DIFFS}, q AS (SELECT variant || '-' || seed || '-' || fold AS name, least(1.0::DOUBLE, round(abs(d) * 20, 9)) AS p FROM (SELECT b.variant, seed, fold, b.f1 - a.f1 AS d FROM f b JOIN f a USING (seed, fold) WHERE a.variant = 'A' AND b.variant <> 'A')),
  s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p AS x FROM q) SELECT name, p, round(least(1.0, max(x) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING)), 6) AS holm FROM s""")
def holm(spark, d):
    f = m.confusion(test_rows(spark, d), FOLD).select(*FOLD, m.f1().alias("f1"))
    p = f.where("variant <> 'A'").join(f.where("variant = 'A'").select("seed", "fold", F.col("f1").alias("base")), ["seed", "fold"])
    p = p.select(F.concat_ws("-", "variant", "seed", "fold").alias("name"), F.least(F.lit(1.0), F.round(F.abs(F.col("f1") - F.col("base")) * 20, 9)).alias("p"))
    return st.holm(p, [], "p", "name").withColumn("holm", F.round("holm", 6))


_FISH = """lf AS (SELECT i, sum(ln(greatest(i, 1)::DOUBLE)) OVER (ORDER BY i) AS l FROM (SELECT unnest(range(0, (SELECT max(a + b + c + d) FROM tab)::BIGINT + 1)) AS i)),
  c AS (SELECT name, a, a + b AS r, a + c AS k, a + b + c + d AS n, unnest(generate_series(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c))) AS x FROM tab),
  e AS (SELECT c.*, f1.l + f2.l + f3.l + f4.l - f5.l - f6.l - f7.l - f8.l - f9.l AS lp FROM c JOIN lf f1 ON f1.i = r JOIN lf f2 ON f2.i = n - r JOIN lf f3 ON f3.i = k JOIN lf f4 ON f4.i = n - k JOIN lf f5 ON f5.i = n JOIN lf f6 ON f6.i = x JOIN lf f7 ON f7.i = r - x JOIN lf f8 ON f8.i = k - x JOIN lf f9 ON f9.i = n - r - k + x),
  o AS (SELECT *, max(lp) FILTER (x = a) OVER (PARTITION BY name) AS own FROM e), pv AS (SELECT name, least(1.0, sum(exp(lp)) FILTER (lp <= own + 1e-7)) AS p FROM o GROUP BY name)"""


@query("fisher_exact", f"""WITH tab AS (SELECT variant || '-' || seed || '-' || fold || '-' || alarm_type AS name, fn AS a, tp AS b, fp AS c, tn AS d FROM ({_conf('fx_oof', 'variant, seed, fold, alarm_type')})), {_FISH}
  SELECT tab.name, CASE WHEN b * c > 0 THEN round(a * d / (b * c)::DOUBLE, 6) END AS odds_ratio, round(p, 6) AS p FROM tab JOIN pv USING (name)""")
def fisher_exact(spark, d):
    tab = m.confusion(oof(spark, d), [*FOLD, "alarm_type"])
    tab = tab.select(F.concat_ws("-", *FOLD, "alarm_type").alias("name"), F.col("fn").alias("a"), F.col("tp").alias("b"), F.col("fp").alias("c"), F.col("tn").alias("d"))
    return st.fisher_exact(tab, ["name"]).select("name", *r6("odds_ratio", "p"))


# subset predictions: a mask keeps the variants of its bits, the record's score is their mean
_SUB = """mk AS (SELECT unnest(range(1, 8)) AS mask), b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4)) t(variant, bit)),
  sp AS (SELECT mask, record_id, seed, round(avg(prob), 9) AS prob, max(y) AS y FROM fx_oof JOIN b USING (variant) JOIN mk ON (mask & bit) > 0 GROUP BY ALL)"""


def _subsets(spark, d):
    """One row per record and seed holds each variant's sum; the seven means are made from it, so rows are not multiplied before they meet."""
    own = lambda v, c: F.when(F.col("variant") == v, F.col(c))
    each = [(F.sum(own(v, "prob")).alias(f"s{v}"), F.count(own(v, "prob")).alias(f"n{v}"), F.max(own(v, "y")).alias(f"y{v}")) for v in fx.VARIANTS]
    rows = test_rows(spark, d).groupBy("record_id", "seed").agg(*(c for cols in each for c in cols))
    made = []
    for mask in range(1, 8):
        kept = [v for k, v in enumerate(fx.VARIANTS) if mask >> k & 1]
        total = lambda c, kept=kept: reduce(add, (F.coalesce(f"{c}{v}", F.lit(0)) for v in kept))
        y = F.greatest(*(F.col(f"y{v}") for v in kept)) if len(kept) > 1 else F.col(f"y{kept[0]}")
        made.append(F.struct(F.lit(mask).alias("mask"), F.round(F.when(total("n") > 0, total("s") / total("n")), 9).alias("prob"), y.alias("y")))
    return rows.select("record_id", "seed", F.inline(F.array(*made))).where("y is not null")


@query("subset_metrics", f"WITH {_SUB}, c AS ({_conf('sp', 'mask')}), a AS ({_auc('sp', 'mask')}) SELECT mask::INT AS mask, bit_count(mask)::INT AS n_parts, round(auc, 6) AS auc, round({_F1}, 6) AS f1 FROM c JOIN a USING (mask)")
def subset_metrics(spark, d):
    out = m.binary_metrics(_subsets(spark, d), ["mask"])
    return out.select("mask", F.bit_count("mask").alias("n_parts"), *r6("auc", "f1")).orderBy("n_parts", F.col("auc").desc())


@query("subset_lattice", "SELECT mask::INT AS mask, bit_count(mask)::INT AS n_parts, count(*) AS windows FROM (SELECT unnest(range(1, 16)) AS mask) JOIN (SELECT DISTINCT window_id, 1 + (alarm_type >= 1)::INT * 2 + (alarm_type >= 2)::INT * 4 + (alarm_type >= 3)::INT * 8 AS has FROM fx_windows) ON (mask & has) = mask GROUP BY mask")
def subset_lattice(spark, d):
    """Windows that hold every part of each non-empty subset of four channels."""
    a = F.col("alarm_type")
    has = F.lit(1) + F.when(a >= 1, 2).otherwise(0) + F.when(a >= 2, 4).otherwise(0) + F.when(a >= 3, 8).otherwise(0)
    rows = fx.windows(spark, d).where("i = 0").select("window_id", has.alias("has")).groupBy("has").agg(F.count("*").alias("n"))
    rows = rows.withColumn("mask", F.explode(F.sequence(F.lit(1), F.lit(15)))).where("(mask & has) = mask")
    return rows.groupBy("mask").agg(F.sum("n").alias("windows")).select("mask", F.bit_count("mask").alias("n_parts"), "windows")


@query("shapley", f"WITH {_SUB}, a AS ({_auc('sp', 'mask')}), v AS (SELECT mask, auc AS v FROM a UNION ALL SELECT 0, 0.5), pl AS (SELECT unnest(range(3)) AS player) SELECT player::INT AS player, round(sum((CASE bit_count(s.mask) WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 ELSE 2.0 END) / 6.0 * (t.v - s.v)), 6) AS shapley FROM pl JOIN v s ON (s.mask & (1 << player)) = 0 JOIN v t ON t.mask = s.mask + (1 << player) GROUP BY player")
def shapley(spark, d):
    return st.shapley(m.auc(_subsets(spark, d), ["mask"]), 3, "mask", "auc").select("player", *r6("shapley"))


@query("dropout_robustness", f"WITH {_SUB}, a AS ({_auc('sp', 'mask')}) SELECT bit_count(mask)::INT AS n_parts, round(avg(auc), 6) AS mean, round(min(auc), 6) AS low, round(max(auc), 6) AS high FROM a GROUP BY bit_count(mask)")
def dropout_robustness(spark, d):
    rows = m.auc(_subsets(spark, d), ["mask"]).withColumn("n_parts", F.bit_count("mask"))
    return rows.groupBy("n_parts").agg(F.round(F.avg("auc"), 6).alias("mean"), F.round(F.min("auc"), 6).alias("low"), F.round(F.max("auc"), 6).alias("high"))
