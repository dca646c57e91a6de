"""Plans of joins, sets, picks and perturbations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import perturb as pb
from ..operators import relational as rl
from . import fixtures as fx
from .evaluation import _F1, FOLD, _auc, _conf, oof, r6, test_rows
from .fixtures import query
from .statistics import _SUB, _subsets

_H = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
_FF = f"ff AS (SELECT variant, seed, fold, {_F1} AS f1 FROM ({_conf('fx_oof', 'variant, seed, fold')}))"


def _folds(spark, d):
    return m.confusion(test_rows(spark, d), FOLD).select(*FOLD, m.f1().alias("f1"))


@query("select_where", "SELECT record_id, seed, alarm_type FROM fx_alarms WHERE alarm_type = '2-HIGH' AND seed IN (1, 3)")
def select_where(spark, d):
    return rl.select_where(fx.alarms(spark, d), alarm_type="2-HIGH", seed=[1, 3]).select("record_id", "seed", "alarm_type")


@query("holdout_by_signature", "SELECT record_id, seed, CASE WHEN lead_signature = 'P' THEN 'test' ELSE 'train' END AS role FROM fx_alarms")
def holdout_by_signature(spark, d):
    return rl.holdout_by_signature(fx.alarms(spark, d), "lead_signature", "P").select("record_id", "seed", "role")


@query("pair_join", f"WITH {_FF} SELECT x.seed, x.fold, round(x.f1, 6) AS a, round(y.f1, 6) AS b, round(y.f1 - x.f1, 6) AS diff FROM ff x JOIN ff y USING (seed, fold) WHERE x.variant = 'A' AND y.variant = 'C'")
def pair_join(spark, d):
    return rl.pair_join(_folds(spark, d), "variant", "A", "C", ["seed", "fold"], "f1").select("seed", "fold", *r6("a", "b", "diff"))


@query("common_seeds", "WITH r AS (SELECT DISTINCT variant, seed FROM fx_oof WHERE NOT (variant = 'B' AND seed > 4)) SELECT seed FROM r GROUP BY seed HAVING count(DISTINCT variant) = 3")
def common_seeds(spark, d):
    return rl.common_keys(test_rows(spark, d).where("not (variant = 'B' and seed > 4)").select("variant", "seed").distinct(), "seed", "variant")


@query("split_mismatch_check", "SELECT seed, fold, record_id, 'b' AS only_in FROM fx_oof WHERE variant = 'B' AND record_id % 1000 = 0")
def split_mismatch_check(spark, d):
    rows = test_rows(spark, d)
    a = rows.where("variant = 'A' and record_id % 1000 <> 0").select("seed", "fold", "record_id")
    return rl.split_mismatch(a, rows.where("variant = 'B'").select("seed", "fold", "record_id"))


@query("upsert_results", f"WITH {_FF} SELECT variant, seed, fold, round(f1, 6) AS f1 FROM ff WHERE variant <> 'A' UNION ALL SELECT 'A', seed, fold, 1.0 FROM ff WHERE variant = 'A' AND seed <= 2 UNION ALL SELECT variant, seed, fold, round(f1, 6) FROM ff WHERE variant = 'A' AND seed > 2")
def upsert_results(spark, d):
    old = _folds(spark, d).select(*FOLD, *r6("f1"))
    return rl.upsert(old, old.where("variant = 'A' and seed <= 2").withColumn("f1", F.lit(1.0)), FOLD)


CONDITIONS = [("clean", False), ("dropout", True), ("noise", True), ("shift", False)]


@query("condition_cross", "SELECT e.vec_id AS window_id, kind, draw::INT AS draw FROM embeddings e CROSS JOIN (VALUES ('clean', false), ('dropout', true), ('noise', true), ('shift', false)) c(kind, st) CROSS JOIN (SELECT unnest(range(3)) AS draw) WHERE st OR draw = 0")
def condition_cross(spark, d):
    w = fx.read(spark, d, "embeddings").select(F.col("vec_id").alias("window_id"))
    return rl.condition_cross(w, spark.createDataFrame(CONDITIONS, "kind string, stochastic boolean"), 3).select("window_id", "kind", "draw")


_DON = "w AS (SELECT window_id, record_id, y, alarm_type, {h} AS h FROM fx_windows WHERE i = 0)".replace("{h}", _H.format("'swap:' || record_id"))


def _donor(pool: str, name: str) -> str:
    o = f"PARTITION BY {pool} ORDER BY h, record_id"
    numbered = f"SELECT {pool}, record_id, window_id, row_number() OVER (PARTITION BY {pool}, record_id ORDER BY window_id) - 1 AS k FROM w"
    records = f"SELECT {pool}, record_id, coalesce(lead(record_id) OVER o, first(record_id) OVER f) AS nr, coalesce(lead(n) OVER o, first(n) OVER f) AS nn FROM (SELECT {pool}, record_id, any_value(h) AS h, count(*) AS n FROM w GROUP BY {pool}, record_id) WINDOW o AS ({o}), f AS ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    same = " AND ".join(f"b.{c} = r.{c}" for c in pool.split(", "))
    return f"SELECT window_id, {name} FROM w LEFT JOIN (SELECT a.window_id, b.window_id AS {name} FROM ({numbered}) a JOIN ({records}) r USING ({pool}, record_id) JOIN ({numbered}) b ON {same} AND b.record_id = r.nr AND b.k = a.k % r.nn WHERE r.nr <> r.record_id) USING (window_id)"


@query("donor_swap", f"WITH {_DON}, a AS ({_donor('y, alarm_type', 'd1')}), b AS ({_donor('y', 'd2')}) SELECT window_id, coalesce(d1, d2) AS donor FROM a JOIN b USING (window_id)")
def donor_swap(spark, d):
    w = fx.windows(spark, d).where("i = 0").select("window_id", "record_id", "y", "alarm_type")
    return rl.donor_swap(w, "window_id", "record_id", "y", "alarm_type")


@query("union_runs", f"WITH {_FF} SELECT variant, seed, fold, round(f1, 6) AS f1, NULL AS note FROM ff WHERE variant = 'A' UNION ALL SELECT variant, seed, NULL, round(avg(f1), 6), 'mean' FROM ff WHERE variant = 'B' GROUP BY variant, seed")
def union_runs(spark, d):
    f = _folds(spark, d)
    means = f.where("variant = 'B'").groupBy("variant", "seed").agg(F.round(F.avg("f1"), 6).alias("f1")).withColumn("note", F.lit("mean"))
    return rl.union_runs(f.where("variant = 'A'").select(*FOLD, *r6("f1")), means)


@query("pivot_table", f"WITH {_FF} SELECT seed, round(avg(f1) FILTER (variant = 'A'), 6) AS a, round(avg(f1) FILTER (variant = 'B'), 6) AS b, round(avg(f1) FILTER (variant = 'C'), 6) AS c FROM ff GROUP BY seed")
def pivot_table(spark, d):
    return rl.pivot_means(_folds(spark, d), ["seed"], "variant", ["A", "B", "C"], "f1").select("seed", F.round("A", 6).alias("a"), F.round("B", 6).alias("b"), F.round("C", 6).alias("c"))


@query("unpivot_table", "SELECT record_id, seed, name, round(value, 6) AS value FROM (SELECT record_id, seed, quality, l_quantity AS quantity FROM fx_alarms) UNPIVOT (value FOR name IN (quality, quantity))")
def unpivot_table(spark, d):
    rows = fx.alarms(spark, d).select("record_id", "seed", "quality", F.col("l_quantity").alias("quantity"))
    return rows.unpivot(["record_id", "seed"], ["quality", "quantity"], "name", "value").withColumn("value", F.round("value", 6))


@query("top_k", "SELECT record_id, seed, round(l_extendedprice, 2) AS importance FROM fx_alarms ORDER BY l_extendedprice DESC, record_id, seed LIMIT 15")
def top_k(spark, d):
    return fx.alarms(spark, d).orderBy(F.col("l_extendedprice").desc(), "record_id", "seed").limit(15).select("record_id", "seed", F.round("l_extendedprice", 2).alias("importance"))


@query("best_per_group", f"WITH {_FF}, g AS (SELECT seed, variant, avg(f1) AS f1 FROM ff GROUP BY ALL) SELECT seed, variant, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(f1, 9) DESC, variant) AS rn FROM g) WHERE rn = 1")
def best_per_group(spark, d):
    g = _folds(spark, d).groupBy("seed", "variant").agg(F.avg("f1").alias("f1"))
    return rl.top_per_group(g, ["seed"], [F.round("f1", 9).desc(), F.col("variant")], 1).select("seed", "variant", *r6("f1"))


@query("round_robin_pick", "WITH o AS (SELECT record_id, seed, alarm_type, y FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY seed) AS rn FROM fx_alarms) WHERE rn = 1), t AS (SELECT *, row_number() OVER (PARTITION BY alarm_type, y ORDER BY record_id) AS turn FROM o) SELECT record_id, alarm_type, y, turn FROM t ORDER BY turn, alarm_type, y LIMIT 24")
def round_robin_pick(spark, d):
    return rl.round_robin_pick(fx.alarms(spark, d), ["alarm_type", "y"], "record_id", "seed", 24).select("record_id", "alarm_type", "y", F.col("turn").cast("long").alias("turn"))


# ---------------------------------------------------------------- perturbations


def _w(spark, d):
    return fx.windows(spark, d).select("window_id", "i", "x")


@query("perturb_shift", "SELECT window_id, ((i + 8) % 64)::INT AS i, round(x, 6) AS x FROM fx_windows")
def perturb_shift(spark, d):
    return pb.shift(_w(spark, d), "window_id", 64, 8).select("window_id", "i", *r6("x"))


@query("perturb_delay", "SELECT a.window_id, k::INT AS i, round(a.x, 6) AS x FROM (SELECT unnest(range(64)) AS k) JOIN fx_windows a ON a.i = greatest(0, k - 8)")
def perturb_delay(spark, d):
    return pb.delay(_w(spark, d), "window_id", 64, 8).select("window_id", "i", *r6("x"))


@query("perturb_reverse", "SELECT window_id, (63 - i)::INT AS i, round(x, 6) AS x FROM fx_windows")
def perturb_reverse(spark, d):
    return pb.reverse(_w(spark, d), "window_id", 64).select("window_id", "i", *r6("x"))


_DR = f"s AS (SELECT *, {_H.format(chr(39) + 'drop:' + chr(39) + ' || window_id')} % 49 AS s FROM fx_windows)"


@query("perturb_dropout", f"WITH {_DR} SELECT window_id, i, round(CASE WHEN i >= s AND i < s + 16 THEN 0.0 ELSE x END, 6) AS x FROM s")
def perturb_dropout(spark, d):
    return pb.dropout(_w(spark, d), "window_id", 64, 0.25).select("window_id", "i", *r6("x"))


@query("perturb_hold", f"WITH {_DR} SELECT window_id, i, round(CASE WHEN i >= s AND i < s + 16 THEN max(CASE WHEN i = greatest(0, s - 1) THEN x END) OVER (PARTITION BY window_id) ELSE x END, 6) AS x FROM s")
def perturb_hold(spark, d):
    return pb.dropout(_w(spark, d), "window_id", 64, 0.25, hold=True).select("window_id", "i", *r6("x"))


@query("perturb_blocks", f"SELECT window_id, i, round(CASE WHEN {_H.format(chr(39) + 'block:' + chr(39) + ' || window_id || ' + chr(39) + ':' + chr(39) + ' || (i // 8)')} < {int(0.3 * (1 << 32))} THEN 0.0 ELSE x END, 6) AS x FROM fx_windows")
def perturb_blocks(spark, d):
    return pb.block_dropout(_w(spark, d), "window_id", 8, 0.3).select("window_id", "i", *r6("x"))


@query("perturb_missing", "SELECT window_id, i, round(CASE WHEN alarm_type = 2 THEN 0.0 ELSE x END, 6) AS x FROM fx_windows")
def perturb_missing(spark, d):
    return pb.missing(fx.windows(spark, d), F.col("alarm_type") == 2).select("window_id", "i", *r6("x"))


_NB = "nb AS (SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value AS v FROM events)"


@query("perturb_noise_snr", f"""WITH {_NB}, b AS (SELECT channel, count(*) AS len, row_number() OVER (ORDER BY channel) - 1 AS c FROM nb GROUP BY channel HAVING count(*) >= 64),
  p AS (SELECT window_id, channel, {_H.format("'noise-at:' || window_id")} % (len - 63) AS off, CASE WHEN {_H.format("'noise-sign:' || window_id")} % 2 = 0 THEN 1.0 ELSE -1.0 END AS sg FROM (SELECT vec_id AS window_id, {_H.format("'noise:' || vec_id")} % (SELECT count(*) FROM b) AS c FROM embeddings) JOIN b USING (c)),
  j AS (SELECT w.window_id, w.i, w.x, nb.v * sg - avg(nb.v * sg) OVER (PARTITION BY w.window_id) AS v FROM fx_windows w JOIN p USING (window_id) JOIN nb ON nb.channel = p.channel AND nb.i = off + w.i),
  k AS (SELECT window_id, i, x + v * sqrt(var_pop(x) OVER z / (var_pop(v) OVER z * 10.0::DOUBLE ** 0.6::DOUBLE + 1e-12)) AS x FROM j WINDOW z AS (PARTITION BY window_id)) SELECT window_id, i, round((x - avg(x) OVER z) / (stddev_pop(x) OVER z + 1e-8), 5) AS x FROM k WINDOW z AS (PARTITION BY window_id)""")
def perturb_noise_snr(spark, d):
    from pyspark.sql import Window as W

    bank = fx.read(spark, d, "events").select(F.col("event_type").alias("channel"), (F.row_number().over(W.partitionBy("event_type").orderBy("event_id")) - 1).alias("i"), F.col("value").alias("v"))
    return pb.noise_snr(_w(spark, d), bank, "window_id", 64, 6.0).select("window_id", "i", F.round("x", 5).alias("x"))


@query("perturb_jitter", f"""WITH u AS (SELECT window_id, i, x, ({_H.format("'jitter:' || window_id || ':' || i")} / 4294967296.0::DOUBLE - 0.5::DOUBLE) * 2.0::DOUBLE AS u FROM fx_windows), s AS (SELECT *, sum(u) OVER (PARTITION BY window_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS walk FROM u),
  p AS (SELECT window_id, i, round(least(63.0, greatest(0.0, i + least(3.0, greatest(-3.0, walk)))), 9) AS pos FROM s) SELECT p.window_id, p.i, round(a.x + CASE WHEN pos > floor(pos) THEN (b.x - a.x) * (pos - floor(pos)) ELSE 0.0 END, 5) AS x FROM p JOIN fx_windows a ON a.window_id = p.window_id AND a.i = floor(pos)::INT LEFT JOIN fx_windows b ON b.window_id = p.window_id AND b.i = floor(pos)::INT + 1""")
def perturb_jitter(spark, d):
    return pb.jitter(_w(spark, d), "window_id", 64, 2.0, 3.0).select("window_id", "i", F.round("x", 5).alias("x"))


@query("phase_scramble")
def phase_scramble(spark, d):
    return pb.phase_scramble(_w(spark, d), "window_id")


def _unit(*keys: str) -> str:
    return f"((1 + {_H.format(" || ':' || ".join(keys))}) / 4294967296.0::DOUBLE)"


def _gauss(tag: str, *keys: str) -> str:
    return f"sqrt(-2.0::DOUBLE * ln({_unit(f"'{tag}-radius'", *keys)})) * cos(2.0::DOUBLE * pi() * {_unit(f"'{tag}-angle'", *keys)})"


@query("augment_windows", f"""WITH c AS (SELECT window_id, i, x, k::INT AS copy, {_H.format("'aug-from:' || window_id || ':' || k")} % 57 AS lost FROM fx_windows CROSS JOIN (SELECT unnest(range(3)) AS k))
  SELECT window_id, copy, (CASE WHEN copy = 0 THEN i ELSE (i + {_H.format("'aug:' || window_id || ':' || copy")} % 64) % 64 END)::INT AS i,
    round(CASE WHEN copy = 0 THEN x WHEN {_unit("'aug-drop'", "window_id", "copy")} <= 0.3 AND i >= lost AND i < lost + 8 THEN 0.0
      ELSE x * exp({_gauss("aug-amp", "window_id", "copy")} * 0.15::DOUBLE) + {_gauss("aug-noise", "window_id", "copy", "i")} * {_unit("'aug-level'", "window_id", "copy")} * 0.1::DOUBLE END, 5) AS x FROM c""")
def augment_windows(spark, d):
    return pb.augment(_w(spark, d), "window_id", 64, 2).select("window_id", "copy", "i", F.round("x", 5).alias("x"))


# a window trains in the two folds that do not test its record; parts of 1,000 windows, each meets the next of its part
_TRIES = f"list_filter(list_transform(range(16), lambda k: [power({_unit("'mix-a'", 'fold', 'window_id', 'k')}, 2.5), power({_unit("'mix-b'", 'fold', 'window_id', 'k')}, 2.5)]), lambda t: t[1] + t[2] <= 1 AND t[1] + t[2] > 0)[1]"


@query("augment_mixup", f"""WITH g AS (SELECT DISTINCT window_id, y, fold FROM fx_windows CROSS JOIN (SELECT unnest(range(3))::INT AS fold) WHERE record_id % 3 <> fold),
  n AS (SELECT fold, ceil(count(*) / 1000.0::DOUBLE) AS parts FROM g GROUP BY fold), dr AS (SELECT g.*, parts, {_H.format("'mix:' || fold || ':' || window_id")} AS dr FROM g JOIN n USING (fold)),
  o AS (SELECT *, floor(dr * parts / 4294967296.0::DOUBLE) AS part FROM dr),
  m AS (SELECT fold, window_id, y, coalesce(lead(window_id) OVER w, first_value(window_id) OVER w) AS partner, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM o WINDOW w AS (PARTITION BY fold, part ORDER BY dr, window_id)),
  t AS (SELECT *, {_TRIES} AS t FROM m), s AS (SELECT *, coalesce(t[1] / (t[1] + t[2]), 0.5::DOUBLE) AS share FROM t)
  SELECT s.fold, s.window_id, s.partner, round(share, 6) AS share, round(share * s.y + (1 - share) * y2, 6) AS y, a.i, round(share * a.x + (1 - share) * b.x, 5) AS x
  FROM s JOIN fx_windows a ON a.window_id = s.window_id JOIN fx_windows b ON b.window_id = s.partner AND b.i = a.i""")
def augment_mixup(spark, d):
    """Mix-up pairs of the training windows of three folds over records."""
    rows = fx.windows(spark, d).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("record_id % 3 <> fold")
    return pb.mixup(rows, "window_id", "fold", "y").select("fold", "window_id", "partner", *r6("share", "y"), "i", F.round("x", 5).alias("x"))


# stress results: the variants are models, the seeds conditions (1 is clean)
_ST = f"st AS (SELECT variant AS model, CASE seed WHEN 1 THEN 'clean' ELSE 'c' || seed END AS kind, fold, auc FROM ({_auc('fx_oof', 'variant, seed, fold')}))"


def _stress(spark, d):
    return m.auc(test_rows(spark, d), FOLD).select(F.col("variant").alias("model"), F.when(F.col("seed") == 1, "clean").otherwise(F.concat(F.lit("c"), "seed")).alias("kind"), "fold", "auc")


@query("stress_summary", f"WITH {_ST}, f AS (SELECT model, kind, fold, avg(auc) AS v FROM st GROUP BY ALL) SELECT model, kind, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS folds FROM f GROUP BY ALL")
def stress_summary(spark, d):
    return pb.stress_summary(_stress(spark, d), ["model", "kind"], "auc").select("model", "kind", *r6("mean", "std"), "folds")


@query("degradation_table", f"WITH {_ST}, f AS (SELECT model, kind, avg(auc) AS mean FROM st GROUP BY ALL) SELECT model, round(max(mean) FILTER (kind = 'clean'), 6) AS clean, round(avg(mean) FILTER (kind <> 'clean'), 6) AS stressed, round(min(mean) FILTER (kind <> 'clean'), 6) AS worst, round(max(mean) FILTER (kind = 'clean') - avg(mean) FILTER (kind <> 'clean'), 6) AS mean_drop FROM f GROUP BY model")
def degradation_table(spark, d):
    s = pb.stress_summary(_stress(spark, d), ["model", "kind"], "auc")
    return pb.degradation(s, "model", "kind", "mean").select("model", *r6("clean", "stressed", "worst", "mean_drop"))


@query("alignment_indices", f"WITH {_ST}, p AS (SELECT model, kind, avg(auc) AS v FROM st GROUP BY ALL), t AS (SELECT model, max(v) FILTER (kind = 'clean') AS i, max(v) FILTER (kind = 'c2') AS sw, max(v) FILTER (kind = 'c3') AS sc, max(v) FILTER (kind = 'c4') AS n, least(max(v) FILTER (kind = 'c5'), max(v) FILTER (kind = 'c6'), max(v) FILTER (kind = 'c7')) AS sh FROM p GROUP BY model) SELECT model, round(i - sw, 6) AS swap_cost, round(i - sc, 6) AS scramble_cost, round(i - sh, 6) AS shift_cost, round(i - n, 6) AS noise_cost FROM t")
def alignment_indices(spark, d):
    names = {"clean": "identity", "c2": "swap", "c3": "scramble", "c4": "noise", "c5": "shift_1", "c6": "shift_2", "c7": "shift_3"}
    t = _stress(spark, d).groupBy("model").pivot("kind", list(names)).agg(F.avg("auc")).withColumnsRenamed(names)
    return pb.alignment_indices(t).select("model", *r6("swap_cost", "scramble_cost", "shift_cost", "noise_cost"))


@query("replay_growing", "SELECT window_id, k::INT AS k, count(*) AS n, round(avg(x), 6) AS mean, round(max(x) - min(x), 6) AS span FROM fx_windows CROSS JOIN (SELECT unnest(range(2, 11)) AS k) WHERE i >= 64 - 6 * k GROUP BY window_id, k")
def replay_growing(spark, d):
    """The last k tenths of every window, k from 2 to 10, as when it fills up."""
    rows = _w(spark, d).where("i >= 4").withColumn("k", F.explode(F.sequence(F.greatest(F.lit(2), F.ceil((F.lit(64) - F.col("i")) / 6).cast("int")), F.lit(10)))).where(F.col("i") >= 64 - 6 * F.col("k"))
    return rows.groupBy("window_id", "k").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.max("x") - F.min("x"), 6).alias("span"))
