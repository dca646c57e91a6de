"""Plans of beat detection and beat joins. Bounds are hours: a pulse follows its beat by 1 to 12."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import beats as bt
from . import fixtures as fx
from .evaluation import r6
from .fixtures import query

LOW, HIGH, TOL = 1.0, 12.0, 6.0
_EN = "en AS (SELECT window_id, i, x, sum(d * d) OVER (PARTITION BY window_id ORDER BY i ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) / 30.0::DOUBLE AS energy FROM (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY window_id ORDER BY i), 0.0) AS d FROM fx_windows))"
_PK = "pk AS (SELECT window_id, i, x FROM (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS n FROM fx_windows WINDOW w AS (PARTITION BY window_id ORDER BY i)) WHERE x > p AND x > n)"
_BT = "ec AS (SELECT DISTINCT record_id, t_h AS t FROM fx_beats WHERE kind = 'ecg'), pu AS (SELECT DISTINCT record_id, t_h AS t FROM fx_beats WHERE kind = 'pulse'), e2 AS (SELECT DISTINCT record_id, t_h AS t FROM fx_beats WHERE kind = 'ecg2'), pt AS (SELECT ec.record_id, ec.t, min(pu.t - ec.t) AS ptt FROM ec JOIN pu ON pu.record_id = ec.record_id AND pu.t - ec.t BETWEEN 1 AND 12 GROUP BY ALL)"
_MT = f"{_BT}, nr AS (SELECT a.record_id, a.t, b.t AS t2, row_number() OVER (PARTITION BY a.record_id, a.t ORDER BY round(abs(b.t - a.t), 9), b.t) AS ra, row_number() OVER (PARTITION BY a.record_id, b.t ORDER BY round(abs(b.t - a.t), 9), a.t) AS rb FROM ec a JOIN e2 b ON a.record_id = b.record_id AND abs(b.t - a.t) <= 6), mt AS (SELECT record_id, t, t2 FROM nr WHERE ra = 1 AND rb = 1)"


def kind(spark, d, name):
    return fx.beats(spark, d).where(F.col("kind") == name).select("record_id", F.col("t_h").alias("t")).distinct()


def _peaks(spark, d):
    return bt.local_maxima(fx.windows(spark, d), ["window_id"])


@query("r_peak_energy", f"WITH {_EN} SELECT window_id, i, round(energy, 6) AS energy FROM en")
def r_peak_energy(spark, d):
    return bt.energy(fx.windows(spark, d), ["window_id"]).select("window_id", "i", *r6("energy"))


@query("adaptive_threshold", f"WITH {_EN} SELECT window_id, round(0.3::DOUBLE * quantile_cont(energy, 0.99), 6) AS threshold FROM en GROUP BY window_id HAVING max(energy) > 0")
def adaptive_threshold(spark, d):
    return bt.adaptive_threshold(bt.energy(fx.windows(spark, d), ["window_id"]), ["window_id"]).select("window_id", *r6("threshold"))


@query("local_maxima", f"WITH {_PK} SELECT window_id, i::BIGINT AS i, round(x, 6) AS x FROM pk")
def local_maxima(spark, d):
    return _peaks(spark, d).select("window_id", "i", *r6("x"))


@query("refractory_suppress", f"WITH {_PK}, m AS (SELECT *, max(x) OVER (PARTITION BY window_id ORDER BY i RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS top FROM pk) SELECT window_id, i::BIGINT AS i, round(x, 6) AS x FROM m WHERE x >= top")
def refractory_suppress(spark, d):
    return bt.suppress_by_frame(_peaks(spark, d), ["window_id"], 6).select("window_id", "i", *r6("x"))


@query("refractory_suppress_exact", f"""WITH RECURSIVE {_PK}, s AS (SELECT window_id, list({{'i': i, 'x': x}} ORDER BY x DESC, i DESC) AS ahead, (list({{'i': i, 'x': x}}))[1:0] AS kept FROM pk GROUP BY window_id UNION ALL
  SELECT window_id, list_filter(ahead, lambda p: abs(p.i - ahead[1].i) >= 6), list_append(kept, ahead[1]) FROM s WHERE len(ahead) > 0), f AS (SELECT window_id, unnest(kept) AS p FROM s WHERE len(ahead) = 0) SELECT window_id, p.i::BIGINT AS i, round(p.x, 6) AS x FROM f""")
def refractory_suppress_exact(spark, d):
    return bt.suppress_exact(_peaks(spark, d), ["window_id"], 6).select("window_id", "i", *r6("x"))


@query("pulse_peaks")
def pulse_peaks(spark, d):
    return bt.peaks_by_prominence(fx.windows(spark, d), ["window_id"], 6)


@query("peak_refine", f"WITH {_PK}, n AS (SELECT pk.window_id, pk.i AS c, max_by(w.i, (abs(w.x), -w.i)) AS i FROM pk JOIN fx_windows w ON w.window_id = pk.window_id AND abs(w.i - pk.i) <= 3 GROUP BY ALL) SELECT DISTINCT window_id, i FROM n")
def peak_refine(spark, d):
    return bt.refine(_peaks(spark, d), fx.windows(spark, d), ["window_id"], 3)


@query("pulse_feet", f"WITH {_PK}, s AS (SELECT window_id, i AS peak, coalesce(lag(i) OVER (PARTITION BY window_id ORDER BY i), 0) AS a FROM pk) SELECT s.window_id, peak::BIGINT AS peak, min_by(w.i, (w.x, w.i)) AS foot FROM s JOIN fx_windows w ON w.window_id = s.window_id AND w.i BETWEEN a AND peak GROUP BY s.window_id, peak")
def pulse_feet(spark, d):
    return bt.feet(_peaks(spark, d), fx.windows(spark, d), ["window_id"])


@query("ptt_interval_join", f"WITH {_BT} SELECT record_id, round(t, 6) AS t, round(ptt, 6) AS ptt FROM pt")
def ptt_interval_join(spark, d):
    return bt.first_after(kind(spark, d, "ecg"), kind(spark, d, "pulse"), "record_id", LOW, HIGH).select("record_id", *r6("t", "ptt"))


@query("ptt_per_beat", f"WITH {_BT} SELECT ec.record_id, count(*) AS beats, count(ptt) AS followed, round(count(ptt)::DOUBLE / count(*), 6) AS pulse_coverage, round(avg(ptt), 6) AS mean_ptt FROM ec LEFT JOIN pt ON pt.record_id = ec.record_id AND pt.t = ec.t GROUP BY ec.record_id")
def ptt_per_beat(spark, d):
    rows = bt.per_beat(kind(spark, d, "ecg"), kind(spark, d, "pulse"), "record_id", LOW, HIGH)
    return rows.groupBy("record_id").agg(F.count("*").alias("beats"), F.count("ptt").alias("followed"), F.round(F.count("ptt") / F.count("*"), 6).alias("pulse_coverage"), F.round(F.avg("ptt"), 6).alias("mean_ptt"))


@query("pulse_has_r", f"WITH {_BT} SELECT record_id, round(avg((EXISTS (SELECT 1 FROM ec WHERE ec.record_id = pu.record_id AND pu.t - ec.t > 1 AND pu.t - ec.t < 12))::INT), 6) AS share FROM pu GROUP BY record_id")
def pulse_has_r(spark, d):
    pulses = kind(spark, d, "pulse")
    led = bt.interval_join(kind(spark, d, "ecg"), pulses, "record_id", LOW, HIGH, closed=False).select("record_id", F.col("t2").alias("t")).distinct().withColumn("led", F.lit(1))
    return pulses.join(led, ["record_id", "t"], "left").groupBy("record_id").agg(F.round(F.avg(F.coalesce("led", F.lit(0))), 6).alias("share"))


@query("beats_without_pulse", f"WITH {_BT}, r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY t DESC) AS rn FROM ec) SELECT r.record_id, round(r.t, 6) AS t, rn <= 6 AS last_six FROM r LEFT JOIN pt ON pt.record_id = r.record_id AND pt.t = r.t WHERE pt.t IS NULL")
def beats_without_pulse(spark, d):
    beats = kind(spark, d, "ecg").withColumn("rn", F.row_number().over(W.partitionBy("record_id").orderBy(F.col("t").desc())))
    followed = bt.first_after(beats, kind(spark, d, "pulse"), "record_id", LOW, HIGH)
    return beats.join(followed, ["record_id", "t"], "left_anti").select("record_id", *r6("t"), (F.col("rn") <= 6).alias("last_six"))


@query("match_beats", f"WITH {_MT} SELECT record_id, round(t, 6) AS t, round(t2, 6) AS t2 FROM mt")
def match_beats(spark, d):
    return bt.match_mutual(kind(spark, d, "ecg"), kind(spark, d, "ecg2"), "record_id", TOL).select("record_id", *r6("t", "t2"))


@query("match_beats_greedy", f"""WITH RECURSIVE {_BT}, b AS (SELECT record_id, list(t ORDER BY t) FILTER (side = 0) AS ref, list(t ORDER BY t) FILTER (side = 1) AS det FROM (SELECT *, 0 AS side FROM ec UNION ALL SELECT *, 1 FROM e2) GROUP BY record_id),
  s AS (SELECT record_id, coalesce(ref, []) AS ahead, coalesce(det, []) AS free, 0 AS tp, 0 AS fn FROM b UNION ALL
    SELECT record_id, ahead[2:], CASE WHEN hit THEN list_filter(free, lambda u: u <> near.t) ELSE free END, tp + hit::INT, fn + (NOT hit)::INT FROM (
      SELECT *, coalesce(near.gap <= 6, false) AS hit FROM (SELECT *, list_min(list_transform(free, lambda u: {{'gap': abs(u - ahead[1]), 't': u}})) AS near FROM s WHERE len(ahead) > 0)))
  SELECT record_id, tp, len(free) AS fp, fn FROM s WHERE len(ahead) = 0""")
def match_beats_greedy(spark, d):
    return bt.match_greedy(kind(spark, d, "ecg"), kind(spark, d, "ecg2"), "record_id", TOL)


_TP = f"{_MT}, c AS (SELECT record_id, (SELECT count(*) FROM mt WHERE mt.record_id = r.record_id) AS tp, (SELECT count(*) FROM ec WHERE ec.record_id = r.record_id) AS nr, (SELECT count(*) FROM e2 WHERE e2.record_id = r.record_id) AS nd FROM (SELECT record_id FROM ec UNION SELECT record_id FROM e2) r)"


def _tallies(spark, d):
    count = lambda rows, name: rows.groupBy("record_id").agg(F.count("*").alias(name))
    ref, det = kind(spark, d, "ecg"), kind(spark, d, "ecg2")
    both = count(ref, "nr").join(count(det, "nd"), "record_id", "full").join(count(bt.match_mutual(ref, det, "record_id", TOL), "tp"), "record_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("record_id", zero("tp").alias("tp"), (zero("nd") - zero("tp")).alias("fp"), (zero("nr") - zero("tp")).alias("fn"))


@query("beat_prf", f"WITH {_TP}, s AS (SELECT record_id, sum(tp)::BIGINT AS tp, sum(nd - tp)::BIGINT AS fp, sum(nr - tp)::BIGINT AS fn FROM c GROUP BY ROLLUP (record_id)) SELECT record_id, tp, fp, fn, CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 6) END AS sensitivity, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 6) END AS ppv, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM s")
def beat_prf(spark, d):
    """Per record, and pooled over all records (record_id NULL)."""
    s = _tallies(spark, d).rollup("record_id").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return s.select("record_id", "tp", "fp", "fn", *bt.prf(F.col("tp"), F.col("fp"), F.col("fn"))).withColumns({c: F.round(c, 6) for c in ("sensitivity", "ppv", "f1")})


@query("bsqi", f"WITH {_TP} SELECT record_id, CASE WHEN nr > 0 THEN round(tp::DOUBLE / nr, 6) END AS confirmed, CASE WHEN greatest(nr, nd) > 0 THEN round(least(nr, nd)::DOUBLE / greatest(nr, nd), 6) END AS count_ratio FROM c")
def bsqi(spark, d):
    c = _tallies(spark, d)
    nr, nd = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")
    return c.select("record_id", F.when(nr > 0, F.round(F.col("tp") / nr, 6)).alias("confirmed"), F.round(F.least(nr, nd) / F.greatest(nr, nd), 6).alias("count_ratio"))


@query("monitor_hr_agreement", f"""WITH {_BT}, a AS (SELECT record_id, floor(t / 240)::BIGINT AS win, count(*) AS n FROM ec GROUP BY ALL), b AS (SELECT record_id, floor(t_h / 240)::BIGINT AS win, median(x) AS numeric FROM fx_beats WHERE kind = 'pulse' GROUP BY ALL)
  SELECT a.record_id, count(*) AS windows, round(avg(abs(n - numeric)), 6) AS mae, round(avg((abs(n - numeric) <= 5)::INT), 6) AS within_5 FROM a JOIN b USING (record_id, win) GROUP BY a.record_id""")
def monitor_hr_agreement(spark, d):
    """Beats counted per window against the median numeric of the second channel."""
    a = kind(spark, d, "ecg").groupBy("record_id", F.floor(F.col("t") / 240).alias("win")).agg(F.count("*").alias("n"))
    b = fx.beats(spark, d).where("kind = 'pulse'").groupBy("record_id", F.floor(F.col("t_h") / 240).alias("win")).agg(F.percentile("x", 0.5).alias("numeric"))
    gap = F.abs(F.col("n") - F.col("numeric"))
    return a.join(b, ["record_id", "win"]).groupBy("record_id").agg(F.count("*").alias("windows"), F.round(F.avg(gap), 6).alias("mae"), F.round(F.avg((gap <= 5).cast("int")), 6).alias("within_5"))


@query("beat_token_map", f"WITH {_PK}, t AS (SELECT DISTINCT window_id, i * 8 // 64 AS token FROM pk), g AS (SELECT DISTINCT window_id FROM fx_windows) SELECT g.window_id, k::INT AS token, (t.token IS NOT NULL)::INT AS hit FROM g CROSS JOIN (SELECT unnest(range(8)) AS k) LEFT JOIN t ON t.window_id = g.window_id AND t.token = k")
def beat_token_map(spark, d):
    hits = _peaks(spark, d).select("window_id", F.floor(F.col("i") * 8 / 64).cast("int").alias("token")).distinct().withColumn("hit", F.lit(1))
    grid = fx.windows(spark, d).where("i = 0").select("window_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("token"))
    return grid.join(hits, ["window_id", "token"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
