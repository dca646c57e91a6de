"""Plans of sources, windowing and quality. Channels are event types; windows are embedding rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..operators import signals as sg
from . import fixtures as fx
from .evaluation import r6
from .fixtures import query

PRIORITY, PULSES = ["VIEW", "CLICK"], ["PURCHASE", "ERROR"]
_H = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
RC = ["record_id", "channel"]


@query("votes_aggregate", "SELECT event_id, round(avg(decision), 6) AS frac_true, count(*) AS n_annotators FROM fx_votes WHERE NOT is_adjudication GROUP BY event_id")
def votes_aggregate(spark, d):
    return fx.votes(spark, d).where("not is_adjudication").groupBy("event_id").agg(F.round(F.avg("decision"), 6).alias("frac_true"), F.count("*").alias("n_annotators"))


@query("infer_sampling_rate", "WITH f AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY rn) AS dt FROM f WHERE rn <= 1000) SELECT user_id, round(1 / median(dt), 9) AS rate FROM g GROUP BY user_id HAVING median(dt) > 0")
def infer_sampling_rate(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = fx.read(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), F.row_number().over(w).alias("rn")).where("rn <= 1000")
    rows = rows.withColumn("dt", F.col("t") - F.lag("t").over(W.partitionBy("user_id").orderBy("rn")))
    return rows.groupBy("user_id").agg(F.percentile("dt", 0.5).alias("dt")).where("dt > 0").select("user_id", F.round(F.lit(1.0) / F.col("dt"), 9).alias("rate"))


@query("windows_enrich", "WITH v AS (SELECT event_id, avg(decision) AS frac_true, count(*) AS n FROM fx_votes WHERE NOT is_adjudication GROUP BY event_id) SELECT w.vec_id AS window_id, l.quality AS label, coalesce(s.split, 'none') AS split, round(v.frac_true, 6) AS frac_true, v.n AS n_annotators FROM embeddings w JOIN labels l ON l.doc_id = w.vec_id LEFT JOIN fx_split s ON s.event_id = w.vec_id LEFT JOIN v ON v.event_id = w.vec_id")
def windows_enrich(spark, d):
    v = fx.votes(spark, d).where("not is_adjudication").groupBy("event_id").agg(F.avg("decision").alias("frac_true"), F.count("*").alias("n_annotators"))
    w = fx.read(spark, d, "embeddings").select(F.col("vec_id").alias("window_id"), F.col("vec_id").alias("event_id"))
    labels = fx.read(spark, d, "labels").select(F.col("doc_id").alias("event_id"), F.col("quality").alias("label"))
    out = w.join(labels, "event_id").join(fx.split(spark, d), "event_id", "left").join(v, "event_id", "left")
    return out.select("window_id", "label", F.coalesce("split", F.lit("none")).alias("split"), F.round("frac_true", 6).alias("frac_true"), "n_annotators")


@query("run_name_parse", "WITH n AS (SELECT DISTINCT 'init' || variant || '_mode' || seed || '_f0.' || fold AS name, variant || '_seed' || seed || '_fold' || fold AS file FROM fx_oof) SELECT name, regexp_extract(name, '^(.*)_(.*)_f([0-9.]+)$', 1) AS init, regexp_extract(name, '^(.*)_(.*)_f([0-9.]+)$', 2) AS mode, regexp_extract(name, '^(.*)_(.*)_f([0-9.]+)$', 3)::DOUBLE AS fraction, regexp_extract(file, '^(.*)_seed([0-9]+)_fold([0-9]+)$', 1) AS variant, regexp_extract(file, '^(.*)_seed([0-9]+)_fold([0-9]+)$', 2)::INT AS seed FROM n")
def run_name_parse(spark, d):
    n = fx.predictions(spark, d).where("role = 'test'").select("variant", "seed", "fold").distinct()
    n = n.select(F.concat(F.lit("init"), "variant", F.lit("_mode"), "seed", F.lit("_f0."), "fold").alias("name"), F.concat("variant", F.lit("_seed"), "seed", F.lit("_fold"), "fold").alias("file"))
    run, file = r"^(.*)_(.*)_f([0-9.]+)$", r"^(.*)_seed([0-9]+)_fold([0-9]+)$"
    return n.select("name", F.regexp_extract("name", run, 1).alias("init"), F.regexp_extract("name", run, 2).alias("mode"), F.regexp_extract("name", run, 3).cast("double").alias("fraction"), F.regexp_extract("file", file, 1).alias("variant"), F.regexp_extract("file", file, 2).cast("int").alias("seed"))


@query("ops_flatten", "SELECT event_id, k AS name, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def ops_flatten(spark, d):
    """Nested JSON to one row per entry."""
    return fx.read(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))


@query("mean_of_cell", "WITH t AS (SELECT DISTINCT variant, seed, '0.' || (600 + seed) || ' +/- 0.0' || (40 + seed) AS cell, '[-0.' || seed || ', +0.' || (seed + 1) || ']' AS ci FROM fx_oof) SELECT variant, seed, split_part(cell, ' +/- ', 1)::DOUBLE AS mean, split_part(cell, ' +/- ', 2)::DOUBLE AS std, split_part(trim(ci, '[]'), ', ', 1)::DOUBLE AS low, split_part(trim(ci, '[]'), ', ', 2)::DOUBLE AS high FROM t")
def mean_of_cell(spark, d):
    t = fx.predictions(spark, d).where("role = 'test'").select("variant", "seed").distinct()
    cell = F.concat(F.lit("0."), F.col("seed") + 600, F.lit(" +/- 0.0"), F.col("seed") + 40)
    ci = F.concat(F.lit("[-0."), "seed", F.lit(", +0."), F.col("seed") + 1, F.lit("]"))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    part = t.select("variant", "seed", F.split(cell, r" \+/- ").alias("c"), F.split(F.regexp_replace(ci, r"[\[\]]", ""), ", ").alias("e"))
    return part.select("variant", "seed", F.col("c")[0].alias("mean"), F.col("c")[1].alias("std"), F.col("e")[0].alias("low"), F.col("e")[1].alias("high")).select("variant", "seed", *map(number, ("mean", "std", "low", "high")))


_CH = "ch AS (SELECT DISTINCT record_id, channel FROM fx_samples)"


def _channels(spark, d):
    return fx.read(spark, d, "events").select(F.col("user_id").alias("record_id"), F.col("event_type").alias("channel")).distinct()


@query("channel_select", f"WITH {_CH}, l AS (SELECT record_id, channel, row_number() OVER (PARTITION BY record_id ORDER BY CASE upper(channel) WHEN 'VIEW' THEN 1 WHEN 'CLICK' THEN 2 ELSE 1000 END, channel) AS rn FROM ch WHERE upper(channel) NOT IN ('PURCHASE', 'ERROR')), p AS (SELECT record_id, min_by(channel, CASE upper(channel) WHEN 'PURCHASE' THEN 1 ELSE 2 END) AS pulse FROM ch WHERE upper(channel) IN ('PURCHASE', 'ERROR') GROUP BY record_id), f AS (SELECT record_id, max(channel) FILTER (rn = 1) AS \"primary\", max(channel) FILTER (rn = 2) AS second FROM l WHERE rn <= 2 GROUP BY record_id) SELECT coalesce(f.record_id, p.record_id) AS record_id, \"primary\", second, pulse FROM f FULL JOIN p ON f.record_id = p.record_id")
def channel_select(spark, d):
    return sg.channel_select(_channels(spark, d), PRIORITY, PULSES)


@query("lead_signature", f"WITH {_CH}, s AS (SELECT record_id, string_agg(channel, '|' ORDER BY channel) AS signature FROM ch WHERE upper(channel) NOT IN ('PURCHASE', 'ERROR') GROUP BY record_id) SELECT signature, count(*) AS records FROM s GROUP BY signature")
def lead_signature(spark, d):
    return sg.lead_signature(_channels(spark, d), PULSES).groupBy("signature").agg(F.count("*").alias("records"))


_GAPS = "gp AS (SELECT record_id, channel, i, CASE WHEN i % 4 = 1 OR i % 7 = 0 THEN NULL ELSE x END AS x FROM fx_samples)"


def _gapped(spark, d):
    return fx.samples(spark, d).withColumn("x", F.when((F.col("i") % 4 == 1) | (F.col("i") % 7 == 0), None).otherwise(F.col("x")))


@query("fill_zero", f"WITH {_GAPS} SELECT record_id, channel, i, coalesce(x, 0.0) AS x FROM gp")
def fill_zero(spark, d):
    return _gapped(spark, d).withColumn("x", sg.fill_zero(F.col("x")))


@query("interpolate_gaps", f"""WITH {_GAPS}, w AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS p, first_value(x IGNORE NULLS) OVER a AS n, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni FROM gp
  WINDOW b AS (PARTITION BY record_id, channel ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY record_id, channel ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT record_id, channel, i, round(coalesce(x, p + (n - p) * (i - pi) / nullif(ni - pi, 0), p, n), 6) AS x FROM w""")
def interpolate_gaps(spark, d):
    return sg.interpolate_gaps(_gapped(spark, d), RC).withColumn("x", F.round("x", 6))


@query("window_end_at_trigger", "WITH t AS (SELECT record_id, channel, max(i) // 2 + 2 AS trigger FROM fx_samples GROUP BY ALL), c AS (SELECT s.*, trigger, count(*) OVER (PARTITION BY s.record_id, s.channel, trigger) AS n FROM fx_samples s JOIN t USING (record_id, channel) WHERE i >= trigger - 4 AND i < trigger + 1) SELECT record_id, channel, trigger, i, round(x, 6) AS x, i - (trigger - 4) AS k FROM c WHERE n = 5")
def window_end_at_trigger(spark, d):
    rows = fx.samples(spark, d)
    triggers = rows.groupBy(*RC).agg((F.floor(F.max("i") / 2) + 2).alias("trigger"))
    return sg.window_end_at_trigger(rows, triggers, RC, 4, 1).select(*RC, "trigger", "i", *r6("x"), "k")


_TUM = "tw AS (SELECT *, count(*) OVER (PARTITION BY record_id, channel, i // 3) AS n, i // 3 AS win FROM fx_samples)"


@query("window_tumbling", f"WITH {_TUM} SELECT record_id, channel, win, round(avg(x), 6) AS mean FROM tw WHERE n = 3 GROUP BY ALL")
def window_tumbling(spark, d):
    return sg.window_tumbling(fx.samples(spark, d), RC, 3).groupBy(*RC, "win").agg(F.round(F.avg("x"), 6).alias("mean"))


@query("window_pick_even", f"WITH {_TUM}, d AS (SELECT DISTINCT record_id, win FROM tw WHERE n = 3), p AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY win) - 1 AS pos, count(*) OVER (PARTITION BY record_id) AS c FROM d) SELECT record_id, win FROM p WHERE pos IN (floor(0 * (c - 1) / 2.0), floor(1 * (c - 1) / 2.0), floor(2 * (c - 1) / 2.0))")
def window_pick_even(spark, d):
    return sg.window_pick_even(sg.window_tumbling(fx.samples(spark, d), RC, 3), ["record_id"], 3)


@query("window_random_crops", f"""WITH n AS (SELECT record_id, channel, count(*) AS n FROM fx_samples GROUP BY ALL HAVING count(*) >= 4), c AS (SELECT n.*, c, {_H.format("'crop:' || record_id || ':' || channel || ':' || c")} % (n - 3) AS start FROM n CROSS JOIN (SELECT unnest(range(2)) AS c)),
  k AS (SELECT c.record_id, c.channel, c.c, i - start AS k, x, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM c JOIN fx_samples USING (record_id, channel) WHERE i >= start AND i < start + 4 WINDOW w AS (PARTITION BY c.record_id, c.channel, c.c)) SELECT record_id, channel, c::INT AS crop, k, round((x - m) / (s + 1e-8), 5) AS x FROM k""")
def window_random_crops(spark, d):
    """Two z-normalised crops of four samples per signal; the start is drawn by MD5."""
    rows = fx.samples(spark, d)
    n = rows.groupBy(*RC).agg(F.count("*").alias("n")).where("n >= 4").select(*RC, "n", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("crop"))
    n = n.withColumn("start", draw(F.lit("crop"), *RC, F.col("crop")) % (F.col("n") - 3))
    cut = rows.join(n, RC).where("i >= start and i < start + 4").select(*RC, "crop", (F.col("i") - F.col("start")).alias("k"), "x")
    return sg.z_normalize(cut, [*RC, "crop"]).withColumn("x", F.round("x", 5))


@query("resample_linear", """WITH n AS (SELECT record_id, channel, max(i) + 1 AS n FROM fx_samples GROUP BY ALL), g AS (SELECT *, unnest(range(0, (n * 3 - 1) // 2 + 1)) AS k FROM n), p AS (SELECT *, least(k * 2 / 3.0::DOUBLE, (n - 1)::DOUBLE) AS pos FROM g)
  SELECT p.record_id, p.channel, k, round(a.x + CASE WHEN pos > floor(pos) THEN (b.x - a.x) * (pos - floor(pos)) ELSE 0.0 END, 6) AS x FROM p JOIN fx_samples a ON a.record_id = p.record_id AND a.channel = p.channel AND a.i = floor(pos)::BIGINT LEFT JOIN fx_samples b ON b.record_id = p.record_id AND b.channel = p.channel AND b.i = floor(pos)::BIGINT + 1""")
def resample_linear(spark, d):
    return sg.resample_linear(fx.samples(spark, d), RC, 3, 2).withColumn("x", F.round("x", 6))


@query("decimate", "SELECT window_id, i // 4 AS i, round(avg(x), 6) AS x FROM fx_windows GROUP BY ALL")
def decimate(spark, d):
    return sg.decimate(fx.windows(spark, d), ["window_id"], 4, mean=True).select("window_id", "i", *r6("x"))


@query("z_normalize", "SELECT window_id, i, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-8), 6) AS x FROM fx_windows WINDOW w AS (PARTITION BY window_id)")
def z_normalize(spark, d):
    return sg.z_normalize(fx.windows(spark, d), ["window_id"]).select("window_id", "i", *r6("x"))


_QUAL = """fb AS (SELECT window_id, i // 8 AS b, stddev_pop(x) AS d, count(*) AS n FROM fx_windows GROUP BY ALL), gs AS (SELECT window_id, stddev_pop(x) AS s, min(x) AS lo, max(x) AS hi FROM fx_windows GROUP BY window_id),
  fl AS (SELECT window_id, avg((d < 1e-3 * (s + 1e-8))::INT) AS flat FROM fb JOIN gs USING (window_id) WHERE n = 8 GROUP BY window_id),
  cl AS (SELECT window_id, CASE WHEN max(hi - lo) < 1e-8 THEN 1.0 ELSE avg((x <= lo + 0.001::DOUBLE * (hi - lo) OR x >= hi - 0.001::DOUBLE * (hi - lo))::INT) END AS clip FROM fx_windows JOIN gs USING (window_id) GROUP BY window_id),
  ql AS (SELECT window_id, flat, clip, greatest(0.0, 1 - 0.5::DOUBLE * least(flat / 0.01::DOUBLE, 1.0) - 0.5::DOUBLE * least(clip / 0.2::DOUBLE, 1.0))::DOUBLE AS quality FROM fl JOIN cl USING (window_id))"""


@query("flatline_fraction", f"WITH {_QUAL} SELECT window_id, round(flat, 6) AS flat FROM fl")
def flatline_fraction(spark, d):
    return sg.flatline_fraction(fx.windows(spark, d), ["window_id"], 8).select("window_id", *r6("flat"))


@query("clip_fraction", f"WITH {_QUAL} SELECT window_id, round(clip, 6) AS clip FROM cl")
def clip_fraction(spark, d):
    return sg.clip_fraction(fx.windows(spark, d), ["window_id"]).select("window_id", *r6("clip"))


@query("signal_quality", f"WITH {_QUAL} SELECT window_id, round(quality, 6) AS quality FROM ql")
def signal_quality(spark, d):
    return sg.signal_quality(fx.windows(spark, d), ["window_id"], 8).select("window_id", *r6("quality"))


_COH = f"""WITH {_QUAL}, cq AS (SELECT (e.vec_id // 3) AS record_id, max(quality) FILTER (e.vec_id % 3 = 0 AND label <> 9) AS ecg, max(quality) FILTER (e.vec_id % 3 = 1 AND label > 3) AS ppg, max(quality) FILTER (e.vec_id % 3 = 2 AND label > 2) AS abp FROM ql JOIN embeddings e ON e.vec_id = window_id GROUP BY e.vec_id // 3),
  co AS (SELECT record_id, CASE WHEN ecg IS NULL THEN NULL WHEN ppg IS NOT NULL AND least(ecg, ppg) >= 0.8 THEN 'ppg' WHEN abp IS NOT NULL AND least(ecg, abp) >= 0.8 THEN 'abp' END AS pulse_source, ecg, ppg, abp FROM cq),
  ch AS (SELECT record_id, pulse_source, CASE WHEN ecg IS NULL THEN 'no ecg' WHEN pulse_source IS NOT NULL THEN 'kept' WHEN ppg IS NULL AND abp IS NULL THEN 'no pulse' ELSE 'low quality' END AS reason, round(CASE pulse_source WHEN 'ppg' THEN least(ecg, ppg) WHEN 'abp' THEN least(ecg, abp) END, 6) AS quality FROM co)"""


def _cohort(spark, d):
    q = sg.signal_quality(fx.windows(spark, d), ["window_id"], 8).join(fx.read(spark, d, "embeddings").select(F.col("vec_id").alias("window_id"), "label"), "window_id")
    part = lambda k, ok: F.max(F.when((F.col("window_id") % 3 == k) & ok, F.col("quality")))
    q = q.groupBy(F.floor(F.col("window_id") / 3).alias("record_id")).agg(part(0, F.col("label") != 9).alias("ecg"), part(1, F.col("label") > 3).alias("ppg"), part(2, F.col("label") > 2).alias("abp"))
    return sg.cohort_build(q, 0.8).withColumn("quality", F.round("quality", 6))


@query("cohort_build", f"{_COH} SELECT record_id, pulse_source, reason, quality FROM ch")
def cohort_build(spark, d):
    return _cohort(spark, d)


@query("cohort_flow", f"{_COH} SELECT reason, count(*) AS records, count(*) FILTER (pulse_source = 'abp') AS abp_as_pulse FROM ch GROUP BY reason")
def cohort_flow(spark, d):
    return _cohort(spark, d).groupBy("reason").agg(F.count("*").alias("records"), F.count_if(F.col("pulse_source") == "abp").alias("abp_as_pulse"))


@query("modality_mask", f"{_COH}, m AS (SELECT unnest(['ecg', 'ppg', 'abp']) AS modality) SELECT record_id, modality, CASE modality WHEN 'ecg' THEN reason <> 'no ecg' WHEN 'ppg' THEN coalesce(pulse_source = 'ppg', false) ELSE coalesce(pulse_source = 'abp', false) END AS present FROM ch CROSS JOIN m")
def modality_mask(spark, d):
    """A substituted pressure pulse counts in its own slot, not as PPG."""
    has = lambda s: F.coalesce(F.col("pulse_source") == s, F.lit(False))
    return _cohort(spark, d).select("record_id", F.explode(F.create_map(F.lit("ecg"), F.col("reason") != "no ecg", F.lit("ppg"), has("ppg"), F.lit("abp"), has("abp"))).alias("modality", "present"))
