"""Feature plans: beats are the first channel's events in hours, samples the 64-value windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import beats as bt
from ..operators import features as ft
from . import fixtures as fx
from .beat_plans import _PK, _peaks, kind
from .fixtures import query

_RR = "bs AS (SELECT DISTINCT record_id, t_h AS t FROM fx_beats WHERE kind = 'ecg'), r1 AS (SELECT record_id, t, row_number() OVER w AS k, t - lag(t) OVER w AS rr FROM bs WINDOW w AS (PARTITION BY record_id ORDER BY t)), rr AS (SELECT *, rr - lag(rr) OVER (PARTITION BY record_id ORDER BY t) AS d FROM r1)"
START, END = 473352.0, 474072.0


def rounded(rows, *keys, digits=5):
    return rows.select(*keys, *(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes if c not in keys))


def _r(*cols, digits=5):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


@query("rate_stats", f"""WITH {_RR}, m AS (SELECT record_id, median(rr) AS med FROM rr GROUP BY record_id), f AS (SELECT record_id, count(*) AS n, count(*) FILTER (t >= {END}::DOUBLE - 5) AS n_last5, 60 / nullif(max(med), 0) AS rate, stddev_pop(rr) / avg(rr) AS rr_cv, max(rr) AS rr_max, min(rr) AS rr_min, sqrt(avg(d * d)) AS rmssd,
  avg((abs(rr - med) > 0.2::DOUBLE * med)::INT) AS irregular, {END}::DOUBLE - max(t) AS gap_to_end, greatest({END}::DOUBLE - max(t), min(t) - {START}::DOUBLE, coalesce(max(rr), 0)) AS longest_gap FROM rr JOIN m USING (record_id) GROUP BY record_id)
  SELECT * REPLACE (CASE WHEN n < 2 THEN 0 ELSE rate END AS rate, CASE WHEN n < 2 THEN 0 ELSE rr_cv END AS rr_cv, CASE WHEN n < 2 THEN {END - START}::DOUBLE ELSE rr_max END AS rr_max, CASE WHEN n < 2 THEN {END - START}::DOUBLE ELSE rr_min END AS rr_min,
    coalesce(rmssd, 0) AS rmssd, CASE WHEN n < 2 THEN 1 ELSE irregular END AS irregular) FROM (SELECT record_id, n, n_last5, {_r('rate', 'rr_cv', 'rr_max', 'rr_min', 'rmssd', 'irregular', 'gap_to_end', 'longest_gap')} FROM f)""")
def rate_stats(spark, d):
    return rounded(ft.rate_stats(kind(spark, d, "ecg"), "record_id", START, END), "record_id")


@query("hrv_features", f"""WITH {_RR}, w AS (SELECT *, median(rr) OVER (PARTITION BY record_id) AS med, count(rr) OVER (PARTITION BY record_id) AS n, count(rr) OVER (PARTITION BY record_id ORDER BY t) AS j FROM rr),
  f AS (SELECT record_id, stddev_pop(rr) AS sdnn, sqrt(avg(d * d)) AS rmssd, avg((abs(d) > 5)::INT) AS pnn50, avg((abs(d) > 2)::INT) AS pnn20, max(rr) - min(rr) AS rr_range, median(abs(rr - med)) AS rr_mad, sqrt(var_pop(d) / 2) AS sd1, sqrt(greatest(0.0, 2 * var_pop(rr) - var_pop(d) / 2)) AS sd2,
    max_by(rr, t) AS last_rr, avg(rr) FILTER (j > n - greatest(1, n // 3)) / avg(rr) FILTER (j <= greatest(1, n // 3)) AS last_first, (avg(rr * rr * rr) - 3 * avg(rr) * avg(rr * rr) + 2 * avg(rr) ** 3) / nullif(stddev_pop(rr) ** 3, 0) AS rr_skew,
    CASE WHEN max(rr) > min(rr) THEN count(rr)::DOUBLE / max(full_) FILTER (rr IS NOT NULL) END AS rr_tri FROM (SELECT *, count(rr) OVER (PARTITION BY record_id, floor((rr - lo) / 2.0::DOUBLE)) AS full_ FROM (SELECT *, min(rr) OVER (PARTITION BY record_id) AS lo FROM w)) GROUP BY record_id)
  SELECT record_id, {_r('sdnn', 'rmssd', 'pnn50', 'pnn20', 'rr_range', 'rr_mad', 'sd1', 'sd2', 'last_rr', 'last_first', 'rr_skew', 'rr_tri')} FROM f""")
def hrv_features(spark, d):
    return rounded(ft.hrv_features(kind(spark, d, "ecg"), "record_id", 5.0, 2.0, 2.0), "record_id")


@query("rr_histogram_entropy", f"WITH {_RR}, b AS (SELECT record_id, least(11, floor((rr - 2) / (48.0::DOUBLE / 12))) AS b, count(*) AS c FROM rr WHERE rr BETWEEN 2 AND 50 GROUP BY ALL), p AS (SELECT *, c::DOUBLE / sum(c) OVER (PARTITION BY record_id) AS p FROM b) SELECT record_id, round(sum(-p * ln(p)), 5) AS entropy FROM p GROUP BY record_id")
def rr_histogram_entropy(spark, d):
    return rounded(ft.rr_histogram_entropy(kind(spark, d, "ecg"), "record_id", 2.0, 50.0), "record_id")


@query("linear_trend", f"WITH {_RR} SELECT record_id, round(regr_slope(rr, k), 5) AS rr_slope, round(regr_slope(60 / rr, k), 5) AS hr_slope FROM rr WHERE rr > 0 GROUP BY record_id")
def linear_trend(spark, d):
    return rounded(ft.linear_trend(kind(spark, d, "ecg"), "record_id"), "record_id")


@query("sample_entropy", """WITH t AS (SELECT window_id, row_number() OVER w AS rn, x, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2, count(*) OVER (PARTITION BY window_id) AS n, 0.2::DOUBLE * stddev_pop(x) OVER (PARTITION BY window_id) AS r FROM fx_windows WINDOW w AS (PARTITION BY window_id ORDER BY i)),
  p AS (SELECT a.window_id, count(*) AS b, count(*) FILTER (abs(a.x2 - b.x2) <= a.r) AS a FROM t a JOIN t b ON a.window_id = b.window_id AND a.rn < b.rn AND b.rn <= b.n - 2 AND greatest(abs(a.x - b.x), abs(a.x1 - b.x1)) <= a.r GROUP BY a.window_id),
  o AS (SELECT window_id, count(*) AS n, stddev_pop(x) AS s FROM fx_windows GROUP BY window_id)
  SELECT window_id, CASE WHEN n < 6 THEN NULL WHEN s < 1e-8 THEN 0.0 WHEN a > 0 THEN round(-ln(a::DOUBLE / b), 5) WHEN b > 0 THEN round(ln(b), 5) END AS sampen FROM o LEFT JOIN p USING (window_id)""")
def sample_entropy(spark, d):
    return rounded(ft.sample_entropy(fx.windows(spark, d), "window_id"), "window_id")


@query("rr_irregularity", f"""WITH {_RR}, pk AS (SELECT record_id, count(*) AS peaks FROM rr GROUP BY record_id), q AS (SELECT record_id, rr, rr - lag(rr) OVER (PARTITION BY record_id ORDER BY t) AS d FROM rr WHERE rr > 0.5 AND rr < 48),
  f AS (SELECT record_id, count(*) AS n, stddev_pop(rr) / avg(rr) AS cv, sqrt(avg(d * d)) AS rmssd, sqrt(avg(d * d)) / avg(rr) AS nrmssd, avg((abs(d) > 5)::INT) AS pnn50, avg((abs(d) > 2)::INT) AS pnn20, median(abs(d)) AS mad_diff, max(rr) - min(rr) AS range FROM q GROUP BY record_id)
  SELECT pk.record_id, {', '.join(f'CASE WHEN peaks >= 4 AND coalesce(n, 0) >= 3 THEN round({c}, 5) END AS {c}' for c in ('cv', 'rmssd', 'nrmssd', 'pnn50', 'pnn20', 'mad_diff', 'range'))} FROM pk LEFT JOIN f ON f.record_id = pk.record_id""")
def rr_irregularity(spark, d):
    return rounded(ft.rr_irregularity(kind(spark, d, "ecg"), "record_id", 0.5, 48.0, 5.0, 2.0), "record_id")


@query("stats_pack", f"WITH w AS (SELECT *, median(x) OVER (PARTITION BY window_id) AS m FROM fx_windows), f AS (SELECT window_id, avg(x) AS mean, stddev_pop(x) AS std, max(m) AS med, min(x) AS min, max(x) AS max, median(abs(x - m)) AS mad, stddev_pop(x) / abs(nullif(avg(x), 0)) AS cv FROM w GROUP BY window_id) SELECT window_id, {_r('mean', 'std', 'med', 'min', 'max', 'mad', 'cv')} FROM f")
def stats_pack(spark, d):
    return rounded(ft.stats_pack(fx.windows(spark, d), "window_id", "x"), "window_id")


@query("template_corr", f"WITH {_PK}, s AS (SELECT pk.window_id, pk.i AS beat, w.i - pk.i AS o, w.x, count(*) OVER (PARTITION BY pk.window_id, pk.i) AS n FROM pk JOIN fx_windows w ON w.window_id = pk.window_id AND abs(w.i - pk.i) <= 4), m AS (SELECT *, median(x) OVER (PARTITION BY window_id, o) AS med FROM s WHERE n = 9), c AS (SELECT window_id, beat, corr(x, med) AS c FROM m GROUP BY ALL), f AS (SELECT window_id, count(*) AS beats, avg(c) AS mean, min(c) AS min, stddev_pop(c) AS std, max_by(c, beat) AS last FROM c GROUP BY window_id) SELECT window_id, beats, {', '.join(f'CASE WHEN beats >= 3 THEN round({c}, 5) END AS {c}' for c in ('mean', 'min', 'std', 'last'))} FROM f")
def template_corr(spark, d):
    return rounded(ft.template_corr(_peaks(spark, d), fx.windows(spark, d), "window_id", 4), "window_id")


_Z = "zz AS (SELECT window_id, record_id, i, (x - avg(x) OVER (PARTITION BY window_id)) / (stddev_pop(x) OVER (PARTITION BY window_id) + 1e-8) AS z, 64 AS n FROM fx_windows)"


@query("acf_peak", f"WITH {_Z}, c AS (SELECT a.window_id, b.i - a.i AS lag, sum(a.z * b.z) / 64 AS c FROM zz a JOIN zz b ON a.window_id = b.window_id AND b.i - a.i BETWEEN 4 AND 20 GROUP BY ALL) SELECT window_id, round(max_by(c, (round(c, 9), -lag)), 5) AS peak, max_by(lag, (round(c, 9), -lag)) AS lag FROM c GROUP BY window_id")
def acf_peak(spark, d):
    w = fx.windows(spark, d)
    return rounded(ft.peak_lag(ft.lag_products(w, w, "window_id", list(range(4, 21))), "window_id"), "window_id")


@query("xcorr_coupling", f"WITH {_Z}, c AS (SELECT a.record_id, b.i - a.i AS lag, sum(a.z * b.z) / 64 AS c FROM zz a JOIN zz b ON a.record_id = b.record_id AND a.window_id % 2 = 0 AND b.window_id % 2 = 1 AND (b.i - a.i) IN (0, 2, 4, 6, 8, 10, 12) GROUP BY ALL) SELECT record_id, round(max_by(c, (round(c, 9), -lag)), 5) AS peak, max_by(lag, (round(c, 9), -lag)) AS lag FROM c GROUP BY record_id")
def xcorr_coupling(spark, d):
    w = fx.windows(spark, d)
    a, b = (w.where(F.col("window_id") % 2 == k) for k in (0, 1))
    return rounded(ft.peak_lag(ft.lag_products(a, b, "record_id", list(range(0, 13, 2))), "record_id"), "record_id")


_PW = "ct AS (SELECT window_id, i, x - avg(x) OVER (PARTITION BY window_id) AS x FROM fx_windows), pw AS (SELECT window_id, k, sum(x * cos(k * i * 2 * pi() / 64)) ** 2 + sum(x * sin(k * i * 2 * pi() / 64)) ** 2 AS power FROM ct CROSS JOIN (SELECT unnest(range(0, 33)) AS k) GROUP BY ALL)"


@query("periodogram", f"""WITH {_PW}, q AS (SELECT window_id, k, power / nullif(sum(power) OVER (PARTITION BY window_id), 0) AS q FROM pw WHERE k > 0), r AS (SELECT *, sum(q) OVER (PARTITION BY window_id ORDER BY k) AS run FROM q),
  f AS (SELECT window_id, sum(CASE WHEN k BETWEEN 1 AND 4 THEN q ELSE 0 END) AS low, sum(CASE WHEN k BETWEEN 5 AND 16 THEN q ELSE 0 END) AS mid, sum(CASE WHEN k BETWEEN 17 AND 32 THEN q ELSE 0 END) AS high, sum(CASE WHEN q > 0 THEN -q * ln(q) END) AS entropy, max_by(k, (round(q, 9), -k))::INT AS dominant, sum(k * q) AS centroid, sqrt(greatest(0.0, sum(k * k * q) - sum(k * q) ** 2)) AS bandwidth, min(k) FILTER (run >= 0.9::DOUBLE - 1e-9)::INT AS edge90 FROM r GROUP BY window_id)
  SELECT window_id, {_r('low', 'mid', 'high', 'entropy')}, dominant, {_r('centroid', 'bandwidth')}, edge90 FROM f""")
def periodogram(spark, d):
    p = ft.dft_power(fx.windows(spark, d), "window_id", 64)
    return rounded(ft.spectrum_summary(p, "window_id", {"low": (1, 4), "mid": (5, 16), "high": (17, 32)}), "window_id")


@query("vf_spectral", f"WITH {_PW}, m AS (SELECT *, max_by(k, (round(power, 9), -k)) OVER (PARTITION BY window_id) AS dom FROM pw WHERE k > 0), f AS (SELECT window_id, sum(CASE WHEN abs(k - dom) <= 1 THEN power ELSE 0 END) / nullif(sum(power), 0) AS concentration, sum(CASE WHEN abs(k - dom) > 1 AND abs(k - 2 * dom) > 1 THEN power ELSE 0 END) / nullif(sum(power), 0) AS leakage, sum(CASE WHEN k BETWEEN 3 AND 7 THEN power ELSE 0 END) / nullif(sum(power), 0) AS vf_share FROM m GROUP BY window_id) SELECT window_id, {_r('concentration', 'leakage', 'vf_share')} FROM f")
def vf_spectral(spark, d):
    return rounded(ft.vf_spectral(ft.dft_power(fx.windows(spark, d), "window_id", 64), "window_id", 3, 7), "window_id")


@query("band_snr", f"WITH {_PW} SELECT window_id, round(sum(CASE WHEN k BETWEEN 1 AND 16 THEN power ELSE 0 END) / nullif(sum(CASE WHEN k BETWEEN 24 AND 32 THEN power ELSE 0 END), 0), 5) AS snr FROM pw GROUP BY window_id")
def band_snr(spark, d):
    """Power of the signal's band over that of the highest bins (Parseval)."""
    p = ft.dft_power(fx.windows(spark, d), "window_id", 64)
    part = lambda a, b: F.sum(F.when(F.col("k").between(a, b), F.col("power")).otherwise(0.0))
    return p.groupBy("window_id").agg(F.round(part(1, 16) / F.nullif(part(24, 32), F.lit(0.0)), 5).alias("snr"))


@query("sqi_moments", f"""WITH a AS (SELECT *, x - lag(x) OVER w AS dx, (sign(x) <> sign(lag(x) OVER w))::INT AS sc, avg(x) OVER (PARTITION BY window_id) AS m FROM fx_windows WINDOW w AS (PARTITION BY window_id ORDER BY i)), b AS (SELECT *, dx - lag(dx) OVER (PARTITION BY window_id ORDER BY i) AS dd FROM a),
  f AS (SELECT window_id, avg((x - m) ** 4) / nullif(avg((x - m) ** 2) ** 2, 0) - 3 AS kurtosis, avg((x - m) ** 3) / nullif(avg((x - m) ** 2) ** 1.5, 0) AS skewness, avg((abs(dx) < 1e-3)::INT) AS flat, max(abs(dx)) AS max_step, sum(abs(dx)) AS line_length, avg(sc) AS zero_crossings, sqrt(var_pop(dx) / nullif(var_pop(x), 0)) AS mobility, sqrt(var_pop(dd) / nullif(var_pop(dx), 0)) / sqrt(var_pop(dx) / nullif(var_pop(x), 0)) AS complexity FROM b GROUP BY window_id)
  SELECT window_id, {_r('kurtosis', 'skewness', 'flat', 'max_step', 'line_length', 'zero_crossings', 'mobility', 'complexity')} FROM f""")
def sqi_moments(spark, d):
    return rounded(ft.sqi_moments(fx.windows(spark, d), "window_id"), "window_id")


@query("qrs_morphology", f"""WITH {_PK}, sp AS (SELECT window_id, i AS beat, lead(i) OVER (PARTITION BY window_id ORDER BY i) AS nx, row_number() OVER (PARTITION BY window_id ORDER BY i DESC) AS last FROM pk), b AS (SELECT *, least(beat + 6, coalesce(nx, 64) - 1) AS t1, greatest(beat - 6, 0) AS p0 FROM sp),
  n AS (SELECT b.*, w.i, w.x, abs(w.i - beat) <= 3 AS inside, max(abs(w.x)) FILTER (abs(w.i - beat) <= 3) OVER (PARTITION BY b.window_id, beat) AS top FROM b JOIN fx_windows w ON w.window_id = b.window_id AND w.i BETWEEN beat - 6 AND beat + 6),
  p AS (SELECT window_id, beat, max(last) AS last, max(top) AS amplitude, max(x) FILTER (inside) - min(x) FILTER (inside) AS ptp, count(*) FILTER (inside AND abs(x) >= top / 2) AS width, max(abs(x)) FILTER (i = beat) AS own,
    max(abs(x)) FILTER (i >= beat + 1 AND i < t1 AND t1 - (beat + 1) > 1) AS tw, max(abs(x)) FILTER (i >= p0 AND i < beat - 2 AND beat - 2 - p0 > 1) AS pw FROM n GROUP BY ALL),
  f AS (SELECT window_id, count(*) AS beats, avg(amplitude) AS amplitude, avg(ptp) AS ptp, avg(width) AS width, avg(tw / nullif(own, 0)) AS t_ratio, avg(pw / nullif(own, 0)) AS p_ratio, CASE WHEN count(*) > 1 THEN avg(own) FILTER (last <= 3) / nullif(avg(own), 0) END AS last_vs_all FROM p GROUP BY window_id)
  SELECT window_id, beats, {_r('amplitude', 'ptp', 'width', 't_ratio', 'p_ratio', 'last_vs_all')} FROM f""")
def qrs_morphology(spark, d):
    return rounded(ft.qrs_morphology(_peaks(spark, d), fx.windows(spark, d), "window_id", 3, (1, 6, 1), (6, 2), 1), "window_id")


# a bump of the falling limb: lowest values on either side, up to a higher one, by the samples between
@query("pulse_morphology", f"""WITH {_PK}, s AS (SELECT window_id, i AS peak, coalesce(lag(i) OVER (PARTITION BY window_id ORDER BY i), 0) AS a FROM pk), f0 AS (SELECT s.window_id, peak, min_by(w.i, (w.x, w.i)) AS foot FROM s JOIN fx_windows w ON w.window_id = s.window_id AND w.i BETWEEN a AND peak GROUP BY s.window_id, peak),
  ft AS (SELECT *, CASE WHEN af > peak THEN af ELSE least(peak + 12, 64) END AS nx FROM (SELECT *, lead(foot) OVER (PARTITION BY window_id ORDER BY peak) AS af FROM f0)),
  w2 AS (SELECT *, lead(x) OVER (PARTITION BY window_id ORDER BY i) AS x2 FROM fx_windows), n AS (SELECT ft.*, w2.i, w2.x, w2.x2, max(CASE WHEN w2.i = foot THEN w2.x END) OVER (PARTITION BY ft.window_id, peak) AS base, max(CASE WHEN w2.i = peak THEN w2.x END) OVER (PARTITION BY ft.window_id, peak) AS top FROM ft JOIN w2 ON w2.window_id = ft.window_id AND w2.i BETWEEN foot AND greatest(peak, nx - 1)),
  fall AS (SELECT window_id, peak, i, x, base, top, lag(x) OVER w AS px, lead(x) OVER w AS nxt FROM n WHERE i >= peak AND i < nx WINDOW w AS (PARTITION BY window_id, peak ORDER BY i)),
  cand AS (SELECT * FROM fall WHERE x > px AND x > nxt AND i - peak > 1),
  lim AS (SELECT c.window_id, c.peak, c.i, c.x, c.base, c.top, coalesce(max(o.i) FILTER (o.i < c.i AND o.x > c.x), -1) AS l, coalesce(min(o.i) FILTER (o.i > c.i AND o.x > c.x), 9999) AS r FROM cand c JOIN fall o ON o.window_id = c.window_id AND o.peak = c.peak GROUP BY c.window_id, c.peak, c.i, c.x, c.base, c.top),
  bump AS (SELECT q.window_id, q.peak, q.i, q.x, q.base, q.top, q.x - greatest(min(o.x) FILTER (o.i > q.l AND o.i <= q.i), min(o.x) FILTER (o.i < q.r AND o.i >= q.i)) AS prom FROM lim q JOIN fall o ON o.window_id = q.window_id AND o.peak = q.peak GROUP BY q.window_id, q.peak, q.i, q.x, q.base, q.top),
  di AS (SELECT window_id, peak, min_by((x - base) / (top - base + 1e-8), i) AS dic FROM bump WHERE prom >= 0.03::DOUBLE * (abs(top - base) + 1e-8) GROUP BY ALL),
  p AS (SELECT window_id, peak, max(nx) AS nx, max(top) - max(base) AS amplitude, coalesce(sum((x + x2) / 2 - base) FILTER (i < peak), 0.0) AS area, max(x2 - x) FILTER (i < peak) AS slope, peak - max(foot) AS rise, count(*) FILTER (i < nx AND x >= base + (top - base) / 2) AS wide FROM n GROUP BY window_id, peak),
  p2 AS (SELECT p.*, CASE WHEN nx > p.peak + 2 THEN wide END AS half_width, CASE WHEN nx > p.peak + 2 THEN coalesce(dic, 0) END AS dicrotic, amplitude - lag(amplitude) OVER (PARTITION BY p.window_id ORDER BY p.peak) AS step, row_number() OVER (PARTITION BY p.window_id ORDER BY p.peak DESC) AS last FROM p LEFT JOIN di ON di.window_id = p.window_id AND di.peak = p.peak),
  sd AS (SELECT window_id, stddev_pop(x) AS sd FROM fx_windows GROUP BY window_id),
  f AS (SELECT p2.window_id, count(*) AS pulses, avg(amplitude) AS amplitude, avg(rise) AS rise, avg(area) AS area, avg(slope) AS slope, avg(half_width) AS half_width, avg(dicrotic) AS dicrotic, CASE WHEN count(*) > 1 THEN avg(amplitude) FILTER (last <= 2) / (avg(amplitude) + 1e-8) END AS last_vs_all, CASE WHEN count(*) > 1 THEN sqrt(avg(step * step)) END AS amp_rmssd, CASE WHEN count(*) > 1 THEN avg(amplitude) / (max(sd) + 1e-8) END AS perfusion FROM p2 JOIN sd USING (window_id) GROUP BY p2.window_id)
  SELECT window_id, pulses, {_r('amplitude', 'rise', 'area', 'slope', 'half_width', 'dicrotic', 'last_vs_all', 'amp_rmssd', 'perfusion')} FROM f""")
def pulse_morphology(spark, d):
    w = fx.windows(spark, d)
    return rounded(ft.pulse_morphology(bt.feet(_peaks(spark, d), w, ["window_id"]), w, "window_id", 12, 2, 1), "window_id")


@query("alarm_detectors", f"""WITH {_RR}, h AS (SELECT *, 60 / rr AS hr, CASE WHEN count(rr) OVER w = 5 THEN 60 / avg(rr) OVER w END AS roll FROM rr WHERE rr > 0 WINDOW w AS (PARTITION BY record_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  SELECT record_id, round(max(rr), 5) AS longest, max(rr) > 100 AS asystole, round(min(roll), 5) AS roll_min, round(max(roll), 5) AS roll_max, count(*) FILTER (hr > 10) AS n_fast, count(*) FILTER (hr < 1) AS n_slow FROM h GROUP BY record_id""")
def alarm_detectors(spark, d):
    return rounded(ft.alarm_detectors(kind(spark, d, "ecg"), "record_id", 100.0, 1.0, 10.0), "record_id")


_MID = (START + END) / 2


@query("hr_in_range", f"WITH {_RR}, b AS (SELECT record_id, t, t - lag(t) OVER (PARTITION BY record_id ORDER BY t) AS q FROM bs WHERE t >= {_MID}::DOUBLE AND t < {END}::DOUBLE) SELECT record_id, round(count(*) * (60.0::DOUBLE / {END - _MID}::DOUBLE), 5) AS hr_count, round(60 / nullif(median(q), 0), 5) AS hr_median FROM b GROUP BY record_id")
def hr_in_range(spark, d):
    return rounded(ft.hr_in_range(kind(spark, d, "ecg"), "record_id", _MID, END), "record_id")


@query("agreement_features", "WITH c AS (SELECT record_id, kind, count(*) AS n, max(t) AS last, 60 / nullif(median(rr), 0) AS hr FROM (SELECT record_id, kind, t, t - lag(t) OVER (PARTITION BY record_id, kind ORDER BY t) AS rr FROM (SELECT DISTINCT record_id, kind, t_h AS t FROM fx_beats)) GROUP BY ALL) SELECT e.record_id, round(abs(e.hr - p.hr), 5) AS hr_gap, round(p.n::DOUBLE / e.n, 5) AS beat_ratio, e.n - p.n AS beat_diff, round(e.last - p.last, 5) AS gap_diff FROM c e JOIN c p ON p.record_id = e.record_id AND e.kind = 'ecg' AND p.kind = 'pulse'")
def agreement_features(spark, d):
    def one(name):
        rr = ft.intervals(kind(spark, d, name), "record_id")
        return rr.groupBy("record_id").agg(F.count("*").alias(f"n_{name}"), F.max("t").alias(f"last_{name}"), (F.lit(60.0) / F.nullif(F.percentile("rr", 0.5), F.lit(0.0))).alias(f"hr_{name}"))

    both = one("ecg").join(one("pulse"), "record_id")
    return rounded(both.select("record_id", F.abs(F.col("hr_ecg") - F.col("hr_pulse")).alias("hr_gap"), (F.col("n_pulse") / F.col("n_ecg")).alias("beat_ratio"), (F.col("n_ecg") - F.col("n_pulse")).alias("beat_diff"), (F.col("last_ecg") - F.col("last_pulse")).alias("gap_diff")), "record_id")


@query("alarm_onehot", "SELECT record_id, seed, " + ", ".join(f"(alarm_type = '{v}')::INT AS is_{k}" for k, v in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))) + " FROM fx_alarms")
def alarm_onehot(spark, d):
    return fx.alarms(spark, d).select("record_id", "seed", *ft.one_hot(F.col("alarm_type"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]))


@query("category_ids", "WITH c AS (SELECT DISTINCT lead_signature, (dense_rank() OVER (ORDER BY lead_signature) - 1)::INT AS id FROM fx_alarms) SELECT record_id, seed, a.lead_signature, id FROM fx_alarms a JOIN c USING (lead_signature)")
def category_ids(spark, d):
    return ft.category_ids(fx.alarms(spark, d).select("record_id", "seed", "lead_signature"), "lead_signature")
