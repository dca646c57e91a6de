"""Exact quantiles, suppression by runs and matching by chains against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavemill.functions.quantiles import exact_quantiles
from wavemill.operators import beats as bt
from wavemill.operators.perturb import noise_snr
from wavemill.plans import catalog


@pytest.mark.parametrize("range_rows,cuts", [(10**6, 255), (20, 4), (1, 2), (1, 1)])
def test_quantiles(spark, range_rows, cuts):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(600):
        a = [float(rng.normal()), float(rng.integers(0, 3)), float(rng.choice([5.0, 5.0, 5.0, 5.0, rng.normal() * 1e200])), None, math.nan][rng.integers(0, 5) if k % 7 == 0 else k % 3]
        rows.append(([None, "x", "y"][k % 3], a, float(k) if k % 3 else None))
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(4)
    probs = [0.0, 0.005, 1 / 3, 0.5, 0.9, 1.0]
    got = {r.g: r for r in exact_quantiles(df, ["a", "b"], probs, ["g"], range_rows, cuts).collect()}
    assert set(got) == {None, "x", "y"} and got[None].q_b is None
    for g in got:
        for c, k in (("q_a", 1), ("q_b", 2)):
            held = [r[k] for r in rows if r[0] == g and r[k] is not None and not math.isnan(r[k])]
            if held:
                assert np.allclose(got[g][c], np.percentile(held, [100 * p for p in probs]), rtol=1e-12)
    one = exact_quantiles(df, ["b"], [0.25], None, range_rows, cuts).collect()
    assert len(one) == 1 and one[0].q_b == [np.percentile([r[2] for r in rows if r[2] is not None], 25)]
    assert exact_quantiles(df.where("false"), ["a"], [0.5]).count() == 0


@pytest.mark.parametrize("name", ["terciles", "quality_stratified", "rule_annotations", "prep_pipeline"])
def test_no_whole_column_in_one_buffer(spark, sf, name):
    assert "percentile(" not in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().analyzed().toString()


def _highest_first(peaks, distance):
    kept = []
    for v, i in sorted(((v, i) for i, v in peaks), reverse=True):
        if all(abs(i - j) >= distance for j, _ in kept):
            kept.append((i, v))
    return sorted(kept)


@pytest.mark.parametrize("run_peaks", [0, 3, 64])
def test_suppression_by_runs(spark, monkeypatch, run_peaks):
    monkeypatch.setattr(bt, "RUN_PEAKS", run_peaks)
    rng = np.random.default_rng(run_peaks)
    rows = [(r, int(i), float(rng.integers(0, 6))) for r in range(8) for i in sorted(rng.choice(300, 90, replace=False))]
    got = bt.suppress_exact(spark.createDataFrame(rows, "rec int, i long, x double"), ["rec"], 6).collect()
    for r in range(8):
        assert sorted((g.i, g.x) for g in got if g.rec == r) == _highest_first([(i, x) for k, i, x in rows if k == r], 6)


def _in_order(ref, det, tolerance):
    free, tp = sorted(det), 0
    for t in sorted(ref):
        near = min(free, key=lambda u: (abs(u - t), u), default=None)
        if near is not None and abs(near - t) <= tolerance:
            free.remove(near)
            tp += 1
    return tp, len(free), len(ref) - tp


@pytest.mark.parametrize("chain_beats", [0, 4, 64])
def test_matching_by_chains(spark, monkeypatch, chain_beats):
    monkeypatch.setattr(bt, "CHAIN_BEATS", chain_beats)
    rng = np.random.default_rng(chain_beats)
    sides = {r: [sorted(rng.integers(0, 400, rng.integers(0, 60)).astype(float).tolist()) for _ in range(2)] for r in range(9)}
    ref, det = (spark.createDataFrame([(r, t) for r, s in sides.items() for t in s[k]], "rec int, t double") for k in (0, 1))
    got = {r.rec: (r.tp, r.fp, r.fn) for r in bt.match_greedy(ref, det, "rec", 3.0).collect()}
    assert got == {r: _in_order(*s, 3.0) for r, s in sides.items() if s[0] or s[1]}


def test_samples_meet_their_own_buckets(spark):
    rng = np.random.default_rng(2)
    rows = spark.range(3000).select((F.col("id") % 3).alias("rec"), F.floor(F.col("id") / 3).alias("i"), F.rand(1).alias("x"))
    spans = [(int(rng.integers(0, 3)), k, int(a), int(a + rng.integers(0, 600))) for k, a in enumerate(rng.integers(-50, 1000, 40))]
    got = bt.samples_of(spark.createDataFrame(spans, "rec long, k int, _a long, _z long"), rows, ["rec"])
    counts = {r.k: r["count"] for r in got.groupBy("k").count().collect()}
    assert counts == {k: n for _, k, a, z in spans if (n := min(z, 999) - max(a, 0) + 1) > 0}


@pytest.mark.parametrize("join", ["noise", "refine", "feet"])
def test_joins_name_a_bucket(spark, join):
    rows = spark.range(100).select(F.lit(1).alias("rec"), F.col("id").alias("i"), F.rand(1).alias("x"))
    if join == "noise":
        out = noise_snr(rows, rows.select(F.lit("c").alias("channel"), "i", F.col("x").alias("v")), "rec", 10, 6.0)
    else:
        out = bt.refine(rows.select("rec", "i"), rows, ["rec"], 3) if join == "refine" else bt.feet(rows.where("i % 9 = 0").select("rec", "i"), rows, ["rec"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert any(("bucket" in line or "_b#" in line) and "Join Inner" in line for line in plan.splitlines())
