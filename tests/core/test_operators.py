"""Operator behaviour on small synthetic tables, numpy brute force for the kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavemill.functions import kernels as kn
from wavemill.operators import beats as bt
from wavemill.operators import metrics as m
from wavemill.operators import models as md
from wavemill.operators import perturb as pb
from wavemill.operators import safety as sf_
from wavemill.operators import signals as sg
from wavemill.operators import splits as sp
from wavemill.operators import stats as st


def _window(spark, *signals):
    return spark.createDataFrame([(k, i, float(v)) for k, x in enumerate(signals) for i, v in enumerate(x)], "window_id long, i int, x double")


def test_operating_points_example(spark):
    rows = [("val", y, p) for y, p in zip([1, 1, 1, 0, 0, 0], [0.9, 0.8, 0.4, 0.3, 0.2, 0.1])] + [("test", y, p) for y, p in zip([1, 1, 0, 0], [0.5, 0.35, 0.45, 0.05])]
    ops = {r.op: r for r in m.operating_points(spark.createDataFrame(rows, "role string, y int, prob double").withColumn("k", F.lit(1)), ["k"]).collect()}
    assert ops["s100"].threshold == 0.4 and ops["s100"].fn == 1
    assert ops["t50"].tp == 1


def test_score_and_holm_examples(spark):
    row = spark.createDataFrame([(10, 0, 10, 2)], "tp long, fp long, tn long, fn long").select(m.challenge_score().alias("s")).first()
    assert round(row.s, 2) == 66.67
    got = {r.n: r.holm for r in st.holm(spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "n int, p double"), [], "p", "n").collect()}
    assert math.isclose(got[1], 0.04) and got[1] <= got[3] <= got[2] <= got[4] == 1.0


def test_auc_and_spearman_brute_force(spark):
    rng = np.random.default_rng(0)
    p, y = np.round(rng.random(200), 1), rng.integers(0, 2, 200)
    rows = spark.createDataFrame([(1, float(a), int(b)) for a, b in zip(p, y)], "k int, prob double, y int")
    pos, neg = p[y == 1], p[y == 0]
    expected = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    assert math.isclose(m.auc(rows, ["k"]).first().auc, expected)
    assert m.auc(rows.where("y = 1"), ["k"]).first().auc is None


def test_quality_of_flat_and_clipped_signals(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(size=1000)
    clipped = np.where(np.arange(1000) % 2, 1.0, np.clip(noise, -0.9, 0.9))
    q = {r.window_id: r for r in sg.signal_quality(_window(spark, np.full(1000, 3.0), clipped, noise), ["window_id"]).collect()}
    assert q[0].flat == 1.0 and q[1].clip > 0.4 and q[2].quality > 0.9


def test_interpolation(spark):
    x = [math.sin(k / 7) for k in range(200)]
    rows = spark.createDataFrame([(1, k, None if k in (5, 6, 7, 100, 199) else v) for k, v in enumerate(x)], "window_id long, i int, x double")
    got = [r.x for r in sg.interpolate_gaps(rows, ["window_id"]).orderBy("i").collect()]
    keep = [k for k in range(200) if k not in (5, 6, 7, 100, 199)]
    assert np.allclose(got, np.interp(range(200), keep, [x[k] for k in keep]))


def test_splits_hold(spark):
    rng = np.random.default_rng(2)
    rows = [(r, f"{r}-{w}", int(rng.integers(0, 2))) for r in range(30) for w in range(int(rng.integers(1, 5)))]
    frame = spark.createDataFrame(rows, "record_id long, window_id string, y int")
    splits = sp.iter_splits(frame, "record_id", 2, 5, 0.15)
    assert sp.leak_check(splits, "record_id").count() == 0 and splits.count() == 30 * 5 * 2
    assert sp.leak_check(splits.unionByName(splits.withColumn("role", F.lit("fit"))), "record_id").count() > 0
    sizes = [r["count"] for r in sp.group_folds(frame, "record_id", 5).groupBy("fold").count().collect()]
    assert sizes == [6] * 5


def test_beat_matching_example(spark):
    beats = lambda t: spark.createDataFrame([(1, float(x)) for x in t], "record_id long, t double")
    ref, det = beats([100, 300, 500]), beats([105, 310, 900])
    r = bt.match_greedy(ref, det, "record_id", 30.0).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1)
    assert bt.match_mutual(ref, det, "record_id", 30.0).count() == 2
    assert [r.ptt for r in bt.per_beat(ref, det, "record_id", 1, 20).orderBy("t").collect()] == [5.0, 10.0, None]


def test_suppression_and_maxima(spark):
    x = [0, 1, 0, 3, 3, 3, 0, 2, 0, 5, 0]
    peaks = bt.local_maxima(_window(spark, x), ["window_id"])
    assert sorted((r.i, r.x) for r in peaks.collect()) == [(1, 1.0), (4, 3.0), (7, 2.0), (9, 5.0)]
    assert sorted(r.i for r in bt.suppress_exact(peaks, ["window_id"], 4).collect()) == [4, 9]


def test_clopper_pearson_and_student():
    assert math.isclose(kn.cp_upper(0, 10, 0.9), 1 - 0.1**0.1, rel_tol=1e-9)
    assert kn.cp_upper(10, 10, 0.9) == 1.0
    for n, k in ((20, 1), (50, 3), (200, 12)):  # the bound's own binomial tail is 1 - confidence
        u = kn.cp_upper(k, n, 0.9)
        tail = sum(math.comb(n, j) * u**j * (1 - u) ** (n - j) for j in range(k + 1))
        assert math.isclose(tail, 0.1, rel_tol=1e-6)
    assert math.isclose(kn.t_p_value(2.0, 10), 0.0733880347, rel_tol=1e-6)


def test_risk_threshold_certifies(spark):
    rng = np.random.default_rng(3)
    p = np.sort(rng.random(120))
    rows = spark.createDataFrame([(1, 1, float(v)) for v in p] + [(2, 1, 0.5)] * 3, "k int, y int, prob double")
    got = {r.k_: r for r in sf_.risk_threshold(rows.withColumnRenamed("k", "k_"), ["k_"], 0.1, 0.1).collect()}
    best = max(k for k in range(120) if kn.cp_upper(k, 120, 0.9) <= 0.1)
    assert got[1].k == best and math.isclose(got[1].t_low, p[best]) and got[2].t_low is None


def test_temperature_recovers_a_known_scale(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=3000) * 2
    y = (rng.random(3000) < 1 / (1 + np.exp(-z))).astype(int)
    rows = spark.createDataFrame([(1, int(b), float(1 / (1 + np.exp(-3 * a)))) for a, b in zip(z, y)], "k int, y int, prob double")
    assert abs(math.exp(sf_.temperature_fit(rows, ["k"]).first().log_t) - 3) < 0.5


def test_band_pass_and_wavelets():
    t = np.arange(500) / 250
    slow, mid, fast = (np.sin(2 * np.pi * f * t) for f in (0.2, 5, 100))
    out = kn.band_pass(slow + mid + fast, 250, 0.5, 40)
    assert np.corrcoef(out[100:400], mid[100:400])[0, 1] > 0.98
    e = kn.wavelet_energy(np.random.default_rng(0).normal(size=256), 4)
    assert math.isclose(sum(v for k, v in e.items() if k != "entropy"), 1.0)
    c = kn.coherence(mid, mid + 0.01 * fast, 250, 128, 1, 20)
    assert c["coh_mean"] > 0.9 and c["df"] == 0


def test_failing_kernels_give_null(spark):
    def bad(x):
        if x[0] > 0:
            raise ValueError("no")
        return {"v": float("inf") if x[1] > 0 else 1.0}

    got = {r.window_id: r.v for r in kn.per_window(_window(spark, [1, 0], [0, 1], [0, 0]), "window_id", bad, ["v"]).collect()}
    assert got == {0: None, 1: None, 2: 1.0}


def test_noise_hits_the_snr_and_inputs_stay(spark):
    x = np.sin(np.arange(64) / 3)
    noise = spark.createDataFrame([("n", i, float(v)) for i, v in enumerate(np.random.default_rng(1).normal(size=300))], "channel string, i long, v double")
    out = np.array([r.x for r in pb.noise_snr(_window(spark, x), noise, "window_id", 64, 0.0).orderBy("i").collect()])
    assert abs(out.mean()) < 1e-6 and abs(out.std() - 1) < 1e-3 and 0.4 < np.corrcoef(out, x)[0, 1] < 0.95
    for kind, f in pb.PERTURBATIONS.items():
        assert f(_window(spark, x), "window_id", 64).count() == 64, kind
    y = np.array([r.x for r in pb.phase_scramble(_window(spark, x), "window_id").orderBy("i").collect()])
    assert np.allclose(abs(np.fft.rfft(y)), abs(np.fft.rfft(x)), atol=1e-8) and not np.allclose(x, y)


@pytest.mark.parametrize("name", ["logreg", "rf", "boost", "mlp", "svc"])
def test_classifiers_beat_chance(spark, name):
    rng = np.random.default_rng(6)
    rows = [(k, int(a + b > 0), float(a), float(b) if k % 9 else None, "fit" if k % 3 else "test", 0) for k, (a, b) in enumerate(rng.normal(size=(240, 2)))]
    frame = md.prep_pipeline(spark.createDataFrame(rows, "id int, y int, a double, b double, role string, fold int"), ["a", "b"], ["fold"]).coalesce(2)
    preds = md.predict_fold(md.fit_fold(frame, ["a", "b"], name), frame, ["a", "b"], ["id"])
    assert m.auc(preds.withColumn("k", F.lit(1)), ["k"]).first().auc > 0.8
