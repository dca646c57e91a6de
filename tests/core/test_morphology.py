"""Shapes of beats and pulses, and sample entropy, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavemill.operators import features as ft


def _bump(x, skip, prominence):
    for k in range(skip + 1, len(x) - 1):
        if x[k] > x[k - 1] and x[k] > x[k + 1]:
            left, right = [j for j in range(k) if x[j] > x[k]], [j for j in range(k + 1, len(x)) if x[j] > x[k]]
            low = min(x[(left[-1] if left else -1) + 1 : k + 1])
            high = min(x[k : right[0] if right else len(x)])
            if x[k] - max(low, high) >= prominence:
                return x[k]
    return None


def test_first_bump(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in np.round(rng.normal(size=int(rng.integers(0, 14))).cumsum(), 1)]) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, x array<double>")
    got = {r.k: r.v for r in df.select("k", ft.first_bump(F.col("x"), 1, F.lit(0.5)).alias("v")).collect()}
    want = {k: _bump(x, 1, 0.5) for k, x in rows}
    assert got == want and sum(v is not None for v in want.values()) > 50


@pytest.fixture(scope="module")
def wave(spark):
    """Three pulses of rising height with a dicrotic bump, feet at 0, 20 and 40, peaks five samples later."""
    x = np.zeros(60)
    for n, height in enumerate((1.0, 2.0, 4.0)):
        at = 20 * n
        x[at : at + 6] = height * np.arange(6) / 5
        x[at + 6 : at + 20] = height * np.array([0.8, 0.6, 0.4, 0.3, 0.35, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.06, 0.03])
    rows = spark.createDataFrame([("w", k, float(v)) for k, v in enumerate(x)] + [("one", k, float(v)) for k, v in enumerate(x[:20])], "key string, i int, x double")
    feet = spark.createDataFrame([("w", 5, 0), ("w", 25, 20), ("w", 45, 40), ("one", 5, 0)], "key string, peak int, foot int")
    return rows, feet, x


def test_pulses(wave):
    rows, feet, x = wave
    got = {r.key: r for r in ft.pulse_morphology(feet, rows, "key", 30).collect()}
    w, one = got["w"], got["one"]
    assert w.pulses == 3 and w.amplitude == pytest.approx(7 / 3) and w.rise == 5
    assert w.dicrotic == pytest.approx(0.4, abs=1e-6) and w.half_width == pytest.approx(5)  # 0.6 and 0.8 rising, the peak, 0.8 and 0.6
    assert w.last_vs_all == pytest.approx(3 / (7 / 3)) and w.amp_rmssd == pytest.approx(math.sqrt((1 + 4) / 2)) and w.perfusion == pytest.approx(7 / 3 / x.std())
    assert one.pulses == 1 and one.last_vs_all is None and one.amp_rmssd is None and one.perfusion is None and one.dicrotic == pytest.approx(0.4, abs=1e-6)


def test_short_limbs_are_left_out(wave):
    rows, feet, _ = wave
    assert [(r.half_width, r.dicrotic) for r in ft.pulse_morphology(feet, rows, "key", 4).where("key = 'one'").collect()] == [(None, None)]


def test_beats(spark):
    x = np.zeros(80)
    x[[20, 50]] = 2.0, -4.0
    x[28], x[15], x[60], x[43] = 0.5, 0.2, 1.0, 0.4
    rows = spark.createDataFrame([("w", k, float(v)) for k, v in enumerate(x)], "key string, i int, x double")
    beats = spark.createDataFrame([("w", 20), ("w", 50)], "key string, i int")
    (got,) = ft.qrs_morphology(beats, rows, "key", 3, (5, 15, 4), (10, 3), 5).collect()
    assert got.beats == 2 and got.amplitude == 3.0 and got.t_ratio == pytest.approx((0.5 / 2 + 1.0 / 4) / 2) and got.p_ratio == pytest.approx((0.2 / 2 + 0.4 / 4) / 2) and got.last_vs_all == 1.0
    (alone,) = ft.qrs_morphology(beats.where("i = 20"), rows, "key", 3, (5, 8, 4), (10, 3), 5).collect()
    assert alone.t_ratio is None and alone.last_vs_all is None and alone.p_ratio == pytest.approx(0.1)


def test_triangular_index(spark):
    t = np.cumsum([0, 1, 1, 1, 1.5, 1.5, 2])
    rows = [("a", float(v)) for v in t] + [("flat", float(k)) for k in range(5)]
    got = {r.key: r.rr_tri for r in ft.hrv_features(spark.createDataFrame(rows, "key string, t double"), "key", 0.05, 0.02, 0.25).collect()}
    assert got == {"a": 2.0, "flat": None}


def _sampen(x, m=2, share=0.2):
    n, r = len(x), share * np.std(x)
    if n < m + 4:
        return None
    if np.std(x) < 1e-8:
        return 0.0
    t = np.array([x[k : k + m + 1] for k in range(n - m)])
    gap = np.abs(t[:, None] - t[None])
    up = np.triu(np.ones((n - m, n - m), bool), 1)
    b, a = (gap[..., :m].max(-1) <= r) & up, (gap.max(-1) <= r) & up
    return -math.log(a.sum() / b.sum()) if a.sum() else math.log(b.sum()) if b.sum() else None


@pytest.mark.parametrize("m", [1, 2])
def test_sample_entropy(spark, m):
    rng = np.random.default_rng(5)
    waves = {"noise": rng.normal(size=150), "steps": np.repeat([0.0, 1.0, 3.0], 40), "walk": rng.normal(size=120).cumsum(), "grid": rng.integers(0, 12, 200) * 0.1, "flat": np.ones(30), "short": rng.normal(size=4), "hot": np.where(rng.random(300) < 0.4, 0.0, rng.normal(size=300))}
    rows = spark.createDataFrame([(k, n, float(v)) for k, x in waves.items() for n, v in enumerate(x)], "key string, i int, x double")
    got = {r.key: r.sampen for r in ft.sample_entropy(rows, "key", m).collect()}
    for k, x in waves.items():
        want = _sampen(x, m)
        assert got[k] is None if want is None else got[k] == pytest.approx(want, abs=1e-9), k


def test_few_templates_meet(spark):
    n = 3000
    x = np.random.default_rng(6).normal(size=n)
    x[: n // 3] = 0.0  # a third of the samples repeat
    left, right = ft.template_cells(spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "key int, i int, x double"), "key", 2, 0.2)
    assert left.join(right, ["key", "g0", "g1"]).count() < n * n / 15
