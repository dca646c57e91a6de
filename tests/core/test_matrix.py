"""The 53 columns against numpy, window by window."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavemill.operators import matrix as mx

N, FS, DISTANCE = 64, 8.0, 3


def _beats(x):
    up = [i for i in range(1, len(x) - 1) if x[i] > x[i - 1] and x[i] > x[i + 1]]
    kept = []
    for i in sorted(up, key=lambda i: (x[i], i), reverse=True):
        if all(abs(i - j) >= DISTANCE for j in kept):
            kept.append(i)
    return np.array(sorted(kept), int)


def _rate(p, name):
    rr = np.diff(p) / FS
    two = len(p) >= 2
    values = (
        len(p), (p >= N - 5 * FS).sum(), 60 / np.median(rr) if two else 0, rr.std() / (rr.mean() + 1e-8) if two else 0, rr.max() if two else N / FS, rr.min() if two else N / FS,
        np.sqrt((np.diff(rr) ** 2).mean()) if len(rr) > 1 else 0, (abs(rr - np.median(rr)) > 0.2 * np.median(rr)).mean() if two else 1, (N - (p[-1] if len(p) else 0)) / FS, np.diff(np.concatenate(([0], p, [N]))).max() / FS,
    )
    return {f"{name}_{k}": float(v) for k, v in zip("n n_last5s hr rr_cv rr_max rr_min rmssd irregular_frac gap_to_end longest_gap".split(), values)}


def _quality(x, name, low, high):
    p = abs(np.fft.rfft(x - x.mean())) ** 2
    p, f = p / (p.sum() + 1e-12), np.arange(len(p)) * FS / N
    z = (x - x.mean()) / x.std() if x.std() else np.full(N, np.nan)
    values = (z**4).mean() - 3, (z**3).mean(), -(p * np.log(p + 1e-12)).sum() / np.log(len(p)), p[(f >= low) & (f <= high)].sum(), p[f < 0.5].sum(), p[f > 0.46 * FS].sum(), (abs(np.diff(x)) < 1e-3).mean()
    return {f"{name}_{k}": v for k, v in zip("kurt skew spec_entropy inband_power lowf_power highf_power flat_frac".split(), values)}


def _template(x, p, name, half):
    cut = np.array([x[i - half : i + half] for i in p if i >= half and i + half <= N])
    c = [0.0] if len(cut) < 3 else np.nan_to_num([np.corrcoef(b, np.median(cut, 0))[0, 1] for b in cut])
    return {f"{name}_tmpl_corr": np.mean(c), f"{name}_tmpl_corr_min": np.min(c)}


def _normal(x):
    return (x - x.mean()) / (x.std() + 1e-8)


def _period(x, name):
    z = _normal(x)
    return {f"{name}_acf_peak": max((z[: N - k] * z[k:]).sum() / N for k in range(2, 12))}


def _expected(ecg, pulse):
    r, p = _beats(ecg), _beats(pulse)
    starts = [0, *p[:-1]]
    ft = np.array([a + int(np.argmin(pulse[a : b + 1])) for a, b in zip(starts, p)])
    out = _rate(r, "ecg") | _rate(p, "ppg") | _quality(ecg, "ecg", 0.8, 2.4) | _quality(pulse, "ppg", 0.16, 0.8) | _template(ecg, r, "ecg", 2) | _template(pulse, p, "ppg", 3) | _period(ecg, "ecg") | _period(pulse, "ppg")

    def delays(beats):
        found = [[d for d in (ft - b) / FS if 0.08 <= d <= 0.6] for b in beats]
        return np.array([min(d) for d in found if d])

    d, recent = delays(r), delays(r[-6:])
    top = abs(ecg[r])
    out |= {
        "ecg_amp_cv": top.std() / (top.mean() + 1e-8) if len(r) else 0, "hr_abs_diff": abs(out["ecg_hr"] - out["ppg_hr"]), "beat_count_ratio": (len(r) + 1) / (len(p) + 1), "beat_count_last5s_diff": out["ecg_n_last5s"] - out["ppg_n_last5s"],
        "ecg_beats_with_pulse_frac": len(d) / max(len(r), 1), "recent_beats_with_pulse_frac": len(recent) / max(min(len(r), 6), 1), "ptt_mean": d.mean() if len(d) else -1, "ptt_std": d.std() if len(d) > 1 else -1,
        "ptt_median": np.median(d) if len(d) else -1, "ptt_cv": d.std() / (d.mean() + 1e-8) if len(d) > 1 else -1, "ppg_peaks_with_r_frac": np.mean([any(0.1 < (q - b) / FS < 0.9 for b in r) for q in p]) if len(p) else 0,
    }
    train = np.array([sum(np.exp(-((i - b) ** 2) / 0.5) for b in r if abs(i - b) <= 1) for i in range(N)], float)
    a, b = _normal(train), _normal(pulse)
    found = [round(float((a[: N - k] * b[k:]).sum() / (N - k)), 9) for k in range(6)]
    return out | {"xcorr_peak": max(found), "xcorr_lag_s": found.index(max(found)) / FS}


@pytest.fixture(scope="module")
def windows():
    rng = np.random.default_rng(6)
    t = np.arange(N) / FS
    out = [(rng.normal(size=N), rng.normal(size=N)) for _ in range(12)]
    out += [(np.sin(2 * np.pi * 1.1 * t), np.sin(2 * np.pi * 1.1 * (t - 0.3))), (np.zeros(N), rng.normal(size=N)), (rng.normal(size=N), np.ones(N)), (t, t[::-1].copy()), (np.round(rng.normal(size=N)), np.round(rng.normal(size=N)))]
    return out


def test_equals_numpy(spark, windows):
    rows = [(k, c, i, float(v)) for k, pair in enumerate(windows) for c, x in enumerate(pair) for i, v in enumerate(x)]
    rows += [(98, 0, i, 1.0) for i in range(N)] + [(99, c, i, 1.0) for c in (0, 1) for i in range(9)]  # one channel; too short
    long = spark.createDataFrame(rows, "rec int, c int, i int, x double").repartition(6)
    out = mx.feature_matrix(mx.pack(long, "rec", F.col("c")), "rec", N, FS, DISTANCE)
    assert len(out.columns) == 54
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate [") == 1 and "Python" not in plan
    got = {r.rec: r.asDict() for r in out.collect()}
    assert set(got) == {*range(len(windows)), 98, 99} and all(v is None for k in (98, 99) for c, v in got[k].items() if c != "rec")
    for k, pair in enumerate(windows):
        want = _expected(*pair)
        assert set(want) == set(got[k]) - {"rec"}
        for c, v in want.items():
            assert (got[k][c] is None and not np.isfinite(v)) or got[k][c] == pytest.approx(v, rel=1e-6, abs=1e-6), (k, c)
