"""Correlation by transform against sums over pairs of samples."""

import numpy as np
from wavemill.operators import features as ft


def test_lag_products(spark):
    rng = np.random.default_rng(9)
    held, rows = {}, {"a": [], "b": []}
    for k, n in enumerate((1, 2, 7, 64, 300)):
        for side in rows:
            at = sorted(rng.choice(np.arange(5, 5 + n + 3), n, replace=False).tolist()) if k != 3 else list(range(n))
            x = rng.normal(size=n) if k != 2 else np.ones(n)
            held[side, k] = dict(zip(at, (x - x.mean()) / (x.std() + 1e-8)))
            rows[side] += [(k, int(i), float(v)) for i, v in zip(at, x)]
    a, b = (spark.createDataFrame(rows[s], "w int, i int, x double").repartition(3) for s in "ab")
    lags = [-400, -9, -1, 0, 1, 2, 30, 63, 64]
    got = {(r.w, r.lag): r.c for r in ft.lag_products(a, b, "w", lags).collect()}
    want = {}
    for k in range(5):
        for lag in lags:
            pairs = [(v, held["b", k][i + lag]) for i, v in held["a", k].items() if i + lag in held["b", k]]
            if pairs:
                want[k, lag] = sum(x * y for x, y in pairs) / len(held["a", k])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
