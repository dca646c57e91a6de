"""Batched logistic regressions against one model fitted alone in numpy."""

import numpy as np
import pytest
from wavemill.operators import batched as bt
from wavemill.sources.tables import stored


def _alone(x, y, penalty, balanced):
    """Gradient descent with backtracking on standardised features; slow and plain."""
    mean, scale = x.mean(0), x.std(0)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    ridge = np.append(np.full(x.shape[1], penalty), 0.0)
    value = lambda b: (w * (np.logaddexp(0, z @ b) - y * (z @ b))).sum() + 0.5 * (ridge * b * b).sum()
    b, rate = np.zeros(z.shape[1]), 1.0
    for _ in range(20000):
        g = z.T @ (w * (1 / (1 + np.exp(-(z @ b))) - y)) + ridge * b
        if np.abs(g).max() < 1e-9:
            break
        while value(b - rate * g) > value(b) - 0.3 * rate * (g @ g) and rate > 1e-12:
            rate /= 2
        b, rate = b - rate * g, rate * 1.5
    return np.append(b[:-1] / scale, b[-1] - (b[:-1] / scale * mean).sum())


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [0, 1000, 3]
    y = (x[:, 0] + (x[:, 1] - 1000) / 50 + rng.normal(size=n) > 0.7).astype(int)
    rows = [(k, k % 2, *map(float, x[k]), int(y[k]), [int(rng.integers(0, 3)), int(rng.integers(-1, 2))], "val" if k % 5 == 0 else "fit") for k in range(n)]
    return stored(spark.createDataFrame(rows, "id int, fold int, a double, b double, c double, y int, parts array<int>, role string").repartition(5)), rows


FITS = [bt.Fit(0, 1, 0, 1.0, True), bt.Fit(0, 2, 0, 10.0, False), bt.Fit(1, 0, 1, 1e-2, True), bt.Fit(1, 1, 1, 100.0, False), bt.Fit(7, 0)]


def test_each_model_equals_one_fitted_alone(table):
    df, rows = table
    fitted = bt.logistic_fits(df, ["a", "b", "c"], FITS)
    for k, f in enumerate(FITS[:-1]):
        own = [r for r in rows if r[1] == f.group and r[6][f.repeat] not in (f.held, -1)]
        want = _alone(np.array([r[2:5] for r in own]), np.array([r[5] for r in own]), f.penalty, f.balanced)
        assert np.allclose(fitted.coef[k], want, rtol=1e-4, atol=1e-5) and fitted.rows[k].tolist() == [len(own), sum(r[5] for r in own)]
    assert not fitted.coef[-1].any() and fitted.steps < 30  # no row of that group
    got = {(r.model, r.id): r.prob for r in bt.score_held(df, fitted, ["id"]).collect()}
    want = {(k, r[0]): 1 / (1 + np.exp(-(np.dot(r[2:5], fitted.coef[k, :-1]) + fitted.coef[k, -1]))) for k, f in enumerate(FITS) for r in rows if r[1] == f.group and r[6][f.repeat] == f.held}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_separable_classes_and_single_class_end(spark):
    rows = [(k, 0, float(k), int(k > 50), [k % 2]) for k in range(100)] + [(k, 1, float(k), 1, [k % 2]) for k in range(10)]
    df = stored(spark.createDataFrame(rows, "id int, fold int, a double, y int, parts array<int>"))
    fitted = bt.logistic_fits(df, ["a"], [bt.Fit(0, 1, penalty=1e-4), bt.Fit(1, 1)])
    assert fitted.coef[0, 0] > 0 and not fitted.coef[1].any() and fitted.steps < 60


def test_search_takes_the_first_best(spark, table):
    df, _ = table
    rows = stored(bt.by_role(df))
    configs = bt.drawn_configs(spark, 12)
    assert len(set(configs)) == 12 and all(1e-4 <= c <= 10 for c, _ in configs) and configs == bt.drawn_configs(spark, 12)
    preds, trace = bt.search_val_auc(rows, ["a", "b", "c"], configs, [0, 1], ["fold", "id"])
    held = {(r.fold, r.config): r.auc for r in trace.collect()}
    assert len(held) == 24
    for fold in (0, 1):
        best = max(range(12), key=lambda k: (round(held[fold, k], 12), -k))
        assert {r.config for r in preds.where(f"fold = {fold}").select("config").distinct().collect()} == {best}
    assert preds.count() == df.where("role = 'val'").count()
