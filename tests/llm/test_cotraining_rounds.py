"""Sums and rounds of the exchange against row-by-row numpy, on made feature rows."""

import numpy as np
from wavemill.llm import cotraining as co


def _rows(spark, labelled, n=400, seed=3):
    """The content view tells the classes apart by one figure, the metadata view by one noisy figure among many of noise."""
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 2, n)
    content, meta = np.zeros((n, co.CONTENT), np.float32), rng.normal(size=(n, co.METADATA)).astype(np.float32)
    content[:, 0] = 3.0 * (2 * truth - 1) + rng.normal(size=n)
    meta[:, 0] = 1.5 * (2 * truth - 1) + rng.normal(size=n)
    y = [int(t) if k < labelled else None for k, t in enumerate(truth)]
    data = [(y[k], k % 5, bytearray(content[k].tobytes()), bytearray(meta[k].tobytes())) for k in range(n)]
    return spark.createDataFrame(data, "y int, fold int, content binary, meta binary").repartition(3), truth, y, content.astype(float), meta.astype(float)


def test_sums_equal_single_rows(spark):
    rows, _, y, content, meta = _rows(spark, 40, 90)
    rng = np.random.default_rng(1)
    widths = (co.CONTENT, co.METADATA)
    views, teachers = ([rng.normal(size=w + 1) * 0.3 for w in widths] for _ in range(2))
    means, scales = [rng.normal(size=w) for w in widths], [rng.uniform(1, 2, w) for w in widths]
    for told in (None, teachers):
        want = []
        for k, table in enumerate((content, meta)):
            gradient, total, curvature = np.zeros(widths[k] + 1), 0.0, np.zeros((widths[k] + 1,) * 2)
            for r in range(len(y)):
                x = np.append((table[r] - means[k]) / scales[k], 1.0)
                target, weight = y[r], float(y[r] is not None)
                if told is not None and y[r] is None:
                    other = np.append(((meta, content)[k][r] - means[1 - k]) / scales[1 - k], 1.0) @ told[1 - k]
                    if abs(other) >= 1.0:
                        target, weight = int(other > 0), 0.2
                if weight:
                    p = 1 / (1 + np.exp(-np.clip(x @ views[k], -30, 30)))
                    gradient += weight * (target - p) * x
                    total += weight
                    curvature += weight * max(p * (1 - p), co.CURVATURE) * np.outer(x, x)
            want += [gradient, [total], curvature.ravel()]
        want = np.concatenate(want)
        got = co._summed(rows, co._newton_sums(views, told, means, scales, 1.0, 0.2), len(want))
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_exchange_lowers_the_loss(spark):
    rows, truth, y, _, meta = _rows(spark, 60)
    loss = []
    for rounds in (0, 3):
        model = co._co_train(rows, rounds, 2.5, 0.2, 6, 2, 5.0, 1e-4)
        view = model.views[1]
        z = (meta @ view.weights + view.bias)[len([v for v in y if v is not None]) :]
        t = truth[-len(z) :]
        loss.append(np.mean(np.log1p(np.exp(-np.where(t == 1, z, -z)))))
    assert loss[1] < loss[0]
