import numpy as np
from wavemill.llm import pivot_index


def _brute(rows, threshold=0.93):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links, up = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, v, p) in enumerate(ok):
        for j, w, q in ok[a + 1 :]:
            if p == q and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (links[i], root(i), root(i) == i) for i, *_ in rows}


def _rows(seed, near):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(300):
        base = rng.normal(size=24)
        rows.append((10 * k, base.astype(np.float32).tolist(), k % 3))
        for c in range(1, int(rng.integers(1, 4))):
            side = rng.normal(size=24)
            side -= side @ base / (base @ base) * base
            side *= np.linalg.norm(base) / np.linalg.norm(side)
            t = rng.uniform(*near)
            rows.append((10 * k + c, (t * base + np.sqrt(1 - t * t) * side).astype(np.float32).tolist(), k % 3))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)


def test_copies_hot_group_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = _rows(2, (0.97, 1.0))
    centre = rng.normal(size=24)
    rows += [(10_000 + k, (centre + 0.02 * rng.normal(size=24)).astype(np.float32).tolist(), 1) for k in range(700)]
    rows += [(20_000 + k, centre.astype(np.float32).tolist(), 1) for k in range(50)]
    nan = float("nan")
    odd = [None, [], [0.0] * 24, [None] * 24, [nan] * 24, [float("inf")] + [1.0] * 23, [1.0], [1.0]]
    rows += [(30_000 + k, v, 1) for k, v in enumerate(odd)] + [(40_000, centre.tolist(), None), (40_001, centre.tolist(), 2)]
    got = {r.vec_id: tuple(r)[1:] for r in pivot_index.near_vectors(_frame(spark, rows)).collect()}
    assert got == _brute(_frame(spark, rows).collect())


def test_recall_just_above_the_threshold(spark):
    rows = _rows(3, (0.931, 0.94))
    truth = _brute(_frame(spark, rows).collect())
    got = {r.vec_id: r.n_links for r in pivot_index.near_vectors(_frame(spark, rows)).collect()}
    assert all(got[i] <= truth[i][0] for i in truth)
    assert sum(got.values()) >= 0.97 * sum(n for n, *_ in truth.values())


def test_empty(spark):
    assert pivot_index.near_vectors(_frame(spark, [])).count() == 0
