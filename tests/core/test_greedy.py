"""Forward selection: against brute force, with members that are missing, doubled or without a score, and its passes."""

import numpy as np
from wavemill.operators import ensemble as en

SCHEMA = "seed int, fold int, role string, record_id long, variant string, prob double, y int"


def _rows(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for record in range(60):
        y = int(rng.integers(0, 2))
        for v, noise in zip("ABCD", (0.6, 0.6, 0.7, 3.0)):
            prob = None if rng.random() < 0.05 else int(64 * (0.3 * y + noise * rng.random())) / 64
            for _ in range(1 + (rng.random() < 0.05) - (rng.random() < 0.1)):
                rows.append((record % 2, record % 3, "val" if record % 10 else "test", record, v, prob, y))
    return rows


def _brute(rows, rounds, gain=1e-9):
    val = [(r[:2] + (r[3],), r[4], r[5], r[6]) for r in rows if r[2] == "val"]
    chosen, best = [], -1.0
    while len(chosen) < rounds:
        sums = {}
        for key, v, p, _ in val:
            sums[key] = sums.get(key, 0.0) + chosen.count(v) * (p or 0.0)
        found = {}
        for v in sorted({r[1] for r in val}):
            cells = {}
            for key, own, p, y in val:
                if own == v:
                    cells.setdefault(key[:2], []).append((-np.inf if p is None else (sums[key] + p) / (len(chosen) + 1), y))
            areas = []
            for cell in cells.values():
                pos, neg = ([p for p, y in cell if y == c] for c in (1, 0))
                if pos and neg:
                    areas.append(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)))
            found[v] = np.mean(areas)
        top = min(found, key=lambda v: (-found[v], v))
        if found[top] - best <= gain:
            break
        chosen.append(top)
        best = found[top]
    return chosen


def test_selection_equals_brute_force(spark):
    lengths = []
    for seed in (1, 2, 3):
        rows = _rows(seed)
        want = _brute(rows, 4)
        got = en.ens_greedy(spark.createDataFrame(rows, SCHEMA), 4)
        assert got == want
        lengths.append(len(want))
    assert max(lengths) > 1


def test_a_round_joins_and_moves_nothing(spark, monkeypatch):
    plans, auc = [], en.auc

    def seen(rows, by):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return auc(rows, by)

    monkeypatch.setattr(en, "auc", seen)
    en.ens_greedy(spark.createDataFrame(_rows(1), SCHEMA), 3)
    assert len(plans) > 1 and not any(word in plan for plan in plans for word in ("Join", "Exchange", "Aggregate"))
