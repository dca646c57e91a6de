"""Bootstrap by weight vectors against numpy."""

import numpy as np
import pytest
from wavemill.operators import metrics as m
from wavemill.operators import stats as st
from wavemill.plans import catalog


@pytest.fixture(scope="module")
def tallies(spark):
    rng = np.random.default_rng(8)
    counts = rng.multinomial(1, [0.3, 0.15, 0.45, 0.1], size=(2, 3, 250))  # arms, seeds, records, cells
    rows = [("AB"[a], s, r, *map(int, counts[a, s, r])) for a in range(2) for s in range(3) for r in range(250)]
    return spark.createDataFrame(rows, "variant string, seed int, record_id long, tp int, fp int, tn int, fn int").repartition(5), counts


def _f1(c):
    return 2 * c[..., 0] / np.maximum(2 * c[..., 0] + c[..., 1] + c[..., 3], 1)


@pytest.mark.parametrize("rows", [1, 64, 512])
def test_sums_equal_numpy(tallies, monkeypatch, rows):
    df, counts = tallies
    monkeypatch.setattr(st, "UNIT_ROWS", rows)
    weights = st.poisson_weights([str(r) for r in range(250)], 30)
    want = np.einsum("rb,asrc->asbc", weights, counts)
    got = st.replicate_sums(df, "record_id", ["variant", "seed"], 30).collect()
    assert len(got) == 2 * 3 * 30
    for r in got:
        assert [r.tp, r.fp, r.tn, r.fn] == want["AB".index(r.variant), r.seed, r.b].tolist()


def test_interval_is_that_of_drawn_records(tallies):
    df, counts = tallies
    sums = st.replicate_sums(df, "record_id", ["variant", "seed"], 2000)
    got = st.interval(st.paired_differences(sums, "variant", [("A", "B")], [], {"f1": m.f1()}), [], "diff").first()
    drawn = np.random.default_rng(1).multinomial(250, np.full(250, 1 / 250), size=4000)
    diff = np.diff(_f1(np.einsum("br,asrc->absc", drawn, counts)).mean(-1), axis=0)[0]
    low, high = np.percentile(diff, [2.5, 97.5])
    noise = 4 * diff.std() / np.sqrt(2000) / 0.35  # of an outer quantile
    assert abs(got.low - low) < noise and abs(got.high - high) < noise and abs(got.mean - diff.mean()) < noise
    weights = st.poisson_weights([str(k) for k in range(300)], 2000)
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02


def test_family(spark, sf, monkeypatch):
    from wavemill.plans import model_plans

    monkeypatch.setattr(model_plans, "DRAWS", 200)
    got = catalog.QUERIES["significance_family"](spark, sf).collect()
    assert {(r.pair, r.metric) for r in got} == {(f"{a}-{b}", k) for a, b in model_plans.PAIRS for k in model_plans.FAMILY}
    for k in model_plans.FAMILY:
        own = [r for r in got if r.metric == k]
        for p, adjusted in (("p", "holm_t"), ("p_boot", "holm_boot")):
            run = 0.0
            for place, r in enumerate(sorted(own, key=lambda r: (1.0 if r[p] is None else r[p], r.pair))):
                run = max(run, (len(own) - place) * (1.0 if r[p] is None else r[p]))
                assert r[adjusted] == pytest.approx(min(1.0, run))
        assert all(r.low <= r.mean <= r.high for r in own)


def test_board(spark, sf, monkeypatch):
    from wavemill.plans import model_plans

    monkeypatch.setattr(model_plans, "DRAWS", 200)
    got = sorted(catalog.QUERIES["leaderboard"](spark, sf).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == [1, 2, 3, 4] and got[0].behind == 0 and got[0].low is None
    assert all(r.low <= r.behind + 0.05 and r.behind - 0.05 <= r.high for r in got[1:])
