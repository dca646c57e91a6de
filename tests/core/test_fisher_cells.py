"""Fisher's exact test visits the cells that count; subgroup sets multiply level combinations, not rows."""

import itertools
import math
import time

import pytest
from wavemill.operators import errors as er
from wavemill.operators.stats import _fisher_p


def _brute(a, b, c, d):
    r, k, n = a + b, a + c, a + b + c + d
    ways = {x: math.comb(k, x) * math.comb(n - k, r - x) for x in range(max(0, r + k - n), min(r, k) + 1)}
    return sum(w for w in ways.values() if w * 10**7 <= ways[a] * (10**7 + 1)) / math.comb(n, r)


def test_small_tables_equal_brute_force():
    for table in [*itertools.product(range(5), repeat=4), (40, 3, 60, 900), (0, 800, 700, 5), (300, 300, 300, 300), (2000, 10, 10, 2000)]:
        for step in (3, 1 << 16):
            assert _fisher_p(*table, step=step) == pytest.approx(_brute(*table), rel=1e-9, abs=1e-300)


def test_cells_grow_slower_than_counts():
    began = time.time()
    assert _fisher_p(100_000_000, 100_000_000, 100_000_000, 100_000_000) == pytest.approx(1.0)
    # 10,000 from even with a deviation of 5,000: p of two deviations, up to the step of one cell
    assert _fisher_p(100_010_000, 99_990_000, 99_990_000, 100_010_000) == pytest.approx(math.erfc((10_000 - 0.5) / 5_000 / math.sqrt(2)), rel=1e-4)
    assert _fisher_p(200_000_000, 0, 0, 200_000_000) == 0.0
    assert time.time() - began < 5


def test_rows_are_summed_before_the_sets(spark):
    rows = spark.createDataFrame([("A", k % 2, f"f{k % 3}", None if k % 5 == 0 else "g", "persistent_fn" if k % 4 == 0 else "unstable", None if k == 7 else k / 100) for k in range(100)], "variant string, y int, f string, g string, category string, error double")
    out = er.subgroup_breakdown(rows, ["f", "g"], ["variant", "y"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan[plan.index("Expand") :]
    got = {(r.y, r.factor, r.level): (r.n, r.persistent, r.mean_error) for r in out.collect()}
    want = {}
    for k in range(100):
        for key in ((k % 2, "f", f"f{k % 3}"), (k % 2, "g", "none" if k % 5 == 0 else "g")):
            want.setdefault(key, []).append(k)
    assert set(got) == set(want)
    for key, ks in want.items():
        told = [k / 100 for k in ks if k != 7]
        assert got[key][:2] == (len(ks), sum(k % 4 == 0 for k in ks)) and got[key][2] == pytest.approx(sum(told) / len(told))
