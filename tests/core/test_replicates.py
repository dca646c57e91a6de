"""Bootstrapped areas and block permutations against numpy."""

import hashlib

import numpy as np
import pytest
from wavemill.operators import stats as st


def _area(p, y, w):
    order = np.argsort(p, kind="stable")
    p, pos, neg = p[order], (w * y)[order], (w * (1 - y))[order]
    total = 0.0
    for v in np.unique(p):
        at = p == v
        total += pos[at].sum() * (neg[p < v].sum() + neg[at].sum() / 2)
    return total / (pos.sum() * neg.sum()) if pos.sum() * neg.sum() else None


@pytest.mark.parametrize("rows,parts", [(1, 3), (7, 8), (512, 1)])
def test_areas_equal_numpy(spark, monkeypatch, rows, parts):
    rng = np.random.default_rng(rows)
    monkeypatch.setattr(st, "UNIT_ROWS", rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        # a third of group a shares one score, group b has one score alone, group c one class, d is small
        data = [("a", k, 0.5 if k % 3 == 0 else float(rng.integers(0, 40)) / 40, int(rng.integers(0, 2))) for k in range(240)]
        data += [("b", k, 0.25, k % 2) for k in range(50)] + [("c", k, k / 9, 1) for k in range(9)] + [("d", 1, 0.1, 0), ("d", 2, 0.9, 1), ("d", 3, None, 1), ("d", 4, 0.3, None)]
        df = spark.createDataFrame(data, "g string, k long, p double, y int").withColumnRenamed("g", "arm")
        got = {(r.arm, r.b): r.auc for r in st.auc_replicates(df, "k", ["arm"], "p", "y", 10).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 40
    for arm in "abcd":
        own = [r for r in data if r[0] == arm and r[2] is not None and r[3] is not None]
        w = st.poisson_weights([f"{arm}:{r[1]}" for r in own], 10)
        for b in range(10):
            want = _area(np.array([r[2] for r in own]), np.array([r[3] for r in own]), w[:, b])
            assert got[arm, b] is None if want is None else got[arm, b] == pytest.approx(want, abs=1e-12)


def test_areas_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "arm string, k long, p double, y int")
    assert st.auc_replicates(empty, "k", ["arm"], "p", "y", 5).collect() == []


def test_blocks_keep_the_level(spark):
    """Values stay in their blocks, one replicate equals the same permutation by hand, and p of unrelated values is not small."""
    rng = np.random.default_rng(4)
    n, draws = 600, 400
    a, b = rng.normal(size=n), rng.normal(size=n)
    df = spark.createDataFrame([(k, float(a[k]), float(b[k])) for k in range(n)], "k long, a double, b double").repartition(7)
    (got,) = st.permutation_test(df, "a", "b", "k", draws, block_rows=100).collect()
    md = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    block = np.array([md(f"perm:block:{k}") % 6 for k in range(n)])
    number, null = st._uniforms([str(k) for k in range(n)], 0, draws, "perm"), []
    for r in range(draws):
        moved = b.copy()
        for x in range(6):
            at = np.flatnonzero(block == x)
            moved[at] = b[at[np.argsort(number[at, r], kind="stable")]]
        null.append(np.corrcoef(a, moved)[0, 1])
    rho = np.corrcoef(a, b)[0, 1]
    assert got.rho == pytest.approx(rho) and got.p == np.mean(np.abs(null) >= abs(rho) - 1e-12)
    related = df.withColumn("b", df.a * 0.5 + df.b)
    assert st.permutation_test(related, "a", "b", "k", draws, block_rows=100).first().p == 0.0


def test_permutations_of_odd_tables(spark):
    empty = spark.createDataFrame([], "k long, a double, b double")
    flat = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 3.0), (3, None, 1.0)], "k long, a double, b double")
    for rows in (empty, flat):
        (got,) = st.permutation_test(rows, "a", "b", "k", 8).collect()
        assert got.rho is None and got.p is None
