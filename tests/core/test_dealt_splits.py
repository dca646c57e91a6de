"""Splits of large tables: rows are dealt to tasks by their number, shares are taken without ordering them, checks move them once."""

import hashlib

import pytest
from wavemill.functions import ranking
from wavemill.operators import splits as sp


def _draw(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 10, 30, 997])
def test_holdout_equals_brute_force_also_without_a_class(spark, n):
    """A null class is a class of its own; a share of 0.15 of 10 is rounded half to even."""
    rows = [(k, None if k % 3 == 0 else k % 3) for k in range(n)]
    got = {(r.c, r.k): r.role for r in sp.group_holdout(spark.createDataFrame([*rows, *rows], "k long, c int"), "k", 0.15, ["c"], 7).collect()}
    want = {}
    for c in {c for _, c in rows}:
        own = sorted((k for k, x in rows if x == c), key=lambda k: (_draw(7, k), k))
        want |= {(c, k): "val" if place < max(1, round(0.15 * len(own))) else "fit" for place, k in enumerate(own)}
    assert got == want


def test_places_within_null_groups(spark):
    rows = [(k, None if k % 2 else k % 4) for k in range(200)]
    got = {(r.c, r.k): r.fold for r in sp.group_folds(spark.createDataFrame(rows, "k long, c int"), "k", 5, 3, ["c"]).collect()}
    want = {}
    for c in {c for _, c in rows}:
        want |= {(c, k): place % 5 for place, k in enumerate(sorted((k for k, x in rows if x == c), key=lambda k: (_draw(3, k), k)))}
    assert got == want


def test_one_row_for_each_violation(spark):
    rows = [(0, f, k, "test" if k == f else "fit") for f in range(3) for k in range(3)]
    rows += [(0, 0, 0, "val"), (0, 1, 0, "val"), (1, 0, 5, "fit"), (1, 1, 5, None), (2, 0, 6, "test"), (2, 1, 6, "test"), (2, 2, 6, None), (3, 0, 7, "test"), (3, 0, 7, None), (3, 1, 8, "test"), (3, 1, 8, "test")]
    got = sorted(tuple(r) for r in sp.leak_check(spark.createDataFrame(rows, "seed int, fold int, k int, role string"), "k").collect())
    assert got == [(0, 0, "two roles"), (0, 0, "two roles"), (1, 5, "tested not once"), (2, 6, "tested not once"), (3, 8, "tested not once")]


def test_a_split_is_moved_once_and_made_once(spark):
    frame = spark.range(1000).withColumnRenamed("id", "k")
    plan = _plan(sp.leak_check(sp.iter_splits(frame, "k", 2, 5, 0.15), "k"))
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    frame = spark.range(1000).withColumnRenamed("id", "k")
    want = {tuple(r) for r in sp.iter_splits(frame, "k", 2, 5, 0.15).collect()}
    monkeypatch.setattr(ranking, "TASK_ROWS", 100)
    splits = sp.iter_splits(frame, "k", 2, 5, 0.15)
    assert {tuple(r) for r in splits.collect()} == want and len(want) == 10_000
    assert sp.group_folds(frame, "k", 5).rdd.getNumPartitions() == 10
    checked = sp.leak_check(splits, "k", 10_000)
    assert checked.rdd.getNumPartitions() == 100 and checked.count() == 0
