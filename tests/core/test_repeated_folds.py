"""Repeated folds and the areas of many models: what is moved does not grow with repeats times rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions.hashing import uniforms
from wavemill.operators import batched as bt
from wavemill.operators import metrics as m
from wavemill.operators import splits as sp
from wavemill.plans import catalog
from wavemill.plans import model_plans as mp
from wavemill.plans import safety_errors as se
from wavemill.sources.tables import CLEANUP, short_shuffles, stored


@pytest.mark.parametrize("bits", [0, 3, 10])
def test_folds_equal_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(sp, "RANGE_BITS", bits)
    rng = np.random.default_rng(bits)
    rows = [(int(k), [int(rng.integers(0, 2)), None if k % 50 == 0 else 2 + int(k % 7 == 0)]) for k in rng.permutation(400)]
    df = spark.createDataFrame([*rows, (1000, [4, 4])], "id long, strata array<int>").repartition(3)
    got = {r.id: np.frombuffer(bytes(r.parts), np.int8).reshape(2, 3) for r in sp.repeated_folds(df, "id", "strata", 6, 5, 3).collect()}
    assert got.keys() == {k for k, _ in rows} | {1000}
    drawn = {k: uniforms([str(k)], 0, 6, "folds")[0].reshape(2, 3) for k in got}
    for stratum in range(4):
        v = stratum // 2
        own = [k for k, s in rows if s[v] == stratum]
        for repeat in range(3):
            order = sorted(own, key=lambda k: (drawn[k][v, repeat], k))
            assert [got[k][v, repeat] for k in order] == [5 * i // len(own) for i in range(len(own))]
            sizes = np.bincount([got[k][v, repeat] for k in own], minlength=5)
            assert sizes.max() - sizes.min() <= 1
    assert all((got[k][1] == -1).all() for k, s in rows if s[1] is None)


def test_equal_draws_are_told_apart_by_key(spark, monkeypatch):
    monkeypatch.setattr(sp, "uniforms", lambda units, first, draws, seed: np.full((len(units), draws), 7, np.uint32))
    df = spark.createDataFrame([(k, [0]) for k in (9, 10, -3, 4, 100)], "id long, strata array<int>").repartition(2)
    got = {r.id: list(bytes(r.parts)) for r in sp.repeated_folds(df, "id", "strata", 1, 5, 2).collect()}
    assert got == {k: [i, i] for i, k in enumerate(sorted(got))}


@pytest.fixture(scope="module")
def tables(spark):
    """Rows with a label of their own for each of two groups, the same with one row for both, and these packed."""
    rng = np.random.default_rng(9)
    n = 300
    x = np.round(rng.normal(size=(n, 2)), 1)  # with ties
    y = (x[:, :1] + rng.normal(size=(n, 2)) > 0.3).astype(int)
    parts = rng.integers(-1, 3, size=(n, 2, 4))
    flat = [(float(x[k, 0]), float(x[k, 1]), int(y[k, g]), g, [int(v) for v in parts[k, g]]) for k in range(n) for g in (0, 1)]
    both = [(float(x[k, 0]), float(x[k, 1]), [int(v) for v in y[k]], [0, 1], bytearray(parts[k].astype(np.int8).tobytes())) for k in range(n)]
    plain = spark.createDataFrame(flat, "a double, b double, y int, fold int, parts array<int>")
    both = spark.createDataFrame(both, "a double, b double, y array<int>, fold array<int>, parts binary").repartition(3)
    return stored(plain.repartition(3)), stored(both), stored(bt.packed(both, ["a", "b"]))


FITS = [bt.Fit(g, held, repeat, 2.0, False) for g in (0, 1) for repeat in range(4) for held in range(3)]


def test_packed_rows_and_a_start_give_the_same_models(tables):
    plain, both, packed = (bt.logistic_fits(df, ["a", "b"], FITS) for df in tables)
    assert all(np.allclose(plain.coef, other.coef, rtol=1e-9) and (plain.rows == other.rows).all() for other in (both, packed))
    begun = bt.logistic_fits(tables[0], ["a", "b"], FITS, start=plain.coef + 0.01)
    assert np.allclose(plain.coef, begun.coef, rtol=1e-7) and begun.steps <= plain.steps


@pytest.mark.parametrize(("rows", "scores"), [(500_000, 4_000_000), (10, 50)])
def test_areas_of_held_rows_equal_those_of_their_scores(tables, monkeypatch, rows, scores):
    monkeypatch.setattr(bt, "RANGE_ROWS", rows)
    monkeypatch.setattr(bt, "SENT_SCORES", scores)
    fitted = bt.logistic_fits(tables[0], ["a", "b"], FITS)
    want = {r.model: r.auc for r in m.auc(bt.score_held(tables[0], fitted, []).withColumn("prob", F.round("prob", 12)), ["model"]).collect()}
    for df in tables:
        got = bt.held_auc(df, fitted)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_a_single_class_has_no_area(spark):
    df = stored(spark.createDataFrame([(float(k), 1, 0, [k % 2]) for k in range(20)], "a double, y int, fold int, parts array<int>"))
    assert bt.held_auc(df, bt.logistic_fits(df, ["a"], [bt.Fit(0, 0), bt.Fit(0, 1), bt.Fit(3, 0)])) == {}


def test_record_errors_come_from_one_pass(spark, sf):
    found = mp._record_errors(spark, sf)
    assert found._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") == 1
    want = {(r.variant, r.record_id): 2 * (2 * "ABC".index(r.variant) + r.y) + r.category.startswith("persistent") for r in se._errors(spark, sf).collect()}
    assert {("ABC"[v], r.record_id): s for r in found.collect() for v, s in enumerate(r.strata)} == want


def _stages(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    empty = spark.sparkContext._jvm.java.util.ArrayList()
    stages = context.statusStore().stageList(empty, False, False, none, empty)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}


def test_no_shuffle_holds_a_row_for_each_record_and_repeat(spark, monkeypatch):
    monkeypatch.setattr(sp, "RANGE_BITS", 6)
    before = _stages(spark)
    found = catalog.QUERIES["error_predictability"](spark, "/root/testdata/sf0.01").collect()
    moved = [rows for stage, rows in _stages(spark).items() if stage not in before]
    tries = mp.REPEATS * sum(r.n for r in found)
    assert len(found) == 6 and max(moved) < tries / 4


def test_shuffles_are_dropped_only_inside(spark):
    kept = spark.conf.get(CLEANUP)
    with short_shuffles(spark):
        assert spark.conf.get(CLEANUP) == "true"
        assert spark.range(100).groupBy((F.col("id") % 7).alias("k")).count().count() == 7
    assert spark.conf.get(CLEANUP) == kept
