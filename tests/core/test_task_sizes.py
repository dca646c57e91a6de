"""What one task holds is bounded: scores of an AUC lie in ranges, large tables in parts by their rows."""

import numpy as np
import pytest

from wavemill.operators import metrics as m
from wavemill.plans import catalog
from wavemill.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_areas_over_ranges_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    edges = [0.0, 1.0, -2.5, 7.0, 1 / m.SCORE_RANGES, 2 / m.SCORE_RANGES, 0.25, 0.25 - 1e-12, float("nan")]
    data = [(g, float(p), int(rng.integers(0, 2))) for g in "ab" for p in [*edges, *edges, *rng.random(150)]]
    df = spark.createDataFrame([*data, ("c", 0.5, 1), ("a", None, 0), ("a", None, 1), ("a", 0.3, None)], "g string, prob double, y int")
    got = {r.g: r for r in m.binary_metrics(df, ["g"]).collect()}
    for g in "ab":
        # Spark puts null first and NaN last
        own = [(np.inf if np.isnan(p) else p, y) for a, p, y in data if a == g] + ([(-np.inf, 0), (-np.inf, 1)] if g == "a" else [])
        pos, neg = ([p for p, y in own if y == c] for c in (1, 0))
        want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
        assert got[g].auc == pytest.approx(want, abs=1e-12)
        assert got[g].tp == sum(p >= 0.5 for p in pos) and got[g].fp == sum(p >= 0.5 for p in neg)
        assert got[g].tn + got[g].fn == sum(-np.inf < p < 0.5 for p, _ in own)
    assert got["c"].auc is None and got["c"].n == 1


def test_scores_are_ordered_within_ranges_and_read_once(spark):
    plan = _plan(m.binary_metrics(fx.predictions(spark, SF), ["variant"]))
    assert "_range" in plan and plan.count("lineitem.parquet") == 1


def test_subsets_meet_once(spark):
    """The seven means of a record are made after its scores have met, in one pass over the lines."""
    assert _plan(catalog.QUERIES["subset_metrics"](spark, SF)).count("lineitem.parquet") == 1


def test_quality_needs_no_pass_for_its_mean(spark):
    plan = _plan(catalog.QUERIES["regression_quality"](spark, SF))
    assert "windowspecdefinition(variant" not in plan


def test_large_tables_are_dealt_by_their_rows(spark, monkeypatch):
    want = {tuple(r) for r in catalog.QUERIES["ens_mean"](spark, SF).collect()}
    monkeypatch.setattr(fx, "TASK_LINES", 300)
    dealt = fx.base(spark, SF)
    assert dealt.rdd.getNumPartitions() == -(-fx.read(spark, SF, "lineitem").count() // 300)
    assert {tuple(r) for r in catalog.QUERIES["ens_mean"](spark, SF).collect()} == want
