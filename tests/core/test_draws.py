"""Draws over arrays against hashlib, whatever the length of a unit's name."""

import hashlib

import numpy as np
import pytest
from wavemill.functions import hashing
from wavemill.operators import stats as st

UNITS = ["", "7", "42", "1234567", "é:ü", "x" * 30, "x" * 46, "x" * 47, "x" * 48, "x" * 200, "8"]


@pytest.mark.parametrize("first,draws", [(0, 1), (0, 10), (8, 41), (360, 80), (3996, 12)])
def test_uniforms_equal_hashlib(monkeypatch, first, draws):
    monkeypatch.setattr(hashing, "TILE", 64)
    got = hashing.uniforms(UNITS, first, draws, "boot")
    for unit, row in zip(UNITS, got, strict=True):
        want = [int.from_bytes(hashlib.md5(f"boot:{b // 4}:{unit}".encode()).digest()[b % 4 * 4 :][:4], "big") for b in range(first, first + draws)]
        assert row.tolist() == want
    assert hashing.uniforms([], 0, 8, "boot").shape == (0, 8)


def test_weights_change_at_the_thresholds(monkeypatch):
    edges = np.array([int(c * 2**32) + more for c in st.POISSON for more in (-1, 0, 1, 2)] + [0, 2**32 - 1], np.uint32)
    monkeypatch.setattr(st, "_uniforms", lambda *_: edges[None])
    assert st.poisson_weights(["u"], len(edges))[0].tolist() == np.searchsorted(st.POISSON, edges / 2**32, "right").tolist()


def test_large_counts_stay_exact(spark):
    rows = spark.createDataFrame([(k, k % 3, 10_000_001 + k, 1, 0, 2) for k in range(40)], "r long, arm int, tp long, fp long, tn long, fn long")
    got = {(r.arm, r.b): r.tp for r in st.replicate_sums(rows, "r", ["arm"], 8).collect()}
    w = st.poisson_weights([str(k) for k in range(40)], 8).astype(int)
    assert got == {(g, b): sum(int(w[k, b]) * (10_000_001 + k) for k in range(g, 40, 3)) for g in range(3) for b in range(8)}
