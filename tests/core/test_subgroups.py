"""Factor levels of recordings: every band and every missing channel."""

import pytest
from wavemill.operators import errors as er
from wavemill.operators import subgroups as sg


@pytest.fixture(scope="module")
def found(spark):
    steady = lambda key, n, gap, start=0.0: [(key, start + k * gap) for k in range(n)]
    ecg = steady("calm", 10, 0.8) + steady("fast", 10, 0.4) + steady("slow", 4, 1.5) + steady("alone", 5, 0.8) + steady("two", 2, 0.8) + [("tied", 1.0)] * 5
    pulse = steady("calm", 10, 0.8, 0.2) + steady("fast", 2, 0.8, 0.2) + steady("slow", 4, 1.5, 0.9) + steady("deaf", 6, 0.5) + steady("two", 2, 0.8, 0.2) + [("tied", 1.2)]
    peaks = [("calm", 0.9), ("fast", 0.1), ("wave", 0.3), ("two", None)]
    make = lambda rows, cols: spark.createDataFrame(rows, cols)
    out = sg.signal_factors(make(ecg, "key string, t double"), make(pulse, "key string, t double"), make(peaks, "key string, peak double"), "key", 0.08, 0.6)
    return {r.key: tuple(r)[1:] for r in out.collect()}


@pytest.mark.parametrize(
    "key,want",
    [
        ("calm", ("agree", "high", "clear", "HR50-100")),
        ("fast", ("disagree", "low", "weak", "HR>=140")),
        ("slow", ("agree", "low", None, "HR<50")),
        ("alone", ("disagree", "low", None, "HR50-100")),
        ("deaf", ("disagree", None, None, "few beats")),
        ("two", ("agree", "high", None, "few beats")),
        ("tied", ("agree", "high", None, "few beats")),
        ("wave", (None, None, "clear", None)),
    ],
)
def test_levels(found, key, want):
    assert found[key] == want


def test_one_row_per_recording(found):
    assert sorted(found) == ["alone", "calm", "deaf", "fast", "slow", "tied", "two", "wave"]


def test_no_rows(spark):
    none = spark.createDataFrame([], "key string, t double")
    assert sg.signal_factors(none, none, spark.createDataFrame([], "key string, peak double"), "key", 0.1, 0.6).collect() == []


def test_terciles_of_two_columns(spark):
    rows = spark.createDataFrame([(float(k), float(min(k, 4)), k) for k in range(9)] + [(None, 1.0, 9)], "a double, b double, k int")
    got = {r.k: (r.la, r.lb) for r in er.tercile_levels(rows, {"a": "la", "b": "lb"}).collect()}
    assert [got[k][0] for k in range(10)] == ["low"] * 3 + ["mid"] * 3 + ["high"] * 3 + [None]
    assert [got[k][1] for k in range(10)] == ["low"] * 2 + ["mid"] * 2 + ["high"] * 5 + ["low"]
