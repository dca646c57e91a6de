"""Folds of the repeated cross validation are dealt without a text per row and repeat."""

from wavemill.operators import splits as sp
from wavemill.plans import catalog

SF = "/root/testdata/sf0.001"


def test_folds_carry_no_texts(spark, monkeypatch):
    def carried(*_):
        raise AssertionError("rows went through the texts' folds")

    monkeypatch.setattr(sp, "strat_window_folds", carried)
    found = {(r.variant, r["class"]): r for r in catalog.QUERIES["error_predictability"](spark, SF).collect()}
    assert len(found) == 6
    assert all(r.n > r.n_err >= 0 for r in found.values())
    assert any(r.auc is not None for r in found.values())
