"""Queries over all of their rows, held against brute force on the smallest tables."""

import hashlib
import math

import numpy as np
from wavemill.operators import stats as st
from wavemill.plans import catalog, evaluation, statistics
from wavemill.plans import fixtures as fx


def _draw(*keys):
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16)


def test_permutation_test_takes_every_record(spark, sf):
    held = {}
    for r in evaluation.oof(spark, sf).where("variant = 'A'").select("record_id", "quality", "prob").collect():
        held.setdefault(r.record_id, []).append((r.quality, r.prob))
    ids = sorted(held)
    assert any(i % 10 for i in ids)
    quality, prob = (np.array([np.mean([v[k] for v in held[i]]) for i in ids]) for k in (0, 1))
    rho = np.corrcoef(quality, prob)[0, 1]
    number = st._uniforms([str(i) for i in ids], 0, statistics.DRAWS, "perm")
    assert number[3, 6] == int(hashlib.md5(f"perm:1:{ids[3]}".encode()).hexdigest()[16:24], 16)
    assert len(ids) <= st.BLOCK_ROWS  # one block: every permutation of all records
    null = [np.corrcoef(quality, prob[sorted(range(len(ids)), key=lambda k: (number[k, r], ids[k]))])[0, 1] for r in range(statistics.DRAWS)]
    (got,) = catalog.QUERIES["permutation_test"](spark, sf).collect()
    assert math.isclose(got.rho, rho, abs_tol=2e-6) and got.p == np.mean(np.abs(null) >= abs(rho) - 1e-12)


def test_noise_bank_holds_every_event(spark, sf):
    bank = {}
    for r in fx.read(spark, sf, "events").orderBy("event_id").collect():
        bank.setdefault(r.event_type, []).append(r.value)
    names = sorted(c for c in bank if len(bank[c]) >= 64)
    got = {}
    for r in catalog.QUERIES["perturb_noise_snr"](spark, sf).collect():
        got.setdefault(r.window_id, {})[r.i] = r.x
    rows = fx.read(spark, sf, "embeddings").collect()
    assert len(got) == len(rows)
    for r in rows:
        x, v = np.array(r.embedding, float), np.array(bank[names[_draw("noise", r.vec_id) % len(names)]])
        at = _draw("noise-at", r.vec_id) % (len(v) - 63)
        v = v[at : at + 64] * (1.0 if _draw("noise-sign", r.vec_id) % 2 == 0 else -1.0)
        x = x + (v - v.mean()) * math.sqrt(x.var() / (v.var() * 10**0.6 + 1e-12))
        assert np.allclose([got[r.vec_id][i] for i in range(64)], (x - x.mean()) / (x.std() + 1e-8), atol=2e-5)
