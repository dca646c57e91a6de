import math
import re
import zlib
from itertools import product

import numpy as np
import pytest
from wavemill.llm import hmm


def _chain(rng, emissions, k):
    draw = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(shape) + 0.1)
    return hmm.Chain(draw(k), draw(k, k), draw(k, emissions).T.copy())


def _all_paths(chain, text):
    """Every path's probability, summed: starts, moves and emissions weighted by it as well."""
    k = len(chain.start)
    total, starts, moves, emits = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros(chain.emit.shape)
    for path in product(range(k), repeat=len(text)):
        p = chain.start[path[0]]
        for t, z in enumerate(path):
            p *= chain.emit[text[t], z] * (chain.move[path[t - 1], z] if t else 1)
        total += p
        starts[path[0]] += p
        for t, z in enumerate(path):
            emits[text[t], z] += p
            if t:
                moves[path[t - 1], z] += p
    return total, starts / total, moves / total, emits / total


def test_recursions_equal_all_paths():
    rng = np.random.default_rng(4)
    chain = _chain(rng, 5, 3)
    texts = [rng.integers(0, 5, n) for n in (1, 6, 2, 5, 5, 1, 3)]
    emissions, bounds = np.concatenate(texts).astype(np.int32), np.cumsum([0, *map(len, texts)])
    truth = [_all_paths(chain, t) for t in texts]
    assert np.allclose(hmm.log_likelihood(chain, emissions, bounds), [math.log10(t[0]) for t in truth], atol=1e-12)
    starts, moves, emits, likelihood = hmm.expected_counts(chain, emissions, bounds)
    for got, k in ((starts, 1), (moves, 2), (emits, 3)):
        assert np.allclose(got, sum(t[k] for t in truth), atol=1e-4)
    assert math.isclose(likelihood, sum(math.log10(t[0]) for t in truth), rel_tol=1e-5)


def test_long_text_stays_exact():
    chain = _chain(np.random.default_rng(1), 4, 2)
    text = np.random.default_rng(2).integers(0, 4, 30_000).astype(np.int32)
    state, total = chain.start.copy(), 0.0
    for t, x in enumerate(text):
        state = (state if t == 0 else state @ chain.move) * chain.emit[x]
        total += math.log10(state.sum())
        state /= state.sum()
    assert math.isclose(hmm.log_likelihood(chain, text, np.array([0, len(text)]))[0], total, rel_tol=1e-12)


def _words(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))] + [None]


def _base(rows):
    train = [w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10 for w in _words(t)]
    counts = {}
    for w in train:
        counts[w] = counts.get(w, 0) + 1
    n, v = len(train), len(counts)
    out = {}
    for i, t in rows:
        words = _words(t)
        out[i] = (zlib.crc32(str(i).encode()) % 10 == 0, len(words), sum(w in counts for w in words), n, sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words))
    return out


@pytest.mark.parametrize("counted", [None, 64])  # 64: nearly all counts come through the shuffle
def test_scores(spark, sf, odd, monkeypatch, counted):
    if counted:
        monkeypatch.setattr(hmm, "COUNTED", counted)
        monkeypatch.setattr(hmm, "SYMBOLS", counted)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd.selectExpr("doc_id + 100000", "text"))
    expected = _base([(r.doc_id, r.text) for r in docs.distinct().collect()] + [(100003, "   "), (100025, "same text here")])
    got = hmm.score_texts(docs, rounds=4, states=3).collect()
    assert len(got) == docs.count()
    for r in got:
        want = expected[r.doc_id]
        assert tuple(r)[1:5] == want[:4] and math.isclose(r.base_score, want[4], rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rounds_raise_the_likelihood(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    lexicon = hmm.build_lexicon(hmm.count_words(docs))
    chain = hmm.Chain.fresh(lexicon.emissions, 3, 1)
    _, said = hmm.baum_welch(docs, chain, spark.sparkContext.broadcast(lexicon), 4)
    assert said == sorted(said)


def test_nothing_and_nothing_to_learn(spark, nothing):
    assert hmm.score_texts(nothing, rounds=2).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = hmm.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), rounds=2).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0) and row.base_score == 0.0
