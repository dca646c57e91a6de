import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from wavemill.llm import exact_dedup, ngram_join
from wavemill.llm.graph import components


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("block,bits", [(4096, 63), (16, 63), (7, 3)])  # 3 bits: routes clash all the time
def test_exact_groups(odd, block, bits):
    rows = [(r.doc_id, _norm(r.text)) for r in odd.collect()]
    expected = []
    for i, t in rows:
        same = [k for k, u in rows if u == t]
        expected.append((i, min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest()))
    got = exact_dedup.exact_groups(odd, block_bytes=block, hash_bits=bits).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_drop_copies(odd, nothing):
    got = exact_dedup.drop_copies(odd)
    assert got.columns == odd.columns
    kept = [(r.doc_id, _norm(r.text)) for r in got.collect()]
    assert len(kept) == len({t for _, t in kept}) == len({_norm(r.text) for r in odd.collect()})
    assert exact_dedup.exact_groups(nothing).count() == exact_dedup.drop_copies(nothing).count() == 0


def test_null_ids_and_clashing_names(spark):
    rows = [(None, "a", 1, 2), (None, "a", 1, 3), (None, "b", 1, 2), (4, "b", 1, 2), (5, "c " * 400_000, 1, 2), (6, "c  " * 400_000, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _digest int, _rows int")
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.kept) for r in exact_dedup.exact_groups(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (0, 4, False), (4, 4, True), (5, 5, True), (6, 5, False)]
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text[:1]) for r in kept.collect()) == [(0, "a"), (4, "b"), (5, "c")]


def _sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def _classes(rows, n, share):
    sets = [(i, _sets(t, n)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= share * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


@pytest.mark.parametrize("words,share,hot", [(3, 90, 64), (5, 80, 1), (1, 60, 2)])
def test_similar_classes(spark, odd, monkeypatch, words, share, hot):
    monkeypatch.setattr(ngram_join, "HOT_GROUPS", hot)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 9, 15, 40, 120, 400]))]
        if k % 3 == 0:
            base[3:3] = common
        rows.append((100 + 10 * k, " ".join(base)))
        for c in range(1, rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(max(1, len(copy) // rng.choice([10, 30, 60, 120]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((100 + 10 * k + c, " ".join(copy)))
    base = [rng.choice(vocabulary) for _ in range(90)]
    for k in range(200):  # a large group of near copies
        copy = list(base)
        copy[rng.randrange(90)] = rng.choice(vocabulary)
        rows.append((2000 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, ngram_join.similar_classes(docs, words=words, share=share).collect()))
    assert got == _classes(rows, words, share)


def test_clashing_set_keys_and_repeated_ids(spark, odd):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(50, base), (7, base + " x"), (7, "quite another text of its own"), (None, base + " y"), (None, "text without an id or copy"), (50, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit("clash"), "grp": F.lit(1)}).repartition(3)
    got = ngram_join.similar_classes(docs, words=3, share=90, key_bits=2).collect()  # four keys for all sets
    assert sorted(map(str, got)) == sorted(map(str, ngram_join.similar_classes(docs, words=3, share=90).collect()))
    assert {r.component_id for r in got if r.n_shingles in (58, 59)} == {7}
    kept = ngram_join.keep_one_of_each(docs, words=3, share=90, key_bits=2)
    assert kept.columns == docs.columns
    long_ones = sorted(((r.doc_id, r.text[:5]) for r in kept.collect() if r.text and ("w1 w2" in r.text or "of its own" in r.text or "without an id" in r.text)), key=str)
    assert long_ones == sorted([(7, "w0 w1"), (7, "quite"), (None, "text ")], key=str)


def test_rows_shipped_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    shipped, opened = [], ngram_join._opened
    monkeypatch.setattr(ngram_join, "_opened", lambda rows, *rest: (shipped.append(rows.count()), opened(rows, *rest))[1])
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    rng, totals = random.Random(8), []
    for m in (300, 1200):
        shipped.clear()
        rows = []
        for i in range(m):
            words = [f"v{k}" for k in range(240)]
            words[rng.randrange(240)] = f"n{rng.randrange(10**6)}"
            rows.append((i, " ".join(words)))
        got = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert {r.component_id for r in got.collect()} == {0}
        totals.append(sum(shipped))
    assert totals[1] <= 5 * totals[0] and totals[1] <= 3 * 1200


def test_keep_one_of_each(odd, nothing):
    kept = ngram_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {0, 1, 2, 4}
    assert ngram_join.keep_one_of_each(nothing).count() == ngram_join.similar_classes(nothing).count() == 0


@pytest.mark.parametrize("task_links", [1_000_000, 40])
def test_components_chain_and_star(spark, task_links):
    links = [(i, i + 1) for i in range(200)] + [(500, k) for k in range(300, 400)] + [(7, 7), (900, 900), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), task_links=task_links).collect()))
    assert got == {**{i: 0 for i in range(201)}, **{k: 300 for k in [*range(300, 400), 500]}, 900: 900}
