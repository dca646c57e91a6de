import math
import random

from wavemill.llm import mixing


def _plan(rows):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").replace("\x0b", " ").split(None) if t and t.isascii() else [w for w in (t or "").split(" ") if w])
    return sizes


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in over}


def _docs(spark, rng, n=300):
    rows = []
    for i in range(n):
        source = rng.choice([None, "", "a", "b", "hot", "hot", "hot", "é", "z"])
        rows.append((i, None if i % 41 == 0 else " ".join(["w"] * rng.randrange(0, 60)), source))
    rows.append((n, "one two three", "tiny"))
    rows += rows[:3]  # repeated rows
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_amounts(spark):
    rows, docs = _docs(spark, random.Random(3))
    sizes = _plan(rows)
    targets = _targets(sizes)
    got = mixing.mix_amounts(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_amounts(docs.repartition(2)).collect()))
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, targets[s]) and 0 <= r.taken <= 3 * r.size
        assert r.size == 0 or r.taken // r.size >= int(round(targets[s])) // sizes[s]  # complete epochs come first
        taken[s] = taken.get(s, 0) + r.taken
    for s, words in taken.items():
        assert abs(words - targets[s]) <= 0.5


def test_mix_rows(spark):
    rows, docs = _docs(spark, random.Random(4))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    targets = _targets(_plan(rows))
    assert {s: n for s, n in words.items()} == {s: math.floor(t + 0.5) for s, t in targets.items() if t >= 0.5}


def test_weights_steer_the_draw(spark):
    rows = [(i, "w w w w w w w w w w", "a" if i < 400 else "b", 20.0 if i % 2 else 0.05) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    got = mixing.mix_amounts(docs, weight_col="weight").collect()  # a takes two thirds of its words
    taken = [sum(r.taken for r in got if r.doc_id < 400 and r.doc_id % 2 == odd) for odd in (0, 1)]
    assert taken[1] == 2000 and 500 < taken[0] < 800


def test_empty_and_odd(odd, nothing):
    assert mixing.mix_amounts(nothing).count() == mixing.mix(nothing).count() == 0
    assert mixing.mix_amounts(odd).count() == odd.count()
    assert mixing.mix(odd).columns == odd.columns
