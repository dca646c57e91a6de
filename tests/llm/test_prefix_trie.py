import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from wavemill.llm import prefix_trie as pt
from wavemill.llm import queries


def _sequences(rows, every=5, most=9):
    """Rebuilt conversations, straight from the definition; each turn is a pair of texts."""
    held = {}
    for r in rows:
        if r.conv_id is not None:
            name = hashlib.sha256(f"{len((r.role or '').encode())}:{r.role or ''}{r.text or ''}".encode()).hexdigest()
            held.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, int(name[:15], 16), int(name[15:30], 16), r.role or "", r.text or ""))
    own = {c: [t[-2:] for t in sorted(ts)] for c, ts in held.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = (own.get(c - c % every, [])[:h] + turns[h:]) if every else turns
    return out


def _nodes(sequences):
    members = {}
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, own in members.items():
        gain = (len(own) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += children[p] == 0
    out = []
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(sequences[c]) == len(p))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else -1, len(own), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def _rows(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def test_range_minimum():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.integers(-1, 5, n)
        table = pt.RangeMinimum(values)
        for at in range(n):
            for bound in range(-1, 6):
                right = at
                while right + 1 < n and values[right + 1] >= bound:
                    right += 1
                left = at
                while left > 0 and values[left] >= bound:
                    left -= 1
                one = np.array([at]), np.array([bound])
                assert table.last(*one)[0] == right and table.first(*one)[0] == left
            for b in range(at, n):
                assert table.least(np.array([at]), np.array([b]))[0] == values[at : b + 1].min()


@pytest.fixture(scope="module")
def talks(spark):
    """Few different turns, so that prefixes are shared; one conversation in three is the same; some are empty after their donor."""
    rng = random.Random(2)
    rows = []
    for c in rng.sample(range(-40, 400), 300):
        same = rng.random() < 0.35
        for k in range(4 if same else rng.randrange(1, 12)):
            word = "same" if same else rng.choice(["a", "b", "", None, "é" * 40])
            rows.append((c, None if k == 0 and rng.random() < 0.1 else k, rng.choice(["user", None]) if not same else "user", word, 7))
    rows += [(None, 0, "user", "x", 7), *rows[:6]]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int").repartition(5)


@pytest.mark.parametrize("block,turns,every", [(1 << 15, 1 << 18, 5), (1, 1 << 18, 5), (3, 1 << 18, 5), (16, 40, 5), (7, 1 << 18, 0)])
def test_equals_a_walk(spark, talks, monkeypatch, block, turns, every):
    monkeypatch.setattr(pt, "ID_RUN", 2)
    named = pt.named_turns(talks)
    got = pt.prefix_trie(pt.with_donors(named) if every else named, block, turns)
    assert _rows(got) == _nodes(_sequences(talks.collect(), every))


def test_one_long_and_none(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, k, "user", f"{k}") for k in range(250)] + [(2, k, "user", f"{k}") for k in range(249)] + [(3, 0, "user", "x" * 2_000_000), (4, 0, "user", "x" * 2_000_000)]
    talks = spark.createDataFrame(rows, schema)
    assert _rows(pt.prefix_trie(pt.named_turns(talks))) == _nodes(_sequences(talks.collect(), 0))
    assert pt.prefix_trie(pt.with_donors(pt.named_turns(spark.createDataFrame([], schema)))).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_walk_and_sql(spark, size):
    folder = f"/root/testdata/{size}"
    got = queries.op13_prefix_trie(spark, folder)
    rows = _rows(got)
    assert rows == _nodes(_sequences(spark.read.parquet(f"{folder}/conversations.parquet").collect()))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{folder}/conversations.parquet'")
    want = con.sql(queries.ORACLES["op13_prefix_trie"])
    assert want.columns == got.columns
    assert rows == sorted(tuple(-1 if x is None else x for x in r) for r in want.fetchall())
