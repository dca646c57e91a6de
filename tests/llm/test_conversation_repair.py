import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from wavemill.llm import conversation_repair as cr
from wavemill.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def _codes(rows):
    """(initial, deleted by rule, truncated) of each row, straight from the definition."""
    out = []
    for k, (role, text) in enumerate(rows):
        seen = WORD.findall(text)
        gone = not seen or (role, text) in rows[:k]
        out.append((role[:1], gone, not gone and seen[-1] not in ".!?"))
    return out


def _all_audits(codes, inserts=2):
    """Every (cost, audit, initials) with at most so many insertions in each gap, by plain enumeration."""
    ways = [(0, "", "")]
    adds = ["".join(x) for k in range(inserts + 1) for x in itertools.product("ua", repeat=k)]
    for initial, gone, cut in codes:
        rows = [(4, "D", "")]
        if not gone:
            extra = 3 * cut
            rows += [(extra, "K", initial), (3 + extra, "R", "u"), (3 + extra, "R", "a")] if initial else [(3 + extra, "R", "u"), (3 + extra, "R", "a")]
        ways = [(c + 3 * len(a) + d, s + "I" * len(a) + e, i + a + r) for c, s, i in ways for a in adds for d, e, r in rows if LEGAL.match(i + a + r)]
    return [(c + 3 * len(a), s + "I" * len(a), i + a) for c, s, i in ways for a in adds if LEGAL.fullmatch(i + a)]


def _by_tables(codes):
    """Least (cost, audit) by a table over rows and states; fit for any length."""
    states = {"": (0, "")}
    grow = {"": "u", "s": "u", "u": "a", "a": "u"}

    def offer(table, state, label):
        if state not in table or label < table[state]:
            table[state] = label

    def insert(table):
        for _ in range(3):
            for state, (c, s) in list(table.items()):
                offer(table, grow[state], (c + 3, s + "I"))

    insert(states)
    for initial, gone, cut in codes:
        after = {}
        for state, (c, s) in states.items():
            offer(after, state, (c + 4, s + "D"))
            if not gone:
                if (initial == "s" and state == "") or initial == grow[state]:
                    offer(after, initial, (c + 3 * cut, s + "K"))
                offer(after, grow[state], (c + 3 + 3 * cut, s + "R"))
        insert(after)
        states = after
    return min(states[e] for e in ("", "a") if e in states)


def _sha(audit, rows):
    state, rows, out = "", iter(rows), []
    for e in audit:
        if e == "I":
            state = "a" if state == "u" else "u"
            out.append({"u": "user:", "a": "assistant:"}[state])
            continue
        role, text = next(rows)
        if e == "R":
            state = "a" if state == "u" else "u"
            out.append({"u": "user:", "a": "assistant:"}[state] + text)
        elif e == "K":
            state = role[0]
            out.append(f"{role}:{text}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def _expected(turns, rows):
    codes = _codes(rows)
    known = [t for t in turns if t is not None]
    blank = sum(not WORD.search(t) for _, t in rows)
    twice = sum(bool(WORD.search(t)) and (r, t) in rows[:k] for k, (r, t) in enumerate(rows))
    pairs = sum(a + b not in ("su", "ua", "au") for (a, *_), (b, *_) in zip(codes, codes[1:]))
    cost, audit = _by_tables(codes)
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, blank, twice, sum(c for *_, c in codes), pairs, cost, audit, _sha(audit, rows)


ROLES = ["user", "assistant", "system", "tool", "", " "]
TEXTS = ["Yes.", "No!", "cut off", " \t", "", "Why? ", "a.b", "…"]


def test_search_equals_enumeration():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randrange(4))]
        codes = _codes(rows)
        best = min((c, s) for c, s, _ in _all_audits(codes))
        said = "".join(cr.row_code(i, "blank" if gone else "truncated" if cut else "") for i, gone, cut in codes)
        assert cr.cheapest_audit(said) == best == _by_tables(codes)


@pytest.mark.parametrize("piece", [1, 2, 7])
def test_pieces_join_to_the_whole(monkeypatch, piece):
    rng = random.Random(piece)
    for n in (0, 1, 5, 30, 90):
        codes = [(rng.choice("sua") if rng.random() < 0.9 else "o", rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]
        said = "".join(cr.row_code(i, "blank" if gone else "truncated" if cut else "") for i, gone, cut in codes)
        monkeypatch.setattr(cr, "PIECE", piece)
        assert cr.cheapest_audit(said) == _by_tables([(i, g, c and not g) for i, g, c in codes])


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(11)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randrange(9)):
            rows.append((conv, None if rng.random() < 0.1 else turn + rng.randrange(2), rng.choice([*ROLES[:3], *ROLES[:3], *ROLES, None]), rng.choice([*TEXTS, f"text {rng.random()}.", None]), "clash"))
    for turn in range(700):
        rows.append((100, turn // 2, ROLES[turn % 2] if rng.random() < 0.8 else "system", rng.choice([f"long {turn}.", f"cut {turn}", "again and again.", ""]), "clash"))
    rows += rows[:5]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string").repartition(5)


def _talks(rows):
    held = {}
    for r in rows:
        held.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, " " if r.role is None else r.role, " " if r.text is None else r.text))
    return {c: ([t if known else None for known, t, *_ in sorted(rs)], [(role, text) for *_, role, text in sorted(rs)]) for c, rs in held.items()}


@pytest.mark.parametrize("long_rows", [10**6, 5, 0])
def test_summary_and_turns(spark, talks, long_rows):
    want = {c: _expected(*x) for c, x in _talks(talks.collect()).items()}
    got = cr.repair_summary(talks, long_rows=long_rows).collect()
    assert {r.conv_id: tuple(r)[2:] for r in got} == want and len(got) == len(want)
    turns = cr.repaired_turns(talks, long_rows=long_rows).orderBy("conv_id", "place").collect()
    for r in got:
        own = [t for t in turns if t.conv_id == r.conv_id]
        assert [t.place for t in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in own).encode()).hexdigest() == r.repaired_sha256
        assert LEGAL.fullmatch("".join(t.role[:1] for t in own)) and "".join(t.edit for t in own) == r.audit.replace("D", "")


def test_very_long_texts_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", " " * 2_000_000), (1, 2, "assistant", "y." * 1_000_000), (2, 0, "user", "?" * 1_000_000)]
    docs = spark.createDataFrame(rows, schema)
    for long_bytes in (1 << 30, 1 << 20):
        got = {r.conv_id: tuple(r)[2:] for r in cr.repair_summary(docs, long_bytes=long_bytes).collect()}
        assert got == {c: _expected(*x) for c, x in _talks(docs.collect()).items()}
    nothing = spark.createDataFrame([], schema)
    assert cr.repair_summary(nothing).count() == cr.repaired_turns(nothing).count() == 0
    absent = cr.repair_summary(docs, present=F.lit(False)).collect()
    assert sorted(tuple(r) for r in absent) == [(c, *[0] * 7, "", hashlib.sha256(b"").hexdigest()) for c in (1, 2)]


def _damaged(rows):
    for r in rows:
        said = lambda x: " " if x is None else x
        k = zlib.crc32(f"{said(r.conv_id)}:{said(r.turn)}".encode()) % 20
        role, text = said(r.role), said(r.text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        for _ in range(2 if k == 3 else 1):
            yield type("Row", (), {"conv_id": r.conv_id, "turn": r.turn, "role": "user" if k == 4 else role, "text": text})


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, size):
    folder = f"/root/testdata/{size}"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    held = _talks(_damaged(rows))
    want = {c: _expected(*held.get(c, ([], []))) for c in {r.conv_id for r in rows}}
    got = queries.op11_conversation_repair(spark, folder)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = got.collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert {f for r in got for f in r.audit} == set("KDRI")
