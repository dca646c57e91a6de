"""Conversation structure repair: bidirectional Dijkstra over the edit lattice.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``. Its rows are read in order of turn (nulls
first; ties by role, then text). Each row is kept, given the role user or assistant, or deleted; turns without text may be
inserted anywhere. The lattice has a node for every number of rows read and every state of that grammar. One search goes
forward from the first node, one backward from the last ones, each with a heap; they stop when no crossing can be as cheap
as the best one, so all crossings of that cost are met, and of those the least audit (the initials of the edits) is taken.

Costs: keep 0, new role 3, delete 4, insert 3; a row that is cut off costs 3 more unless deleted. Blank rows (nothing but
white space) and rows whose role and text came before are deleted. A row's first fault counts: blank, duplicate, truncated
(its last visible character is none of ``.!?``).

Scale: rows are dealt by conversation and read in order, one conversation at a time. Long rows of turns are cut into pieces
of ``PIECE`` rows: a piece gives the cheapest edits from each state to each state, and pieces are joined in order, which is
exact (of two equally cheap audits between the same two nodes none begins with the other). Conversations of more than
``LONG_ROWS`` rows or ``LONG_BYTES`` bytes, found by a count, are dealt by ranges of (conversation, turn, role, text) to many
tasks; what one task still reads of them is a byte per row, and their texts as a stream for the one digest.

Edge cases: null roles and texts count as one space, a null conversation id is an id, null turns come first. A role
without an initial cannot be kept. Conversations without rows give zeros, an empty audit and the digest of nothing. Repeated
rows are duplicates of each other. An empty table gives an empty result. Only the four named columns are used.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_hot, materialize, small_batches

# What each edit costs, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of one lattice search; longer conversations are joined from pieces.
PIECE = 256
#: A conversation above either goes to many tasks.
LONG_ROWS, LONG_BYTES = 50_000, 16 << 20
SPACE = "\t\n\v\f\r "
#: States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL_ENDS = (START, ASSISTANT)
NEEDS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the one turn that may be made in a state
KEEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}


# ---------------------------------------------------------------- the lattice


def row_code(initial: str, fault: str) -> str:
    """A row as one character: d must go; s, u, a, o (other) by initial; capitals are truncated."""
    if fault in ("blank", "duplicate"):
        return "d"
    code = initial if initial in ("s", "u", "a") else "o"
    return code.upper() if fault == "truncated" else code


def _edits(code: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, edit, next state) of what may be done with a row in a state."""
    out = [(DELETE, "D", state)]
    if code != "d":
        extra = TRUNCATED if code.isupper() else 0
        kept = KEEPS.get((code.lower(), state))
        if kept is not None:
            out.append((extra, "K", kept))
        out.append((REROLE + extra, "R", NEEDS[state]))
    return out


_STEPS = {(code, state): _edits(code, state) for code in "dsuaoSUAO" for state in range(4)}
_INTO = {state: [before for before in range(4) if NEEDS[before] == state] for state in range(4)}
_BACK = {(code, state): [(cost, edit, before) for before in range(4) for cost, edit, to in _STEPS[code, before] if to == state] for code in "dsuaoSUAO" for state in range(4)}


def search(codes: str, start: int, ends: tuple[int, ...]) -> tuple[int, str, int] | None:
    """Least (cost, audit, end state) from ``start`` before the first row to one of ``ends`` after the last one.

    Heaps are ordered by cost, then by rows read: an edge without cost reads a row, so a node leaves the heap only when
    all its equally cheap labels are known. Of those the least prefix or suffix is the label.
    """
    n = len(codes)
    ahead, behind = {(0, start): (0, "")}, {(n, e): (0, "", e) for e in ends}
    forward, backward = [(0, 0, start)], [(0, 0, e) for e in ends]
    done_f: set[tuple[int, int]] = set()
    done_b: set[tuple[int, int]] = set()
    best: int | None = None
    while True:
        while forward and (forward[0][1], forward[0][2]) in done_f:
            heapq.heappop(forward)
        while backward and (n - backward[0][1], backward[0][2]) in done_b:
            heapq.heappop(backward)
        if not forward or not backward or (best is not None and forward[0][0] + backward[0][0] > best):
            break
        if forward[0][0] <= backward[0][0]:
            cost, at, state = heapq.heappop(forward)
            done_f.add((at, state))
            said = ahead[at, state][1]
            if (at, state) in behind:
                total = cost + behind[at, state][0]
                best = total if best is None else min(best, total)
            moves = [(INSERT, "I", at, NEEDS[state])]
            if at < n:
                moves += [(c, e, at + 1, to) for c, e, to in _STEPS[codes[at], state]]
            for c, e, i, q in moves:
                label = (cost + c, said + e)
                old = ahead.get((i, q))
                if (i, q) not in done_f and (old is None or label < old):
                    ahead[i, q] = label
                    heapq.heappush(forward, (cost + c, i, q))
        else:
            cost, left, state = heapq.heappop(backward)
            at = n - left
            done_b.add((at, state))
            _, said, end = behind[at, state]
            if (at, state) in ahead:
                total = cost + ahead[at, state][0]
                best = total if best is None else min(best, total)
            moves = [(INSERT, "I", at, q) for q in _INTO[state]]
            if at:
                moves += [(c, e, at - 1, q) for c, e, q in _BACK[codes[at - 1], state]]
            for c, e, i, q in moves:
                label = (cost + c, e + said, end)
                old = behind.get((i, q))
                if (i, q) not in done_b and (old is None or label < old):
                    behind[i, q] = label
                    heapq.heappush(backward, (cost + c, n - i, q))
    # every cheapest path has a node done by both searches, or an edge from a node done forward to one done backward
    found: tuple[int, str, int] | None = None
    for at, state in done_f:
        cost, said = ahead[at, state]
        crossings = [(0, "", at, state), (INSERT, "I", at, NEEDS[state])]
        if at < n:
            crossings += [(c, e, at + 1, to) for c, e, to in _STEPS[codes[at], state]]
        for c, e, i, q in crossings:
            if (i, q) in done_b or (i == n and q in ends):
                more, rest, end = behind[i, q]
                label = (cost + c + more, said + e + rest, end)
                if found is None or label < found:
                    found = label
    return found


@lru_cache(1 << 14)
def piece_table(codes: str, entries: tuple[int, ...] = (START, SYSTEM, USER, ASSISTANT), exits: tuple[int, ...] = (START, SYSTEM, USER, ASSISTANT)) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest (cost, audit) of a piece of rows from each state to each state that can be reached."""
    out = {}
    for a in entries:
        for b in exits:
            found = search(codes, a, (b,))
            if found is not None:
                out[a, b] = found[:2]
    return out


@lru_cache(1 << 14)
def _short_audit(codes: str) -> tuple[int, str]:
    return search(codes, START, LEGAL_ENDS)[:2]


def join_pieces(tables: Iterator[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str]:
    """The cheapest legal (cost, audit) of pieces in order."""
    labels: dict[int, tuple[int, str]] = {START: (0, "")}
    for table in tables:
        after: dict[int, tuple[int, str]] = {}
        for (a, b), (cost, said) in table.items():
            if a in labels:
                label = (labels[a][0] + cost, labels[a][1] + said)
                if b not in after or label < after[b]:
                    after[b] = label
        labels = after
    return min(labels[e] for e in LEGAL_ENDS if e in labels)


def cheapest_audit(codes: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    if len(codes) <= PIECE:
        return _short_audit(codes)
    return join_pieces(piece_table(codes[k : k + PIECE]) for k in range(0, len(codes), PIECE))


def apply_audit(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns, read along with the rows; deleted rows are left out."""
    state = START
    for edit in audit:
        if edit == "I":
            state = NEEDS[state]
            yield edit, NAMES[state], ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = KEEPS[role[:1], state]
            yield edit, role, text
        elif edit == "R":
            state = NEEDS[state]
            yield edit, NAMES[state], text


# ---------------------------------------------------------------- reading conversations

#: What is counted over the rows of a conversation.
COUNTS = ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal")
SUMMARY = "conv {id}, " + ", ".join(f"{c} long" for c in COUNTS) + ", cost long, audit string, repaired_sha256 string"
TURNS = "conv {id}, place long, edit string, role string, text string"
LEGAL_PAIRS = {"su", "ua", "au"}


def _fault(role: str, text: str, seen: set) -> str:
    visible = text.rstrip(SPACE)
    if not visible:
        return "blank"
    mark = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=24).digest() if len(text) > 64 else text
    if (role, mark) in seen:
        return "duplicate"
    seen.add((role, mark))
    return "" if visible[-1] in ".!?" else "truncated"


def _hashed(repaired: Iterator[tuple[str, str, str]]) -> str:
    digest, first = hashlib.sha256(), True
    for _, role, text in repaired:
        digest.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode("utf-8"))
        first = False
    return digest.hexdigest()


def _summary(turns: list, rows: list[tuple[str, str]]) -> tuple:
    """Counts, cost and audit of one conversation's rows in order."""
    seen: set = set()
    faults = [_fault(role, text, seen) for role, text in rows]
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit = cheapest_audit("".join(map(row_code, initials, faults)))
    return len(rows), gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, turns, rows) of conversations that arrive in order; rows that only name their conversation are left out."""
    current, turns, rows, begun = None, [], [], False
    for batch in batches:
        for conv, turn, role, text, here in zip(*(c.to_pylist() for c in batch.columns[:5])):
            if not begun or conv != current:
                if begun:
                    yield current, turns, rows
                current, turns, rows, begun = conv, [], [], True
            if here:
                turns.append(turn)
                rows.append((role, text))
    if begun:
        yield current, turns, rows


def _written(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)


def _repair(as_turns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, id_type = 0, pa.null()

        def peeked():
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(0).type
                yield batch

        names = ["conv", "place", "edit", "role", "text"] if as_turns else ["conv", *COUNTS, "cost", "audit", "repaired_sha256"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string()] if as_turns else [pa.int64()] * 7 + [pa.string()] * 2
        for conv, turns, rows in _conversations(peeked()):
            made = _summary(turns, rows)
            repaired = apply_audit(made[-1], iter(rows))
            if as_turns:
                out += [(conv, k, *turn) for k, turn in enumerate(repaired)]
                held += sum(len(text) for _, text in rows)
            else:
                out.append((conv, *made, _hashed(repaired)))
                held += len(made[-1])
            if len(out) >= 4096 or held > 4 << 20:
                yield _written(out, names, [id_type, *kinds])
                out, held = [], 0
        if out:
            yield _written(out, names, [id_type, *kinds])

    return run


# ---------------------------------------------------------------- long conversations


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, at, code, range) in order within a range -> one row per piece: first place, costs and audits from state to state."""

    def solved(conv, at, codes):
        table = piece_table("".join(codes))
        return conv, at, [a * 4 + b for a, b in table], [c for c, _ in table.values()], [s for _, s in table.values()]

    current, at, codes, out, id_type = (None, 0), 0, [], [], pa.null()
    for batch in batches:
        id_type = batch.column(0).type
        for conv, place, code, part in zip(*(c.to_pylist() for c in batch.columns)):
            if codes and ((conv, part) != current or len(codes) == PIECE):
                out.append(solved(current[0], at, codes))
                codes = []
            if not codes:
                current, at = (conv, part), place
            codes.append(code)
        if len(out) >= 256:
            yield _written(out, ["conv", "at", "ways", "costs", "audits"], [id_type, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())])
            out = []
    if codes:
        out.append(solved(current[0], at, codes))
    if out:
        yield _written(out, ["conv", "at", "ways", "costs", "audits"], [id_type, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())])


def _joined_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> (conv, cost, audit)."""
    id_type = pa.null()

    def pieces():
        nonlocal id_type
        for batch in batches:
            id_type = batch.column(0).type
            for conv, ways, costs, audits in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                yield conv, {divmod(w, 4): (c, s) for w, c, s in zip(ways, costs, audits)}

    stream = pieces()
    ahead = next(stream, None)
    while ahead is not None:
        conv = ahead[0]

        def own():
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                yield ahead[1]
                ahead = next(stream, None)

        cost, audit = join_pieces(own())
        yield _written([(conv, cost, audit)], ["conv", "cost", "audit"], [id_type, pa.int64(), pa.string()])


def _streamed(as_turns: bool):
    """(conv, at, role, text) in order, each conversation led by its audit at place -1 -> digests or repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = pa.null()

        def rows():
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(0).type
                yield from zip(*(c.to_pylist() for c in batch.columns))

        stream = rows()
        lead = next(stream, None)
        while lead is not None:
            conv, _, _, audit = lead
            lead = None

            def own():
                nonlocal lead
                for row in stream:
                    if row[1] < 0:
                        lead = row
                        return
                    yield row[2], row[3]

            texts = own()
            repaired = apply_audit(audit, texts)
            if not as_turns:
                yield _written([(conv, _hashed(repaired))], ["conv", "repaired_sha256"], [id_type, pa.string()])
            else:
                out, held = [], 0
                for k, turn in enumerate(repaired):
                    out.append((conv, k, *turn))
                    held += len(turn[2])
                    if held > 4 << 20 or len(out) >= 4096:
                        yield _written(out, ["conv", "place", "edit", "role", "text"], [id_type, pa.int64(), pa.string(), pa.string(), pa.string()])
                        out, held = [], 0
                if out:
                    yield _written(out, ["conv", "place", "edit", "role", "text"], [id_type, pa.int64(), pa.string(), pa.string(), pa.string()])
            for _ in texts:  # rows after the last edit that is read
                pass

    return run


def _long(rows: DataFrame, id_type: str, as_turns: bool) -> DataFrame:
    """The result for rows of long conversations: ordered by ranges over many tasks, joined by what is small."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    rows = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("tie"))
    same = [F.coalesce(F.col("conv").cast("string"), F.lit("null")).alias("who"), "role", F.sha2("text", 256).alias("digest")]
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    facts = materialize(rows.select("conv", "at", "turn", *same, blank.alias("blank"), cut.alias("cut")))
    first = facts.where("not blank").groupBy("who", "role", "digest").agg(F.min("at").alias("first"))
    facts = join_hot(facts.where("not blank"), first, ["who", "role", "digest"], F.col("at")).unionByName(facts.where("blank"), allowMissingColumns=True)
    initial = F.substring("role", 1, 1)
    again = ~F.col("blank") & (F.col("first") < F.col("at"))
    code = F.when(F.col("blank") | again, "d").otherwise(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
    facts = facts.select("conv", "at", "turn", "blank", again.alias("again"), (F.col("cut") & ~F.col("blank") & ~again).alias("cut"), initial.alias("initial"), code.alias("code"))
    facts = facts.withColumn("code", F.when(F.col("cut"), F.upper("code")).otherwise(F.col("code")))
    by_place = [F.col("conv").asc_nulls_first(), "at"]
    # files are read in any order, so a row carries the range it was stored in
    facts = materialize(facts.repartitionByRange(*by_place).sortWithinPartitions(*by_place).withColumn("range", F.spark_partition_id()))
    pieces = facts.select("conv", "at", "code", "range").mapInArrow(_piece_rows, f"conv {id_type}, at long, ways array<int>, costs array<long>, audits array<string>")
    audits = materialize(pieces.repartition("conv").sortWithinPartitions(*by_place).mapInArrow(_joined_pieces, f"conv {id_type}, cost long, audit string"))
    led = audits.select("conv", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text")).unionByName(rows.select("conv", "at", "role", "text"))
    led = led.repartition("conv").sortWithinPartitions(*by_place)
    if as_turns:
        return led.mapInArrow(_streamed(True), TURNS.format(id=id_type))
    digests = led.mapInArrow(_streamed(False), f"conv {id_type}, repaired_sha256 string")
    # neighbours inside a stored range by a window over it, neighbours across ranges from the ranges' ends
    inside = W.partitionBy("range", "conv").orderBy("at")
    pairs = facts.select("conv", F.col("initial").alias("b"), F.lag("initial").over(inside).alias("a"))
    ends = facts.groupBy("conv", "range").agg(F.min_by("initial", "at").alias("b"), F.max_by("initial", "at").alias("z"), F.min("at").alias("at"))
    ends = ends.select("conv", "b", F.lag("z").over(W.partitionBy("conv").orderBy("at")).alias("a"))
    odd = pairs.unionByName(ends).where(F.col("a").isNotNull() & ~F.concat("a", "b").isin(*LEGAL_PAIRS)).groupBy("conv").agg(F.count("*").alias("illegal"))
    distinct = facts.where("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    sums = facts.groupBy("conv").agg(F.count("*").alias("n_rows"), *(F.count_if(c).alias(n) for c, n in (("blank", "blank"), ("again", "duplicate"), ("cut", "truncated"))))
    for more in (distinct, odd, audits, digests):  # one row per long conversation each
        more = more.withColumnRenamed("conv", "other")
        sums = sums.join(more, F.col("conv").eqNullSafe(F.col("other")), "left").drop("other")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return sums.select("conv", *(zero(c) for c in COUNTS), "cost", "audit", "repaired_sha256")


# ---------------------------------------------------------------- the operator


def _solve(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None, as_turns: bool, long_rows: int, long_bytes: int) -> DataFrame:
    small_batches(turns.sparkSession)
    id_type = turns.schema[conv_col].dataType.simpleString()
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), F.when(here, said(text_col)).otherwise("").alias("text"), here.alias("here"))
    sizes = rows.groupBy("conv").agg(F.count_if("here").alias("n"), F.sum(F.octet_length("text")).alias("b")).where((F.col("n") > long_rows) | (F.col("b") > long_bytes))
    sizes = materialize(sizes.select(F.col("conv").alias("long_conv")))
    long = None
    if not sizes.isEmpty():
        is_long = F.col("conv").eqNullSafe(F.col("long_conv"))
        # identical rows are told apart by their place in the input, so that ranges can part them
        numbered = rows.where("here").withColumn("tie", F.monotonically_increasing_id())
        long = _long(numbered.join(sizes, is_long, "left_semi"), id_type, as_turns)
        rows = rows.join(sizes, is_long, "left_anti")
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    out = rows.repartition("conv").sortWithinPartitions(*order).mapInArrow(_repair(as_turns), (TURNS if as_turns else SUMMARY).format(id=id_type))
    out = out if long is None else out.unionByName(long)
    return out.withColumnRenamed("conv", conv_col)


def repair_summary(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row per conversation: id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: turn numbers missing between the first and the last; illegal: neighbours whose role initials are not su, ua or au;
    repaired_sha256: of the repaired ``role:text`` lines. Where ``present`` is false a row only names its conversation.
    """
    return _solve(turns, conv_col, turn_col, role_col, text_col, present, False, long_rows, long_bytes)


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired conversations as rows: id, place (from 0), edit (K kept, R new role, I inserted), role, text."""
    return _solve(turns, conv_col, turn_col, role_col, text_col, present, True, long_rows, long_bytes)


def damage(turns: DataFrame) -> DataFrame:
    """conversations with the faults that the registered query repairs, drawn by crc32 of ``conv_id:turn``; adds ``present``.

    Of twenty values 0 drops a row (present is false), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its
    role user. Nulls count as one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), drawn.alias("drawn"))
    copies = F.explode(F.when(F.col("drawn") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    text = F.when(F.col("drawn") == 1, "").when(F.col("drawn") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("drawn") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("drawn") != 0).alias("present"), copies).drop("copy")
