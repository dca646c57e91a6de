"""Exact set-similarity join of documents on word n-grams by a token-group matrix.

A document's set is its distinct n-word shingles, held as 64-bit tokens. Two documents link when
``100 * |A & B| >= share * |A | B|``. The result is a class id per document, not all pairs.

1. Equal sets collapse to one class, so thousands of copies cost one member.
2. Prefixes: of a set of n tokens in hash order only the first ``prefix_length(n)`` are listed. Linked sets share at least
   ``needed(n)`` listed tokens (see there). A class whose listed tokens occur in too few other classes links with none
   and leaves; a passage that many documents share does not keep a class here. Only the texts that stay are read again.
3. Groups: the classes are partitioned into groups of similar sets. Each round puts every class under one of its tokens
   (another min-hash each round), compares blocks of at most ``BLOCK`` classes exactly and joins what links. From the
   second round on one member stands for all of a group, so rows grow with the members, not with their square.
4. Matrix: the token union of every group is stored, one row per (token, group).
5. Bound: how many listed tokens of a query class the union of another group holds. A query opens only groups that hold at
   least ``needed`` of them. Hot tokens, those of very many groups, are not counted pair by pair: each class subtracts its
   number of them from what it needs. Classes that hardly list anything else are bounded again by all their tokens; those
   that hot tokens alone can link are compared in blocks of such crowds (``_alike_by_hot_tokens``).
6. Opened groups are compared with the query member by member, exactly, in blocks; members of one group are linked
   already and never meet again.
7. Components of the links give each class, then each document, its smallest reachable id.

Null, empty and blank texts have no shingles, size 0, and are linked with nothing. Texts with fewer than n words are one
shingle. Repeated rows come out once per row; rows that share an id but not a text are classed by their own text. Rows
without an id take the component of their text's class, null if no row of that component has an id. An empty table gives
an empty result. Extra columns are ignored here and kept by ``keep_one_of_each``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, flat_gather, join_hot, lower_ascii, materialize, mix, small_batches, span_hashes, text_slices, word_bounds
from .graph import components

#: Classes of a block, and shingles they hold together: blocks are compared in one step of a task.
BLOCK, BLOCK_SHINGLES = 1024, 1_500_000
#: A listed token of more groups than this is not counted pair by pair.
HOT_GROUPS = 64
#: Rounds that join similar sets to groups before the matrix is made.
ROUNDS = 3
#: Tokens whose rows are spread over tasks at random: at most so many, each in about 64 * SPREAD_CLASSES classes or more.
SPREAD_TOKENS, SPREAD_CLASSES = 4096, 64
#: Rows of (id, digest) that may be broadcast, about 30 bytes each.
BROADCAST_ROWS = 200_000


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    for _, _, data, offsets in text_slices(column):
        low = lower_ascii(data)
        starts, ends, first = word_bounds(low, offsets)
        h = span_hashes(low, starts, ends)
        joined = h.copy()
        for k in range(1, words):
            joined[: len(h) - k] = mix(joined[: len(h) - k] * np.uint64(0x9FB21C651E98DF25) + h[k:])
        bounds = first.tolist()
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= words:
                yield np.unique(joined[a : b - words + 1])
            elif b > a:
                short = h[a : a + 1].copy()
                for k in range(a + 1, b):
                    short = mix(short * np.uint64(0x9FB21C651E98DF25) + h[k])
                yield mix(short + np.uint64(b - a))
            else:
                yield h[:0]


def least_overlap(n: int, share: int) -> int:
    """The fewest tokens that a set of n has in common with a linked set."""
    return -(-share * n // 100)


def _extra(n: int) -> int:
    return max(1, n // 10)


def prefix_length(n: int, share: int) -> int:
    """How many tokens of a set of n are listed, the smallest first."""
    return min(n, n - least_overlap(n, share) + _extra(n))


def needed(n: int, share: int) -> int:
    """The fewest listed tokens that a set of n shares with the listed tokens of a linked set.

    With o common tokens, the j-th of them is within the first n - o + j of either set. o is at least each side's
    ``least_overlap``, so the first ``_extra`` of the smaller side are listed on both; the smaller side has at least
    ``least_overlap(n)`` tokens.
    """
    smallest = least_overlap(n, share)
    return min(_extra(smallest), smallest)


def _set_keys(tokens: np.ndarray, key_bits: int) -> tuple[int, int]:
    """Two signed 64-bit keys of a whole set; 0 for the empty one."""
    if not len(tokens):
        return 0, 0
    sums = np.array([mix(tokens).sum(dtype=np.uint64), mix(tokens ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64)], np.uint64)
    a, b = mix(sums + np.uint64(len(tokens)))
    return int((a >> np.uint64(64 - key_bits)).view(np.int64)), int(b.view(np.int64))


def _sketch(words: int, share: int, key_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, checks, needs, listed, counts = [], [], [], [], [], []
            seen: set[tuple[int, int]] = set()  # copies within a batch list their tokens once
            for tokens in shingle_sets(batch.column(2), words):
                n, key = len(tokens), _set_keys(tokens, key_bits)
                found = tokens[: 0 if key in seen else prefix_length(n, share)]
                seen.add(key)
                sizes.append(n)
                keys.append(key[0])
                checks.append(key[1])
                needs.append(needed(n, share) if n else 0)
                listed.append(found)
                counts.append(len(found))
            offsets = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int32)
            prefixes = pa.ListArray.from_arrays(pa.array(offsets), pa.array((np.concatenate(listed) if listed else np.zeros(0, np.uint64)).view(np.int64)))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(needs, pa.int32()), prefixes],
                ["id", "digest", "n_shingles", "cls", "check", "need", "prefix"],
            )

    return run


SKETCH = "id long, digest long, n_shingles long, cls long, check long, need int, prefix array<long>"


def _token_lists(words: int, key_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [t for t in shingle_sets(batch.column(0), words) if len(t)]
            keys = [_set_keys(t, key_bits) for t in sets]
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(t) for t in sets], pa.int64()), pa.array([t.tobytes() for t in sets], pa.binary())], ["cls", "check", "n_shingles", "tokens"])

    return run


def _shared_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (token, cls) rows sorted by both: each distinct row whose token has another class. Looks one row back and ahead only."""
    last: np.ndarray | None = None  # (token, cls, whether it is out already)
    for batch in batches:
        token, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last is not None:
            token, cls = np.concatenate((last[:1], token)), np.concatenate((last[1:2], cls))
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        at = np.flatnonzero(new)
        token, cls = token[at], cls[at]
        same = token[1:] == token[:-1]
        out = np.zeros(len(token), bool)
        out[1:] |= same
        out[:-1] |= same
        came = last is not None and bool(last[2])
        if came:
            out[0] = False
        done = int(out[-1]) or (came and len(token) == 1)
        last = np.array([token[-1], cls[-1], int(done)], np.int64)
        yield pa.record_batch([pa.array(token[out]), pa.array(cls[out])], ["token", "cls"])


# ---------------------------------------------------------------- exact comparison


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def compare(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, share: int) -> list[tuple[int, int]]:
    """Links (as member, local root) between ``left`` and the other sets; among all of them when everything is left."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    parent = np.arange(len(sets))
    opened = ~left if not left.all() else left
    queries = np.flatnonzero(left)
    # the opened side's matrix: members by token
    inside = opened[owner]
    order = np.argsort(tokens[inside], kind="stable")
    column, member = tokens[inside][order], owner[inside][order]
    union, at, held = np.unique(column, return_index=True, return_counts=True)

    def linked(q: int) -> np.ndarray:
        mine = sets[q]
        place = np.searchsorted(union, mine)
        place[place == len(union)] = 0
        hit = place[union[place] == mine]
        if 100 * len(hit) < share * len(mine):  # the union covers too little: no member can link
            return hit[:0]
        overlap = np.bincount(member[flat_gather(at[hit], held[hit])], minlength=len(sets))
        return np.flatnonzero((100 * overlap >= share * (sizes + len(mine) - overlap)) & opened)

    def join(q: int, others: np.ndarray) -> None:
        for m in others.tolist():
            a, b = _root(parent, q), _root(parent, m)
            if a != b:
                parent[max(a, b)] = min(a, b)

    if left.all():
        # the set whose tokens most others hold comes first: what links with it needs no comparison among itself
        weight = np.bincount(member, weights=np.repeat(held, held), minlength=len(sets)) / np.maximum(sizes, 1)
        near = linked(int(weight.argmax()))
        join(int(weight.argmax()), near)
        queries = np.setdiff1d(queries, near, assume_unique=True)
    for q in queries.tolist():
        join(q, linked(q))
    return [(int(ids[k]), int(ids[_root(parent, k)])) for k in range(len(sets)) if _root(parent, k) != k]


def _compare_blocks(share: int):
    """(three key columns, side, member, tokens) rows sorted by key -> links. Side 0 meets side 1, or itself without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []

        def close(rows: list[tuple[int, int, bytes]]) -> None:
            rows = list({member: (side, member, tokens) for side, member, tokens in rows}.values())
            sides = np.array([s == 0 for s, *_ in rows])
            if len(rows) > 1 and sides.any():
                links.extend(compare(np.array([m for _, m, _ in rows]), [np.frombuffer(t, np.uint64) for *_, t in rows], sides, share))

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])
            links.clear()
            return out

        key, rows = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for row in zip(zip(*columns[:3]), *columns[3:]):
                if row[0] != key:
                    close(rows)
                    key, rows = row[0], []
                rows.append(row[1:])
            yield flush()
        close(rows)
        yield flush()

    return run


def _opened(rows: DataFrame, tokens: DataFrame, key: list[str], share: int) -> DataFrame:
    """Links (a, b) of rows (key, side, cls): every key is one comparison."""
    rows = rows.join(tokens.select("cls", "tokens"), "cls").select(*key, "side", F.col("cls").alias("member"), "tokens")
    return materialize(rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare_blocks(share), "a long, b long"))


def _blocks(n: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(shingles / F.lit(BLOCK_SHINGLES))).cast("int")


# ---------------------------------------------------------------- the steps


def _listed_by_several(sketched: DataFrame) -> DataFrame:
    """(token, cls) of the listed tokens that more than one class lists."""
    entries = lambda rows: rows.where(F.size("prefix") > 0).select(F.explode("prefix").alias("token"), "cls")
    # where rows go, not what they are: a token of very many classes would fill one task, so its rows are spread
    some = entries(sketched.where(F.pmod(F.xxhash64("cls"), F.lit(64)) == 0)).groupBy("token").agg(F.count_distinct("cls").alias("n"))
    spread = materialize(some.where(F.col("n") >= SPREAD_CLASSES).orderBy(F.desc("n"), "token").limit(SPREAD_TOKENS).select("token"))
    rows, wide = entries(sketched), not spread.isEmpty()
    single = rows.join(F.broadcast(spread), "token", "left_anti") if wide else rows  # SPREAD_TOKENS rows at most
    out = single.select("token", "cls").repartition("token").sortWithinPartitions("token", "cls").mapInArrow(_shared_entries, "token long, cls long")
    if wide:
        out = out.unionByName(rows.join(F.broadcast(spread), "token", "left_semi").distinct())
    return materialize(out)


def _still_able(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """The entries of classes that share at least what they need, and of tokens that several of these still list."""
    enough = shared.groupBy("cls").agg(F.count("*").alias("n")).join(classes.select("cls", "need"), "cls").where("n >= need").select("cls")
    left = shared.join(enough, "cls", "left_semi")
    several = left.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    return materialize(left.join(several, "token", "left_semi"))


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds grp, the class's component so far."""
    if labels is None:
        return rows.withColumn("grp", F.col("cls"))
    return rows.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("grp", F.coalesce("component", "cls")).drop("component")


def _groups(shared: DataFrame, sizes: DataFrame, tokens: DataFrame, share: int) -> DataFrame | None:
    """(node, component) of the classes that the rounds have linked."""
    labels = None
    for k in range(ROUNDS):
        placed = shared.groupBy("cls").agg(F.min_by("token", F.xxhash64("token", F.lit(k))).alias("token"))
        stands = _labelled(placed, labels).groupBy("token", "grp").agg(F.min("cls").alias("cls")).join(sizes, "cls")
        stands = materialize(stands)
        crowds = stands.groupBy("token").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("held")).where("n > 1")
        crowds = crowds.select("token", _blocks(F.col("n"), F.col("held")).alias("blocks"))
        rows = stands.join(crowds, "token").select("token", F.pmod(F.xxhash64("cls", F.lit(k)), "blocks").cast("int").alias("block"), F.lit(0).alias("other"), F.lit(0).alias("side"), "cls")
        links = _opened(rows, tokens, ["token", "block", "other"], share)
        known = links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        found = components(known)
        discard(stands, links, *([] if labels is None else [labels]))
        labels = found
    return labels


def _held_by_groups(entries: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (token, cls): the token union of every group as (token, grp), and (token, cls, grp, groups) of the tokens that several groups hold."""
    entries = _labelled(entries, labels)
    union = materialize(entries.select("token", "grp").distinct())
    held = union.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1")
    return union, materialize(entries.join(held, "token"))


def _bounded(crossing: DataFrame, union: DataFrame, asks: DataFrame) -> DataFrame:
    """(cls, grp): the groups whose union holds at least ``need`` of the cold tokens of a class in asks (cls, need)."""
    query = crossing.where(F.col("groups") <= HOT_GROUPS).join(asks, "cls").select("token", "cls", "need", F.col("grp").alias("own"))
    met = query.join(union, "token").where("own <> grp").groupBy("cls", "grp").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    return materialize(met.where("n >= need").select("cls", "grp"))


def _all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(t, np.int64) for t in batch.column(1).to_pylist()]
        cls = np.repeat(batch.column(0).to_numpy(), [len(t) for t in sets])
        yield pa.record_batch([pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)), pa.array(cls)], ["token", "cls"])


def _alike_by_hot_tokens(hot: DataFrame, sizes: DataFrame, tokens: DataFrame, share: int) -> DataFrame:
    """Links (a, b) among classes that hot tokens alone can link, from (token, cls, groups): large crowds of sets just around the threshold.

    Sets that link share one of their rarest hot tokens, as many as cannot all be missing. Classes are brought together
    along these tokens, and each crowd is compared block by block: a class is shipped once per block of its crowd.
    """
    held = hot.groupBy("cls").agg(F.count("*").alias("h")).join(sizes, "cls").where(100 * F.col("h") >= share * F.col("n_shingles"))
    order = W.partitionBy("cls").orderBy("groups", "token")
    rare = hot.join(held, "cls").withColumn("place", F.row_number().over(order))
    rare = materialize(rare.where(F.col("place") <= F.col("h") - F.ceil(share * F.col("n_shingles") / F.lit(100)) + 1).select("token", "cls"))
    first = rare.groupBy("token").agg(F.min("cls").alias("first"))
    crowds = components(rare.join(first, "token").select(F.col("cls").alias("a"), F.col("first").alias("b")).distinct())
    members = crowds.select(F.col("node").alias("cls"), F.col("component").alias("crowd")).join(sizes, "cls")
    counts = members.groupBy("crowd").agg(F.count("*").alias("n"), _blocks(F.count("*"), F.sum("n_shingles")).alias("blocks")).where("n > 1")
    placed = materialize(members.join(counts, "crowd").select("crowd", "cls", "blocks", F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("own")))
    mine = placed.select("crowd", F.col("own").alias("block"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("other"), F.lit(0).alias("side"), "cls")
    theirs = placed.where("own > 0").select("crowd", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("block"), F.col("own").alias("other"), F.lit(1).alias("side"), "cls")
    links = _opened(mine.unionByName(theirs), tokens, ["crowd", "block", "other"], share)
    discard(rare, crowds, placed)
    return links


def _queries_and_groups(shared: DataFrame, classes: DataFrame, tokens: DataFrame, labels: DataFrame, share: int) -> tuple[DataFrame, DataFrame | None]:
    """(cls, grp): the groups that each class must open; and links that need no opening."""
    is_hot = F.col("groups") > HOT_GROUPS
    counts = (F.count("*").alias("n"), F.count_if(is_hot).alias("hot"))
    union, crossing = _held_by_groups(shared, labels)
    asks = materialize(crossing.groupBy("cls").agg(*counts).join(classes.select("cls", "need"), "cls").where("n >= need").select("cls", (F.col("need") - F.col("hot")).alias("need")))
    met = _bounded(crossing, union, asks.where("need > 0"))
    heavy = materialize(asks.where("need <= 0").select("cls"))
    discard(union, crossing)
    if heavy.isEmpty():
        return met, None
    # listed tokens that are mostly hot do not bound these classes: all their tokens do, against each other
    sizes = classes.select("cls", "n_shingles")
    entries = tokens.select("cls", "tokens").join(heavy, "cls", "left_semi").mapInArrow(_all_tokens, "token long, cls long")
    union, crossing = _held_by_groups(entries, labels)
    need = F.ceil(F.col("n_shingles") * share / F.lit(100)).cast("long")
    asks = crossing.groupBy("cls").agg(*counts).join(sizes, "cls").where(F.col("n") >= need)
    asks = materialize(asks.select("cls", F.greatest(F.lit(1), need - F.col("hot")).alias("need")))
    more = _bounded(crossing, union, asks)
    hot = crossing.where(is_hot).join(asks.select("cls"), "cls", "left_semi").select("token", "cls", "groups")
    alike = _alike_by_hot_tokens(hot, sizes, tokens, share)
    discard(union, crossing)
    return met.unionByName(more).distinct(), alike


def _across(met: DataFrame, members: DataFrame, sizes: DataFrame, tokens: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between queries and the members of the groups that they open, in blocks of both."""
    met = materialize(met.join(sizes, "cls"))
    asked = met.groupBy("grp").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("others"))
    opened = members.join(asked, "grp").join(sizes, "cls")
    counts = opened.groupBy("grp").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("blocks"), F.first("others").alias("others"))
    counts = materialize(counts)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    query = met.join(counts, "grp").select("grp", each("blocks").alias("block"), part("others").alias("other"), F.lit(0).alias("side"), "cls")
    member = members.join(counts, "grp").select("grp", part("blocks").alias("block"), each("others").alias("other"), F.lit(1).alias("side"), "cls")
    links = _opened(query.unionByName(member), tokens, ["grp", "block", "other"], share)
    discard(met, counts)
    return links


def _classified(docs: DataFrame, words: int, share: int, key_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (id, digest, text): rows (id, digest, n_shingles, cls), classes (cls, class_id), components (cls, component) of linked classes."""
    if not 50 < share <= 100:
        raise ValueError("share is in hundredths, above 50")
    small_batches(docs.sparkSession)
    sketched = materialize(docs.select("id", "digest", "text").mapInArrow(_sketch(words, share, key_bits), SKETCH))
    grouped = lambda rows: rows.where("n_shingles > 0").groupBy("cls", "check", "n_shingles").agg(F.min("id").alias("class_id"), F.first("need").alias("need"))
    classes = materialize(grouped(sketched))
    clashes = materialize(classes.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls", F.lit(True).alias("clash")))
    rekeyed = lambda rows: rows
    if not clashes.isEmpty():  # different sets with one key: both keys together name them
        rekeyed = lambda rows: rows.join(clashes, "cls", "left").withColumn("cls", F.when(F.col("clash"), F.xxhash64("cls", "check", "n_shingles")).otherwise(F.col("cls"))).drop("clash")
        sketched, classes = materialize(rekeyed(sketched)), materialize(rekeyed(classes))
        if not classes.groupBy("cls").count().where("count > 1").isEmpty():
            raise ValueError("two different sets share three keys")

    rows = materialize(sketched.select("id", "digest", "n_shingles", "cls"))
    shared = _listed_by_several(sketched)
    discard(sketched)
    for _ in range(2):
        before, shared = shared, _still_able(shared, classes)
        discard(before)
    able = materialize(shared.select("cls").distinct())
    # only the texts of these classes are read again; the optimizer broadcasts the ids if their table is small
    chosen = materialize(able.join(classes, "cls").select("cls", "class_id", "n_shingles", "need"))
    ids = materialize(chosen.select(F.col("class_id").alias("_id")).distinct())
    tokens = docs.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text").mapInArrow(_token_lists(words, key_bits), "cls long, check long, n_shingles long, tokens binary")
    tokens = materialize(rekeyed(tokens).join(able, "cls", "left_semi").select("cls", "tokens").dropDuplicates(["cls"]))
    sizes = chosen.select("cls", "n_shingles")
    labels = _groups(shared, sizes, tokens, share)
    met, alike = _queries_and_groups(shared, chosen, tokens, labels, share)
    links = _across(met, _labelled(able, labels), sizes, tokens, share)
    found = components(reduce(DataFrame.unionByName, [links, labels.select(F.col("node").alias("a"), F.col("component").alias("b")), *([alike] if alike is not None else [])]))
    discard(shared, tokens, met if alike is None else alike, links, labels, chosen, able, ids)
    return rows, classes.select("cls", "class_id"), found.withColumnRenamed("node", "cls")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, share: int = 90, key_bits: int = 64) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    rows, classes, found = _classified(_plain(docs, id_col, text_col), words, share, key_bits)
    smallest = classes.join(found, "cls").groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = join_hot(found, smallest, ["component"], F.col("cls"), "inner").select("cls", "component_id")
    named = classes.join(named, "cls", "left").select("cls", F.coalesce("component_id", "class_id").alias("component_id"))
    out = join_hot(rows, named, ["cls"], F.struct("id", "digest"))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: int = 80, key_bits: int = 64) -> DataFrame:
    """One row of each component: that of the smallest id, of equal ids one text of them; columns unchanged.

    A row without an id stays only where its component has no row with one. Of repeated rows (same id, same text) one
    stays. Rows without words are in no component and stay, repeated or not.
    """
    rows, _, found = _classified(_plain(docs, id_col, text_col), words, share, key_bits)
    placed = join_hot(rows.where("n_shingles > 0"), found, ["cls"], F.struct("id", "digest"))
    placed = placed.select(F.coalesce("component", "cls").alias("component"), "id", "digest")
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first"))
    judged = join_hot(placed, first, ["component"], F.struct("id", "digest"), "inner").withColumn("stays", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest")))
    judged = materialize(judged.groupBy("id", "digest").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"))
    gone, again = judged.where("not stays"), judged.where("stays")

    marked = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("digest"))

    def by(right: DataFrame, how: str) -> DataFrame:
        right = F.broadcast(right) if right.count() <= BROADCAST_ROWS else right.hint("shuffle_hash")
        return marked.join(right, marked["id"].eqNullSafe(right["id"]) & (marked["digest"] == right["digest"]), how)

    if again.isEmpty():
        return by(gone, "left_anti").select("row.*")
    return by(judged, "left_anti").unionByName(by(again, "left_semi").dropDuplicates(["id", "digest"])).select("row.*")
