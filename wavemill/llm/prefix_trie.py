"""Conversation prefix trie from sorted sequences: range minima over neighbours' common prefixes.

Every turn gets a name (120 bits of the SHA-256 of its role and text), a conversation is its sequence of names. Sequences
are sorted (ties by id), and for each the number of turns it shares with the one before is its LCP. A sparse table holds the
least LCP of every power-of-two run, so a candidate prefix (a sequence and a depth) finds the first and the last
sequence that begin with it by two binary searches, each on its own. Sequences i with LCP[i] < d begin a node of depth d;
its members are the interval found. What a subtree holds is a difference of running sums over the interval: childless nodes,
bytes of all turns, bytes of distinct turns. Children are counted as sequences of the interval whose LCP is the depth.

Scale: sequences are dealt by ranges of (sequence, id), so a sequence that a third of all conversations share is cut by
its ids. A range is read in blocks of at most ``BLOCK`` conversations; each block gets the last sequence before it and
the first one after it, and its table covers it alone. Nodes inside a block are finished there. A node that crosses a
block's edge is a prefix of the sequence at that edge; each block writes its part of it (a row per depth), and the parts of
consecutive blocks are added up: these tables have a few rows per block. Texts do not move; names take 16 bytes a turn.
One conversation is held in one row (24 bytes a turn).

Edge cases: null roles and texts are empty, null turns come first, ties in turn go by name. Rows without a conversation id
belong to no conversation. Conversations without turns are members of the root alone. Without any conversation there is no
node. Repeated rows are turns of their own. Very long texts are named in whole. Only the four named columns are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import flat_gather, materialize, small_batches

#: Conversations and turns of one block, whichever is reached first.
BLOCK, BLOCK_TURNS = 1 << 15, 1 << 18
#: Ids in one row where the members that end at a node are spread over blocks.
ID_RUN = 1024
NOTHING = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- sequences


def named_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): one row per conversation, its turns in order as (turn, a, b, bytes); (a, b) names role and text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # the role's length in front keeps (role, text) apart from any other split of the same characters
    digest = F.sha2(F.concat(F.octet_length(said(role_col)).cast("string"), F.lit(":"), said(role_col), said(text_col)), 256)
    part = lambda k: F.conv(F.substring(digest, k, 15), 16, 10).cast("long")
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), part(1).alias("a"), part(16).alias("b"), F.octet_length(said(text_col)).cast("long").alias("bytes"))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), turn.alias("t"))
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_donors(named: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c mod ``every``, h = crc32(c) mod ``most``, and goes on with its own after its first h."""
    h = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
    donors = named.where(F.pmod("conv", F.lit(every)) == 0).select(F.col("conv").alias("donor"), F.slice("turns", 1, most - 1).alias("given"))
    joined = named.withColumn("donor", F.col("conv") - F.pmod("conv", F.lit(every))).join(donors, "donor", "left")
    given = F.slice(F.coalesce("given", F.slice("turns", 1, 0)), F.lit(1), h)
    own = F.filter("turns", lambda t, k: k >= h)
    return joined.select("conv", F.concat(given, own).alias("turns"))


# ---------------------------------------------------------------- one block


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], values


def common_prefixes(offsets: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Turns that each sequence shares with the one before; names has a row of two numbers per turn. The first gets -1."""
    size = np.diff(offsets)
    shared = np.minimum(size[1:], size[:-1])
    at = flat_gather(offsets[1:-1], shared)
    before = flat_gather(offsets[:-2], shared)
    differ = (names[at] != names[before]).any(axis=1)
    place = flat_gather(np.zeros(len(shared), np.int64), shared)
    out = shared.copy()
    owner = np.repeat(np.arange(len(shared)), shared)[differ]
    np.minimum.at(out, owner, place[differ])
    return np.concatenate(([-1], out))


class RangeMinimum:
    """Least value of every run of 2^k places, and binary searches for how far a bound holds."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, width = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-width], last[width:]))

    def last(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The largest r >= at with all of values[at + 1 .. r] >= bound."""
        at = at.copy()
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            fits = at + (1 << k) < len(self.levels[0])
            fits &= level[np.minimum(at + 1, len(level) - 1)] >= bound
            at[fits] += 1 << k
        return at

    def first(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest l <= at with all of values[l + 1 .. at] >= bound."""
        at = at.copy()
        for k in reversed(range(len(self.levels))):
            level, start = self.levels[k], at - (1 << k) + 1
            fits = start >= 1
            fits &= level[np.clip(start, 0, len(level) - 1)] >= bound
            at[fits] -= 1 << k
        return at

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min(values[a .. b])."""
        k = np.frexp((b - a + 1).astype(float))[1] - 1
        out = np.empty(len(a), self.levels[0].dtype)
        for level in np.unique(k):
            own = k == level
            out[own] = np.minimum(self.levels[level][a[own]], self.levels[level][b[own] - (1 << level) + 1])
        return out


NODE = ["kind", "block", "depth", "begins", "goes_on", "conv", "parent", "parent_begins", "n_convs", "n_children", "n_leaves", "saved", "ends", "sha"]
#: kind 0: finished but for an unfinished parent where parent is null; 1: part of a node that crosses an edge; 2: a run of ids that end there (in sha).
NODE_SCHEMA = "kind int, block long, depth long, begins boolean, goes_on boolean, conv long, parent long, parent_begins boolean, n_convs long, n_children long, n_leaves long, saved long, ends long, sha string"


def _block_nodes(block: int, ids: np.ndarray, offsets: np.ndarray, names: np.ndarray, sizes: np.ndarray, before: int, after: int) -> Iterator[pa.RecordBatch]:
    """Nodes and parts of nodes of one block; before and after are the LCPs at its edges (-1: no neighbour)."""
    m, length = len(ids), np.diff(offsets)
    lcp = common_prefixes(offsets, names)
    lcp[0] = before
    following = np.append(lcp[1:], after)
    table, least_id = RangeMinimum(lcp), RangeMinimum(ids)
    running = lambda x: np.concatenate(([0], np.cumsum(x)))
    turn_bytes = running(sizes)
    upto = lambda i, d: turn_bytes[offsets[i] + np.maximum(d, 0)] - turn_bytes[offsets[i]]  # noqa: E731  bytes of the first d turns
    total = turn_bytes[offsets[1:]] - turn_bytes[offsets[:-1]]
    totals, fresh, leaves = running(total), running(total - upto(np.arange(m), lcp)), running(following < length)
    # sequences that open another child, by (depth of the parent, place)
    opens = np.sort((lcp * (m + 1) + np.arange(m))[length > lcp])

    def children(a, b, d):
        return np.searchsorted(opens, d * (m + 1) + b, "right") - np.searchsorted(opens, d * (m + 1) + a, "left")

    # nodes that begin here, then the prefixes of the first sequence that began before
    count = length - lcp
    place = np.concatenate((np.repeat(np.arange(m), count), np.zeros(before + 1, np.int64)))
    depth = np.concatenate((flat_gather(lcp + 1, count), np.arange(before + 1)))
    begins = np.arange(len(place)) < int(count.sum())
    right = table.last(place, depth)
    goes_on = (right == m - 1) & (after >= depth)
    n = right - place + 1
    prefix = upto(place, depth - 1)
    # a part's own first sequence is new below the node only where the node begins; else it is new from its LCP on
    new = fresh[right + 1] - fresh[place + begins]
    saved = totals[right + 1] - totals[place] - n * prefix - new - np.where(begins, total[place] - prefix, 0)
    n_children = children(place + begins, right, depth) + (begins & (length[place] > depth))
    n_leaves = leaves[right + 1] - leaves[place]
    conv = least_id.least(place, right)
    # members that end at a node come first in it, by id: runs of equal sequences
    same_run = (length[1:] == length[:-1]) & (lcp[1:] == length[1:])
    run_starts = np.concatenate(([0], np.flatnonzero(~same_run) + 1))
    run_ends = np.append(run_starts[1:], m)
    run_of = np.searchsorted(run_starts, np.arange(m), "right") - 1
    shas = [hashlib.sha256(",".join(map(str, ids[a:b].tolist())).encode()).hexdigest() for a, b in zip(run_starts.tolist(), run_ends.tolist())]
    ends_here = length[place] == depth
    ends = np.where(ends_here, run_ends[run_of[place]] - place, 0)
    sha = np.full(len(place), NOTHING, dtype=object)
    for k in np.flatnonzero(ends_here).tolist():
        sha[k] = shas[run_of[place[k]]]
    # the parent's members, from its own two searches
    up = depth - 1
    left = table.first(place, up)
    up_right = table.last(place, up)
    # it began before this block if the bound still holds at the first sequence's LCP
    up_begins = ~((left == 0) & (before >= up))
    open_parent = ~up_begins | ((up_right == m - 1) & (after >= up))
    has_parent = depth > 0
    parent = least_id.least(left, up_right)
    kind = np.where(begins & ~goes_on, 0, 1)
    rows = [
        pa.array(kind.astype(np.int32)), pa.array(np.full(len(place), block)), pa.array(depth), pa.array(begins), pa.array(goes_on), pa.array(conv),
        pa.array(parent, mask=open_parent | ~has_parent), pa.array(up_begins), pa.array(n), pa.array(n_children), pa.array(n_leaves), pa.array(saved), pa.array(ends), pa.array(sha, pa.string()),
    ]
    yield pa.record_batch(rows, NODE)
    # ids of members that end at a node with parts in several blocks: only those at an edge can have more there
    for k in np.flatnonzero((kind == 1) & ends_here).tolist():
        a, b = int(place[k]), int(place[k] + ends[k])
        if begins[k] and b < m:
            continue
        said = [",".join(map(str, ids[x : min(x + ID_RUN, b)].tolist())) for x in range(a, b, ID_RUN)]
        for x in range(0, len(said), 256):
            some = said[x : x + 256]
            blank = lambda v, t=None: pa.array([v] * len(some), t)  # noqa: B023, E731
            yield pa.record_batch([
                blank(2, pa.int32()), blank(block, pa.int64()), blank(int(depth[k]), pa.int64()), blank(bool(begins[k])), blank(bool(goes_on[k])), blank(None, pa.int64()), blank(None, pa.int64()), blank(None, pa.bool_()),
                pa.array(range(x, x + len(some)), pa.int64()), blank(0, pa.int64()), blank(0, pa.int64()), blank(0, pa.int64()), blank(0, pa.int64()), pa.array(some, pa.string()),
            ], NODE)


def _cut(block_rows: int, block_turns: int):
    """Rows in order get the number of their block within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = rows = turns = 0
        for batch in batches:
            own = np.empty(len(batch), np.int64)
            for k, n in enumerate(np.diff(batch.column(1).offsets.to_numpy()).tolist()):
                if rows == block_rows or (rows and turns + n // 2 > block_turns):
                    block, rows, turns = block + 1, 0, 0
                rows, turns = rows + 1, turns + n // 2
                own[k] = block
            yield pa.record_batch([*batch.columns, pa.array(own)], [*batch.schema.names, "cut"])

    return run


def _trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, key, sizes, block, role) by block, role (0: the sequence before, 1: members, 2: the sequence after)."""

    def solved(block: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        col = lambda c: rows.column(c).combine_chunks() if rows.column(c).num_chunks != 1 else rows.column(c).chunk(0)
        role = col("role").to_numpy()
        offsets, names = _sequences(col("key"))
        offsets, names = offsets // 2, names.reshape(-1, 2)
        a, b = int((role == 0).sum()), int((role < 2).sum())
        edges = common_prefixes(offsets, names)
        before = int(edges[a]) if a else -1
        after = int(edges[b]) if b < len(role) else -1
        size_offsets, sizes = _sequences(col("sizes"))
        ids = col("conv").to_numpy(zero_copy_only=False)[a:b].astype(np.int64)
        first, last = offsets[a], offsets[b]
        sizes = sizes[size_offsets[a] : size_offsets[b]]
        yield from _block_nodes(block, ids, offsets[a : b + 1] - first, names[first:last], sizes, before, after)

    current, parts = None, []
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for x, y in zip(cuts, cuts[1:]):
            if y > x:
                if parts and blocks[x] != current:
                    yield from solved(current, parts)
                    parts = []
                current = int(blocks[x])
                parts.append(batch.slice(x, y - x))
    if parts:
        yield from solved(current, parts)


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, island, ids) in order -> (depth, island, sha of the ids joined by commas); one digest is open at a time."""
    open_, digest, out = None, None, []
    for batch in batches:
        for depth, island, said in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, island) != open_:
                if open_ is not None:
                    out.append((*open_, digest.hexdigest()))
                open_, digest = (depth, island), hashlib.sha256(said.encode())
            else:
                digest.update(b"," + said.encode())
    if open_ is not None:
        out.append((*open_, digest.hexdigest()))
    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.string()))], ["depth", "island", "whole"])


# ---------------------------------------------------------------- the operator


def prefix_trie(named: DataFrame, block_rows: int = BLOCK, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """From (conv, turns: array of (turn, a, b, bytes)) one row per node of the trie of all conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes of the subtree),
    saved_tokens (bytes of turns that members share, over the subtree), ends_sha256 (of the ids that end at the node).
    """
    small_batches(named.sparkSession)
    key = F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"])))
    rows = materialize(named.select("conv", key.alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("sizes")))
    schema = "conv long, key array<long>, sizes array<long>, part long, cut long"
    rows = rows.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").withColumn("part", F.spark_partition_id().cast("long"))
    rows = materialize(rows.mapInArrow(_cut(block_rows, block_turns), schema).withColumn("block", F.shiftleft("part", 32) + F.col("cut")).drop("part", "cut"))
    # the sequences at the blocks' edges, one row per block
    pair = F.struct("key", "conv")
    edges = materialize(rows.groupBy("block").agg(F.min(pair).alias("low"), F.max(pair).alias("high")))
    order = W.orderBy("block")
    edges = edges.select("block", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    guard = lambda c, role: edges.where(F.col(c).isNotNull()).select(F.lit(None).cast("long").alias("conv"), F.col(f"{c}.key").alias("key"), F.array().cast("array<long>").alias("sizes"), "block", F.lit(role).alias("role"))
    rows = rows.withColumn("role", F.lit(1)).unionByName(guard("before", 0)).unionByName(guard("after", 2))
    rows = rows.repartition("block").sortWithinPartitions("block", "role", "key", "conv")
    nodes = materialize(rows.mapInArrow(_trie, NODE_SCHEMA))
    inside = nodes.where("kind = 0")
    done = inside.where("parent is not null or depth = 0").select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "sha")
    # parts of one node follow each other block by block; a block may end one node and begin the next of the same depth
    chain = W.partitionBy("depth").orderBy("block", "begins").rowsBetween(W.unboundedPreceding, 0)
    parts = materialize(nodes.where("kind = 1").withColumn("island", F.sum(F.col("begins").cast("long")).over(chain)))
    runs = nodes.where("kind = 2").select("block", "depth", "begins", F.col("n_convs").alias("nr"), F.col("sha").alias("said"))
    runs = runs.join(parts.select("block", "depth", "begins", "island"), ["block", "depth", "begins"])
    runs = runs.repartition("depth", "island").sortWithinPartitions("depth", "island", "block", "begins", "nr").select("depth", "island", "said")
    whole = runs.mapInArrow(_hashed_runs, "depth long, island long, whole string")
    several = F.count_if(F.col("ends") > 0)
    islands = parts.groupBy("depth", "island").agg(
        F.min("conv").alias("conv"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), several.alias("several"),
        F.max(F.when(F.col("ends") > 0, F.col("sha"))).alias("sha"), F.min_by(F.struct("block", "parent_begins", "parent"), "block").alias("up"),
    )
    islands = islands.join(whole, ["depth", "island"], "left")
    sha = F.when(F.col("several") > 1, F.col("whole")).otherwise(F.coalesce("sha", F.lit(NOTHING)))
    islands = materialize(islands.withColumn("sha", sha).drop("whole", "several"))
    ids = parts.select("block", F.col("depth").alias("up_depth"), F.col("begins").alias("up_begins"), "island").join(islands.select(F.col("depth").alias("up_depth"), "island", F.col("conv").alias("up_conv")), ["up_depth", "island"]).drop("island")

    def with_parent(rows: DataFrame) -> DataFrame:
        """The parent's smallest member from the parts of the block that the row comes from."""
        rows = rows.join(ids, (rows["at"] == ids["block"]) & (rows["depth"] - 1 == ids["up_depth"]) & (rows["at_begins"] == ids["up_begins"]), "left")
        return rows.select("conv", "depth", F.coalesce("parent", "up_conv").alias("parent"), "n_convs", "n_children", "n_leaves", "saved", "sha")

    crossing = with_parent(islands.select("conv", "depth", F.col("up.parent").alias("parent"), F.col("up.block").alias("at"), F.col("up.parent_begins").alias("at_begins"), "n_convs", "n_children", "n_leaves", "saved", "sha"))
    open_ = with_parent(inside.where("parent is null and depth > 0").select("conv", "depth", "parent", F.col("block").alias("at"), F.col("parent_begins").alias("at_begins"), "n_convs", "n_children", "n_leaves", "saved", "sha"))
    out = done.unionByName(crossing).unionByName(open_)
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))
