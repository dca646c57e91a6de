"""Exact dedup by deterministic block naming.

Normalised text is cut into fixed-size blocks. Equal blocks get one integer name (blocks are sorted, names count
up), then adjacent names are paired and the pairs are named again, halving the length each round, until one name is
left. Texts of equal block count are identical exactly when their last names are equal: names are given to the
block's bytes or to the pair itself, never to a hash, so no collision can merge two texts.

Scale: text bytes cross the shuffle once, and only distinct blocks of each task do; a block shared by a third of all
rows is one row per task. Afterwards only (document, position, integer) rows move. A hash only routes: where two
different blocks share one, that hash is looked up by the bytes themselves.

Null text counts as empty. Empty texts form one group (one block, zero bytes). Repeated rows (same id and text) stay
separate rows of the same group. A null id is larger than any id: such a row is kept only in a group without ids, where all
rows are repeats of each other. Very long texts are many blocks, each named like any other. An empty table gives an empty
result. Other columns are ignored; extra columns cannot clash because output names are taken from the id column and fixed
names only, and rows that stay are carried under names of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_space, join_hot, materialize, small_batches, span_hashes, text_slices

BLOCK_BYTES = 4096


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every white space run replaced by one space, with the new offsets."""
    if not len(data):
        return data, offsets
    space = is_space(data)
    again = np.zeros(len(data), bool)
    again[1:] = space[1:] & space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    again[inner] = False  # a run ends with its text
    kept = np.cumsum(~again)
    out = np.where(space, np.uint8(32), data)[~again]
    return out, np.concatenate(([0], kept))[offsets]


def _blocks(column: pa.Array, size: int, hash_bits: int) -> Iterator[tuple]:
    """Per slice of the column: row range, per text (digest, bytes), block starts and ends, block hash, text of block."""
    shift = np.uint64(64 - hash_bits)
    for i, j, data, offsets in text_slices(column):
        data, offsets = normalised(data, offsets)
        lengths = np.diff(offsets)
        counts = np.maximum(1, -(-lengths // size))
        owner = np.repeat(np.arange(j - i), counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = offsets[owner] + place * size
        ends = np.minimum(starts + size, offsets[owner + 1])
        yield i, j, data, offsets, owner, place, starts, ends, (span_hashes(data, starts, ends) >> shift).astype(np.int64)


def _distinct_blocks(size: int, hash_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, _, _, _, starts, ends, route in _blocks(batch.column(0), size, hash_bits):
                raw = data.tobytes()
                seen = dict.fromkeys((h, raw[a:b]) for h, a, b in zip(route.tolist(), starts.tolist(), ends.tolist()))
                yield pa.record_batch([pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.binary())], ["route", "block"])

    return run


def _block_places(size: int, hash_bits: int, wanted: str):
    """wanted 'texts': one row per text (id, digest, bytes, routes); 'blocks': (id, row, place, route, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets, owner, _, starts, ends, route in _blocks(batch.column(1), size, hash_bits):
                raw = data.tobytes()
                bounds = offsets.tolist()
                digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])]
                cuts = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
                columns = [batch.column(0).slice(i, j - i), pa.array(digests, pa.string()), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(route))]
                names = ["id", "digest", "n_bytes", "routes"]
                if wanted == "blocks":
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())))
                    names.append("blocks")
                yield pa.record_batch(columns, names)

    return run


def _first_names(docs: DataFrame, texts: DataFrame, size: int, hash_bits: int) -> DataFrame:
    """(row, place, name) of every block of the stored ``texts``."""
    # map-side distinct in each task, then one exchange of distinct block bytes; names follow the sorted order
    distinct = docs.select("text").mapInArrow(_distinct_blocks(size, hash_bits), "route long, block binary").distinct()
    named = distinct.sortWithinPartitions("route", "block").withColumn("name", F.monotonically_increasing_id())
    clash = "clash"
    names = materialize(named.select("route", "name", F.sha2("block", 512).alias("check")))
    shared = materialize(names.groupBy("route").agg(F.count("*").alias("n")).where("n > 1").select("route", F.lit(True).alias(clash)))
    places = texts.select("row", F.posexplode("routes").alias("place", "route"))
    simple = names.select("route", "name")
    if shared.isEmpty():
        return join_hot(places, simple, ["route"], F.col("row"), "inner").select("row", "place", "name")
    # Two different blocks met in one route: those routes are resolved by a digest of the bytes, checked to be unique.
    doubled = names.join(shared, "route", "left_semi").groupBy("route", "check").count().where("count > 1")
    if not doubled.isEmpty():
        raise ValueError("two different blocks share a routing hash and a 512-bit digest")
    plain = places.join(shared, "route", "left_anti").join(simple, "route").select("row", "place", "name")
    again = docs.select("id", "text").mapInArrow(_block_places(size, hash_bits, "blocks"), "id long, digest string, n_bytes long, routes array<long>, blocks array<binary>")
    again = again.select("id", "digest", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("routes") - 1).alias("place"), "routes", F.transform("blocks", lambda b: F.sha2(b, 512)).alias("check"))).alias("b"))
    again = again.select("id", "digest", F.col("b.place").alias("place"), F.col("b.routes").alias("route"), F.col("b.check").alias("check")).join(shared, "route", "left_semi").distinct()
    hard = again.join(names, ["route", "check"]).join(texts.select("row", "id", "digest"), ["id", "digest"]).select("row", "place", "name")
    return plain.unionByName(hard)


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 63) -> DataFrame:
    """One row per input row: id, n_blocks, name (integer, unique within a block count), text_sha256."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = docs.mapInArrow(_block_places(block_bytes, hash_bits, "texts"), "id long, digest string, n_bytes long, routes array<long>")
    texts = materialize(texts.withColumn("row", F.monotonically_increasing_id()))
    level = _first_names(docs, texts, block_bytes, hash_bits)
    # Most texts are one block: the first name is theirs. Longer ones go through the pairing rounds.
    level = materialize(level.join(texts.select("row", F.size("routes").alias("n")), "row"))
    done = [level.where("n = 1").select("row", "n", "name")]
    longest = level.agg(F.max("n")).first()[0] or 0
    left, width = level.where("n > 1"), longest
    while width > 1:
        pairs = left.groupBy("row", "n", (F.col("place") / 2).cast("int").alias("place")).agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = materialize(pairs)
        names = materialize(pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id()))
        left = materialize(join_hot(pairs, names, ["a", "b"], F.col("row"), "inner").select("row", "n", "place", "name"))
        width = -(-width // 2)
        done.append(left.where(f"n > {1 << (len(done) - 1)} and n <= {1 << len(done)}").select("row", "n", "name"))
        left = left.where(f"n > {1 << (len(done) - 1)}")
    names = done[0]
    for part in done[1:]:
        names = names.unionByName(part)
    return names.join(texts.select("row", "id", "digest"), "row").select(F.col("id").alias(id_col), F.col("n").alias("n_blocks"), "name", F.col("digest").alias("text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 63) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256. Of equal texts the smallest id stays (of repeated rows with that id, all say kept)."""
    named = materialize(name_documents(docs, id_col, text_col, block_bytes, hash_bits))
    groups = named.groupBy("n_blocks", "name").agg(F.min(id_col).alias("least"), F.count("*").alias("rows")).where("rows > 1")
    out = join_hot(named, groups, ["n_blocks", "name"], F.struct(id_col, F.monotonically_increasing_id()))
    own = F.col("rows").isNull()  # a text without an equal
    out = out.select(id_col, F.when(own, F.col(id_col)).otherwise(F.col("least")).alias("keep_id"), F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
    return out.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests: list[str] = []
        for _, _, data, offsets in text_slices(batch.column(0)):
            data, offsets = normalised(data, offsets)
            raw, bounds = data.tobytes(), offsets.tolist()
            digests += [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])]
        yield pa.record_batch([*batch.columns[1:], pa.array(digests, pa.string())], [*batch.schema.names[1:], "_digest"])


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has no equal with a smaller id; all columns stay.

    Of repeated rows (same id, equal text) one stays. A row with a null id stays unless a row with an id has its text.
    Decisions are joined by id and text digest, so two texts under one id are decided apart.
    """
    small_batches(docs.sparkSession)
    plain = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows, own_id, text = docs.toDF(*plain.values()), plain[id_col], plain[text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _digest string"
    marked = rows.select(F.col(text).cast("string").alias("_text"), "*").mapInArrow(_with_digest, schema)
    stay = exact_groups(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text").where("kept")
    stay = materialize(stay.groupBy(F.col("id").alias("_id"), F.col("text_sha256").alias("_sha")).agg(F.count("*").alias("_rows")))
    on = lambda right: marked[own_id].eqNullSafe(right["_id"]) & (marked["_digest"] == right["_sha"])
    once = stay.where("_rows = 1")
    out = marked.join(once.hint("shuffle_hash"), on(once), "left_semi")
    more = stay.where("_rows > 1")
    if not more.isEmpty():
        out = out.unionByName(marked.join(more.hint("shuffle_hash"), on(more), "left_semi").dropDuplicates([own_id, "_digest"]))
    return out.select(*(F.col(k).alias(c) for c, k in plain.items()))
