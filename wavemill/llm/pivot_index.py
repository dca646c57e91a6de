"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots) in order. Each pivot has an inverted list of the
vectors that name it; two vectors of one label are candidates when they share at least ``min_shared`` pivots, and a
candidate is verified by its cosine in double precision. The pivots are a bounded sample of the vectors; every vector
is indexed. Recall against brute force is measured in the tests (and stated in the README); nothing below the
threshold is ever linked.

Equal vectors of a label are one class with a count, so thousands of copies cost one entry. A long list is cut into
blocks; block pairs are compared by matrix products and return link counts per vector and links to local roots,
never all pairs. A pair is judged only in the list of its smallest shared pivot, so counts are exact.

A vector that is null, empty, zero, or holds a null or a non-finite component links with nothing, nor does one without
a label, and vectors of different lengths never meet. Rows without an id keep their own component (null). An empty table
gives an empty result. Only the id, label and vector columns are used, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize
from .graph import components

#: Vectors of a block of an inverted list.
BLOCK = 512
#: Bounds of the number of pivots; in between it grows with the square root of the vectors.
PIVOTS = (64, 2048)
#: No two pivots have a larger cosine.
APART = 0.6


def choose_pivots(classes: DataFrame, n_pivots: int | None = None) -> np.ndarray:
    """Unit pivots from a bounded sample: of the 4 * n_pivots vectors with the smallest hashes, those apart from the ones before.

    Pivots close together would order a dense group by chance, so a candidate within cosine ``APART`` of a chosen one
    is passed over, and fixed random directions fill up to a quarter of n_pivots. At most 4 * PIVOTS[1] rows come to
    the driver.
    """
    if n_pivots is None:
        n = classes.count()
        n_pivots = int(min(PIVOTS[1], max(PIVOTS[0], 2 ** np.ceil(np.log2(max(n, 1) ** 0.5)))))
    rows = [r.vector for r in classes.orderBy(F.xxhash64("vector"), "cls").limit(4 * n_pivots).select("vector").collect()]
    width = max(map(len, rows), default=1)
    chosen = np.zeros((n_pivots, width))
    n = 0
    filling = np.random.default_rng(0).normal(size=(n_pivots // 4, width))
    for k, v in enumerate([*rows, *filling]):
        if n == n_pivots or (k >= len(rows) and n >= n_pivots // 4):
            break
        unit = np.zeros(width)
        unit[: len(v)] = v
        unit /= np.linalg.norm(unit)
        if not n or (chosen[:n] @ unit).max() < APART:
            chosen[n] = unit
            n += 1
    return chosen[:n]


def _describe(pivots, named: int):
    """(cls, copies, label, vector) -> (cls, copies, space, vector bytes, pivots named, nearest first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = pivots.value
        for batch in batches:
            lists = batch.column(3)
            widths = pc.list_value_length(lists).to_numpy()
            for width in np.unique(widths).tolist():
                at = pa.array(np.flatnonzero(widths == width))
                part = batch.take(at)
                x = part.column(3).flatten().to_numpy().reshape(-1, width)
                unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
                common = min(width, points.shape[1])
                near = np.argsort(-(unit[:, :common] @ points[:, :common].T), axis=1, kind="stable")[:, :named].astype(np.int32)
                cuts = np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]
                names = pa.ListArray.from_arrays(pa.array(cuts), pa.array(near.ravel()))
                space = pc.binary_join_element_wise(part.column(2).cast(pa.string()), str(width), "|")
                yield pa.record_batch([part.column(0), part.column(1), space, pa.array([v.tobytes() for v in x.astype(np.float64)], pa.binary()), names], ["cls", "copies", "space", "vector", "named"])

    return run


def compare(pivot: int, cls: np.ndarray, copies: np.ndarray, side: np.ndarray, vectors: np.ndarray, named: np.ndarray, n_pivots: int, threshold: float, min_shared: int):
    """Links of one block pair in the list of ``pivot``: (linked copies of each row, local roots)."""
    rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = not len(columns)
    columns = rows if same else columns
    flags = np.zeros((len(cls), n_pivots), np.float32)
    flags[np.arange(len(cls))[:, None], named] = 1
    shared = flags[rows] @ flags[columns].T  # shared-pivot counts
    earlier = flags[rows][:, :pivot] @ flags[columns][:, :pivot].T  # judged in another list
    i, j = np.nonzero((shared >= min_shared) & (earlier == 0))
    if same:
        i, j = i[i < j], j[i < j]
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    linked = np.zeros(len(cls), np.int64)
    root = np.arange(len(cls))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for first in range(0, len(i), 50_000):
        a, b = rows[i[first : first + 50_000]], columns[j[first : first + 50_000]]
        cosine = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norms[a] * norms[b])
        a, b = a[cosine >= threshold], b[cosine >= threshold]
        np.add.at(linked, a, copies[b])
        np.add.at(linked, b, copies[a])
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = top(x), top(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    return linked, np.array([top(k) for k in range(len(cls))])


def _judge(n_pivots: int, threshold: float, min_shared: int):
    """Rows sorted by block pair -> (cls, links, root): link counts and one link to a local root where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]

        def close(key: tuple, rows: list[tuple]) -> None:
            if len(rows) < 2:
                return
            cls, copies, side = (np.array([r[k] for r in rows]) for k in range(3))
            vectors = np.stack([np.frombuffer(r[3], np.float64) for r in rows])
            linked, root = compare(key[1], cls, copies, side, vectors, np.array([r[4] for r in rows]), n_pivots, threshold, min_shared)
            for k in np.flatnonzero(linked).tolist():
                for column, value in zip(out, (cls[k], linked[k], cls[root[k]])):
                    column.append(int(value))

        def flush() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(x, pa.int64()) for x in out], ["cls", "links", "root"])
            for x in out:
                x.clear()
            return made

        key, rows = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(9)]
            for row in zip(zip(*columns[:4]), *columns[4:]):
                if row[0] != key:
                    close(key, rows)
                    key, rows = row[0], []
                rows.append(row[1:])
            yield flush()
        close(key, rows)
        yield flush()

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, named: int = 10, min_shared: int = 2, n_pivots: int | None = None
) -> DataFrame:
    """One row per input row: id, n_links (other vectors linked directly), component_id, kept."""
    spark = vectors.sparkSession
    usable = F.col("vector").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
    usable &= F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = rows.where("usable").groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()))
    points = choose_pivots(classes, n_pivots)
    pivots = spark.sparkContext.broadcast(points)
    described = classes.select("cls", "copies", "label", "vector").mapInArrow(_describe(pivots, named), "cls long, copies long, space string, vector binary, named array<int>")
    described = materialize(described)

    entries = described.select("space", F.explode("named").alias("pivot"), "cls")
    sizes = entries.groupBy("space", "pivot").agg(F.count("*").alias("n")).where("n > 1")
    lists = sizes.select("space", "pivot", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    lists = materialize(lists)
    calls = lists.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)))
    sides = calls.select("space", "pivot", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).union(calls.where("i <> j").select("space", "pivot", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    placed = described.select("space", F.explode("named").alias("pivot"), "cls", "copies", "vector", "named").join(lists, ["space", "pivot"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int")).drop("blocks")
    called = placed.join(sides, ["space", "pivot", "block"]).select("space", "pivot", "i", "j", "cls", "copies", "side", "vector", "named")
    key = ["space", "pivot", "i", "j"]
    found = called.repartition(*key).sortWithinPartitions(*key).mapInArrow(_judge(len(points), threshold, min_shared), "cls long, links long, root long")
    found = materialize(found)

    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    smallest = classes.join(reached, "cls").groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = join_hot(classes.join(links, "cls", "left").join(reached, "cls", "left"), smallest, ["component"], F.col("cls"))
    known = known.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    out = join_hot(rows.where("usable"), known, ["label", "vector"], F.col("id"), "inner").select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
