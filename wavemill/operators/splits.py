"""Leak-free splits as tables. Shuffles are MD5 ranks, so members are the same in every run and engine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import draw, uniforms
from ..functions.ranking import dealt, part_of, ranked
from ..sources.tables import stored

#: Most rows of a counted table of edges that every task is given whole.
EDGES = 100_000
_END = float(1 << 32)  # above every draw


def _drawn(seed: Column | int, key: str) -> Column:
    return draw(seed if isinstance(seed, Column) else F.lit(seed), key)


def _shuffled(rows: DataFrame, key: str, seed: Column | int, by: list[str], total: int, name: str = "_r") -> DataFrame:
    """rows with their place, from 1, in the shuffled order of each ``by``."""
    return ranked(rows, by, _drawn(seed, key), [key], 0.0, _END, name, total)


def group_folds(groups: DataFrame, key: str, k: int, seed: Column | int = 0, by: list[str] | None = None) -> DataFrame:
    """Distinct groups dealt round robin to k folds in shuffled order, once per value of ``by``."""
    by = by or []
    rows = stored(groups.select(*by, key).distinct())
    return _folds(rows, key, k, seed, by, rows.count())


def _folds(rows: DataFrame, key: str, k: int, seed: Column | int, by: list[str], total: int) -> DataFrame:
    return _shuffled(rows, key, seed, by, total).withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def _first_share(rows: DataFrame, key: str, seed: Column | int, by: list[str], fraction: float, least: int) -> DataFrame:
    """Adds _taken: whether a row's place in the shuffled order is within max(least, round half even (fraction * n)) of its ``by``.

    Only the last row taken of each ``by`` is looked for. Counts of ranges tell the range that holds it, whose rows alone are
    put in order; the other rows are compared with it where they stand. rows are read three times.
    """
    of = [F.col(c).alias(f"_by_{k}") for k, c in enumerate(by)]
    on = F.lit(True)
    for k, c in enumerate(by):
        on &= F.col(c).eqNullSafe(F.col(f"_by_{k}"))
    place = F.struct(_drawn(seed, key).alias("value"), F.col(key).alias("key"))
    placed = rows.select(*by, place.alias("_place")).withColumn("_part", part_of(F.col("_place.value"), 0.0, _END))
    counts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_in"))
    within = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = counts.withColumn("_to", F.sum("_in").over(within)).withColumn("_n", F.sum("_in").over(W.partitionBy(*by)))
    last = F.least(F.col("_n"), F.greatest(F.lit(least), F.bround(F.col("_n") * F.lit(fraction)).cast("long")))
    nth = (last - (F.col("_to") - F.col("_in"))).alias("_nth")
    holding = _given(counts.select(*of, F.col("_part").alias("_held"), nth, "_in").where("_nth between 1 and _in").drop("_in"))
    near = placed.join(holding, on & (F.col("_part") == F.col("_held")))
    near = near.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy("_place"))).where("_rn = _nth")
    edges = _given(near.select(*of, F.col("_place").alias("_edge")))
    return rows.join(edges, on).withColumn("_taken", place <= F.col("_edge")).drop("_edge", *(f"_by_{k}" for k in range(len(by))))


def _given(edges: DataFrame) -> DataFrame:
    """One row per ``by``, counted, so that a short table meets the rows where they stand."""
    edges = stored(edges)
    return F.broadcast(edges) if edges.count() <= EDGES else edges


def group_holdout(groups: DataFrame, key: str, fraction: float, by: list[str], seed: Column | int = 1) -> DataFrame:
    """Per ``by``: max(1, round half even (fraction * n)) groups become val, the others fit."""
    return _held_out(stored(groups.select(*by, key).distinct()), key, fraction, by, seed)


def _held_out(rows: DataFrame, key: str, fraction: float, by: list[str], seed: Column | int) -> DataFrame:
    return _first_share(rows, key, seed, by, fraction, 1).withColumn("role", F.when(F.col("_taken"), "val").otherwise("fit")).drop("_taken")


def iter_splits(groups: DataFrame, key: str, seeds: int, k: int, fraction: float) -> DataFrame:
    """(seed, fold, key, role): test groups of each fold, the rest divided into val and fit."""
    keys = stored(groups.select(key).distinct())
    seeded = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    own = stored(_folds(seeded, key, k, F.col("seed"), ["seed"], keys.count() * seeds).withColumnRenamed("fold", "own"))
    rows = own.select("seed", key, "own", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    rest = _held_out(rows.where("own <> fold").drop("own"), key, fraction, ["seed", "fold"], F.concat_ws("-", "seed", "fold"))
    return rows.where("own = fold").select("seed", "fold", key, F.lit("test").alias("role")).unionByName(rest)


def strat_group_folds(groups: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """Class 1 first, then class 0, one running counter over both, dealt to k folds."""
    rows = stored(groups.groupBy(key).agg(F.max(label).alias(label)))
    # the counter goes on after class 1: only its size is needed, no single ordered partition
    ones = rows.agg(F.count_if(F.col(label) == 1).alias("_ones"))
    return _shuffled(rows, key, seed, [label], rows.count()).join(F.broadcast(ones)).withColumn("fold", ((F.col("_r") - 1 + F.when(F.col(label) == 1, 0).otherwise(F.col("_ones"))) % k).cast("int")).drop("_r", "_ones")


def strat_group_holdout(groups: DataFrame, key: str, label: str, fraction: float, seed: int = 0) -> DataFrame:
    """At least one group of each class becomes val."""
    return group_holdout(groups.groupBy(key).agg(F.max(label).alias(label)), key, fraction, [label], seed)


def strat_window_folds(windows: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """The leaky comparison: single windows dealt to folds within each class."""
    rows = stored(windows.select(key, label))
    return _shuffled(rows, key, seed, [label], rows.count()).withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


#: Ranges of the draws of repeated folds, as a power of two.
RANGE_BITS = 10


def repeated_folds(rows: DataFrame, key: str, strata: str, most: int, k: int, repeats: int, seed: str = "folds") -> DataFrame:
    """rows with ``parts``: for each number of the array ``strata`` the folds of all repeats, one signed byte each.

    In every repeat the rows of a stratum are drawn anew and cut, in the order of their draws, into k folds whose sizes differ
    by at most one. Only the last row of each fold is looked for: counts of ranges tell the ranges that hold them, whose rows
    alone are moved and put in order. All other rows get their folds where they stand, so what is moved does not grow with
    repeats times rows. rows are read three times; key is a whole number, the strata's numbers are below ``most``, all arrays
    are of one length, and a null in them gets -1.
    """
    spark, shift = rows.sparkSession, 32 - RANGE_BITS

    def tries(keys: pa.Array, numbers: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, (rows x strata x repeats) cells, negative without a stratum, and draws."""
        of = numbers.flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(len(keys), -1).astype(np.int64)
        drawn = uniforms([str(name) for name in keys.to_pylist()], 0, of.shape[1] * repeats, seed)
        cells = np.where(of < 0, -repeats, of * repeats)[:, :, None] + np.arange(repeats)
        return keys.to_numpy(zero_copy_only=False), cells, drawn.reshape(cells.shape).astype(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(most * repeats << RANGE_BITS, np.int64)
        for batch in batches:
            if len(batch):
                _, cells, drawn = tries(*batch.columns)
                known = cells >= 0
                counts += np.bincount((cells[known] << RANGE_BITS) + (drawn[known] >> shift), minlength=len(counts))
        found = counts.reshape(most * repeats, -1)
        some = np.flatnonzero(found.any(1))
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(found[some].tolist(), pa.list_(pa.int64()))], ["cell", "counts"])

    few = rows.select(key, strata)
    per = few.mapInArrow(counted, "cell int, counts array<bigint>").select("cell", F.posexplode("counts").alias("range", "n"))
    per = per.where("n > 0").groupBy("cell", "range").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("cell").orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow))
    per = per.withColumn("before", upto - F.col("n")).withColumn("all", F.sum("n").over(W.partitionBy("cell")))
    last = F.array(*(F.expr(f"({fold} * all + {k - 1}) div {k} - before") for fold in range(1, k)))  # fold times all / k, rounded up
    held = per.select("cell", F.col("range").cast("long").alias("range"), "n", F.posexplode(last).alias("fold", "nth")).where("nth between 1 and n")
    held = held.select((F.shiftleft(F.col("cell").cast("long"), RANGE_BITS) + F.col("range")).alias("slot"), "fold", "nth")
    told = held.collect()  # a row per stratum, repeat and fold
    holding = np.zeros(most * repeats << RANGE_BITS, bool)
    holding[[r.slot for r in told]] = True

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys, cells, drawn = tries(*batch.columns)
                slots = np.where(cells >= 0, (cells << RANGE_BITS) + (drawn >> shift), 0)
                at = np.nonzero((cells >= 0) & holding[slots])
                yield pa.record_batch([pa.array(slots[at]), pa.array(drawn[at]), pa.array(keys[at[0]].astype(np.int64))], ["slot", "draw", "key"])

    told = spark.createDataFrame(told, held.schema)
    place = F.row_number().over(W.partitionBy("slot").orderBy("draw", "key")).alias("nth")
    edges = few.mapInArrow(near, "slot bigint, draw bigint, key bigint").select("slot", "draw", "key", place).join(F.broadcast(told), ["slot", "nth"])
    draws, keys_ = np.full((most * repeats, k - 1), 1 << 32), np.zeros((most * repeats, k - 1), np.int64)
    for r in edges.collect():  # as many
        draws[r.slot >> RANGE_BITS, r.fold], keys_[r.slot >> RANGE_BITS, r.fold] = r.draw, r.key
    at_key, at_strata = rows.columns.index(key), rows.columns.index(strata)

    def dealt_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys, cells, drawn = tries(batch.column(at_key), batch.column(at_strata))
                parts = np.zeros(cells.shape, np.int8)
                for fold in range(k - 1):
                    edge = draws[cells, fold]
                    parts += (drawn > edge) | ((drawn == edge) & (keys[:, None, None] > keys_[cells, fold]))
                parts[cells < 0] = -1
                ends = np.arange(len(batch) + 1, dtype=np.int32) * (parts.size // len(batch))
                told = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(parts.tobytes())])
                yield pa.record_batch([*batch.columns, told], [*batch.schema.names, "parts"])

    return rows.mapInArrow(dealt_out, T.StructType([*rows.schema.fields, T.StructField("parts", T.BinaryType())]))


def label_budget(windows: DataFrame, key: str, label: str, fraction: float, seed: int = 0) -> DataFrame:
    """Windows of a fraction of the records per class, at least two records of each."""
    records = stored(windows.groupBy(key).agg(F.max(label).alias("_c")))
    kept = _first_share(records, key, seed, ["_c"], fraction, 2).where("_taken")
    return windows.join(kept.select(key), key, "left_semi")


def soft_labels(windows: DataFrame, votes: DataFrame, key: str, label: str) -> DataFrame:
    """Vote shares in place of labels where there are votes."""
    return windows.join(votes, key, "left").withColumn("target", F.coalesce("frac_true", F.col(label).cast("double")))


def leak_check(splits: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """Violations: groups with two roles in a fold, or not tested exactly once per seed. Empty when the split is sound.

    All rows of a group and seed are in one task, so the split is made and moved once; total: about how many rows it has.
    """
    rows = dealt(splits.select("seed", "fold", key, "role"), ["seed", key], total)
    roles = rows.groupBy("seed", key, "fold", "role").agg(F.count("*").alias("n"))
    folds = roles.groupBy("seed", key, "fold").agg(F.count("role").alias("roles"), F.sum(F.when(F.col("role") == "test", F.col("n")).otherwise(0)).alias("tested"))
    groups = folds.groupBy("seed", key).agg(F.count_if(F.col("roles") > 1).cast("int").alias("twice"), F.sum("tested").alias("tested"))
    found = F.concat(F.array_repeat(F.lit("two roles"), F.col("twice")), F.array_repeat(F.lit("tested not once"), (F.col("tested") != 1).cast("int")))
    return groups.where("twice > 0 or tested <> 1").select("seed", key, F.explode(found).alias("problem"))
