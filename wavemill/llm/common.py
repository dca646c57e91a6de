"""Shared pieces: scratch tables in the cluster's shared folder, byte-level word splitting on Arrow buffers."""

from __future__ import annotations

import atexit
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass holds at a time; a longer single text forms a pass of its own.
SLICE_BYTES = 2 << 20
#: Rows of one Arrow batch; keeps a batch of long texts within a Python worker's memory.
BATCH_ROWS = 1024


_ROOTS: dict[str, str] = {}  # application id -> its folder


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors share.

    Where the setting is missing, a local master gets a temporary folder of its machine; on a cluster that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="wavemill-scratch-")
        if not _ROOTS:
            atexit.register(_clear_all)
        _ROOTS[app] = f"{base.rstrip('/')}/wavemill-{uuid.uuid4().hex}"
    return _ROOTS[app]


_STAGE: list[str] | None = None  # names given while a stage runs
_LEFT: list[str] = []  # what the stage before has left


def scratch_dir(spark: SparkSession) -> str:
    """A new name below the application's folder."""
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    if _STAGE is not None:
        _STAGE.append(path)
    return path


def frees_scratch(stage):
    """For stages whose results are written before the next one begins: the scratch tables of one stage go when the next begins."""

    @functools.wraps(stage)
    def run(spark: SparkSession, *args):
        global _STAGE
        while _LEFT:
            _delete(spark, _LEFT.pop())
        _STAGE = []
        try:
            return stage(spark, *args)
        finally:
            _LEFT.extend(_STAGE)
            _STAGE = None

    return run


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application. Results not yet written are lost with them."""
    root = _ROOTS.pop(spark.sparkContext.applicationId, None)
    if root:
        _delete(spark, root)


def _clear_all() -> None:
    """At the end of the driver's Python: what its running session still holds goes."""
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        clear_scratch(SparkSession(context))


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, fixes row ids."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables made by ``materialize`` that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df._scratch)


#: Rows of one key that a join leaves in one task, and how many keys are looked at as larger ones.
KEY_ROWS, HOT_KEYS = 1000, 4096


def join_hot(rows: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left") -> DataFrame:
    """rows joined with right, which has one row per key; a key of very many rows is dealt to many tasks by ``spread``.

    The HOT_KEYS most frequent keys (a bounded table, hence broadcast) get a salt per KEY_ROWS rows, at most HOT_KEYS salts;
    right's row of such a key is repeated once per salt.
    """
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > KEY_ROWS).orderBy(F.desc("_n"), *keys).limit(HOT_KEYS)
    hot = materialize(hot.select(*keys, F.least(F.ceil(F.col("_n") / F.lit(KEY_ROWS)), F.lit(HOT_KEYS)).cast("int").alias("_salts")))
    if hot.isEmpty():
        return rows.join(right, keys, how)
    hot = F.broadcast(hot)
    rows = rows.join(hot, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), "_salts"), F.lit(0)).cast("int")).drop("_salts")
    right = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return rows.join(right, [*keys, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for text columns; a smaller setting of the user's is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


# ---------------------------------------------------------------- bytes


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) runs of a string column of at most ``limit`` bytes, null as empty."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("", column.type))
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data - np.uint8(9)) <= np.uint8(4))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, for each text, its first word's index (length n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~is_space(data)
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = word
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a word never runs from one text into the next
    starts = np.flatnonzero(word & (~before[:-1] | first[:-1]))
    ends = np.flatnonzero(word & ~(np.append(word[1:], False) & ~first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), on unsigned integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Longest span that is hashed by 8-byte words; longer ones get a cryptographic digest.
WORD_SPAN = 64
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span.

    Spans of at most WORD_SPAN bytes are folded 8 bytes at a time, all spans at once, each step a bijection of the state;
    of longer ones BLAKE2b is taken. No sum or product over positions is involved, so no pair of spans collides by its form.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ascontiguousarray(np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,)))  # the 8 bytes from each position
    h = mix((words[starts] & _KEEP[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    left = np.flatnonzero((size > 8) & (size <= WORD_SPAN))
    at = 8
    while len(left):
        h[left] = mix((h[left] * np.uint64(0x9FB21C651E98DF25)) ^ (words[starts[left] + at] & _KEEP[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    far = np.flatnonzero(size > WORD_SPAN)
    if len(far):
        raw = memoryview(np.ascontiguousarray(data))
        made = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[far].tolist(), ends[far].tolist()))
        h[far] = np.frombuffer(made, "<u8")
    return h


def flat_gather(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indexes of consecutive runs: run k covers first[k] .. first[k] + count[k] - 1."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total, dtype=np.int64) + np.repeat(first - (ends - count), count)
