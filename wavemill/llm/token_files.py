"""Token-id output as ORC: integer run-length stripes, row indexes and Bloom filters on the document id.

Texts are encoded by a distinct-chunk table (see ``pieces`` for where tokens never cross), an end id is appended,
and rows are written in ascending document order by a range partitioning: one file per range, so stripes are read in
parallel and a lookup by id is pruned by stripe statistics, row indexes and Bloom filters. The cumulative start of
each document comes from per-file counts, not from one ordered task.

Null text counts as empty (only the end id). Very long texts are a slice of their own and one row. Rows without an id sort first. Rows of one id are in the order of their
texts; each stored row has its number in the file, which is what starts follow. Empty input gives empty files. Extra
columns are not written, so their names cannot clash.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunk_table import ChunkTable
from .common import lower_ascii, scratch_dir, small_batches, text_slices, word_bounds

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: ORC settings: stripes that one task reads, an index entry each 10,000 rows, Bloom filters for id lookups.
ORC_OPTIONS = {"orc.stripe.size": str(32 << 20), "orc.row.index.stride": "10000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
#: Distinct pieces that one Python worker keeps.
TABLE_PIECES = 600_000
_TABLES: dict[str, ChunkTable] = {}
_LETTER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(3))
_LETTER[97:123] = True
_DIGIT[48:58] = True
_MARK[33:127] = ~(_LETTER | _DIGIT)[33:127]
_MARK[65:91] = False


def _table(path: str) -> ChunkTable:
    """The worker's table for a tokenizer, kept between tasks."""
    if path not in _TABLES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _check(tokenizer)
        _TABLES[path] = ChunkTable(lambda chunks: [e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)], limit=TABLE_PIECES)
    return _TABLES[path]


# Texts whose tokens show whether a tokenizer keeps to the cuts of ``pieces``.
_PROBES = ("It's 12a3 (x,y)=z, don't; O'Neil", " a  b\tc\n d ", "é,É. 漢字 a漢1 '' 's x'y'z", "<|endoftext|>a <|b|> <|", "A.B.C. 1,000.50 #tag @me a_b-c")


def _check(tokenizer) -> None:
    """Encoding whole texts must equal encoding their pieces."""
    for text in _PROBES:
        column = pa.array([text], pa.string())
        for _, _, data, offsets in text_slices(column):
            data, starts, ends, _ = pieces(data, offsets)
            parts = [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist())]
            if [i for p in parts for i in tokenizer.encode(p, add_special_tokens=False).ids] != tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError("tokens of this tokenizer cross the places where texts are cut")


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes to encode, starts and ends of the pieces, and each text's first piece.

    Tokens of this tokenizer (lower-casing; runs of letters, single digits, runs of marks, contractions) cross neither
    white space nor the places cut here: before an ASCII mark that follows an ASCII letter or digit, before an ASCII
    letter or digit that follows a mark other than the apostrophe, and around ASCII digits. Words with "<|" may spell a
    special token and are encoded as they stand.
    """
    starts, ends, first = word_bounds(data, offsets)
    if not len(starts):
        return data, starts, ends, first
    low = lower_ascii(data)
    left, right = low[:-1], low[1:]
    plain = _LETTER | _DIGIT
    cut = (plain[left] & _MARK[right]) | (_MARK[left] & (left != 39) & plain[right]) | (_DIGIT[left] & plain[right]) | (plain[left] & _DIGIT[right])
    for k in np.unique(np.searchsorted(starts, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right") - 1).tolist():
        low[starts[k] : ends[k]] = data[starts[k] : ends[k]]
        cut[starts[k] : ends[k] - 1] = False
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    cut[edges - 1] = False
    # pieces start where a word starts or is cut, and end where a word ends or is cut: both in order
    begin, end = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    begin[starts], end[ends] = True, True
    inner = np.flatnonzero(cut) + 1
    begin[inner], end[inner] = True, True
    both = np.flatnonzero(begin)
    until = np.flatnonzero(end)
    return low, both, until, np.searchsorted(both, offsets)


def _encoder(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, row = _table(path), 0
        for batch in batches:
            lists = []
            for i, j, data, offsets in text_slices(batch.column(1)):
                data, starts, ends, first = pieces(data, offsets)
                flat, per_piece = table.gather(table.look_up(data, starts, ends))
                counts = np.concatenate(([0], np.cumsum(per_piece)))[first]
                flat = np.insert(flat, counts[1:], end_id)
                lists.append(pa.ListArray.from_arrays(pa.array((counts + np.arange(j - i + 1)).astype(np.int32)), pa.array(flat, pa.int32())))
            ids = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))
            numbers = pa.array(np.arange(row, row + len(batch)))
            row += len(batch)
            yield pa.record_batch([batch.column(0), pc.cast(pc.list_value_length(ids), pa.int64()), ids, numbers], ["doc_id", "n_tokens", "ids", "row"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id, n_tokens, ids (the tokenizer's ids without its special ones, then end_id), row (place within its partition)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoder(tokenizer_path or public_tokenizers.path(DEFAULT_TOKENIZER), end_id), "doc_id long, n_tokens long, ids array<int>, row long")


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 1) -> None:
    """Range-partitioned, id-ordered ORC files.

    Texts are dealt and sorted before they are encoded, so the sampling of ranges never runs the tokenizer and each
    token list is made once, in the task that writes it.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encode(rows, "doc_id", "text", tokenizer_path, end_id).write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, row (place in its file) of all files; filters on doc_id are pushed to stripes and Bloom filters."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>, row long").orc(path)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(2)
        flat, bounds = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy().tolist()  # offsets count from the start of values
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
        yield pa.record_batch([batch.column(0), pc.list_value_length(ids).cast(pa.int64()), pa.array(crc, pa.int64()), *batch.columns[3:]], ["doc_id", "n_tokens", "ids_crc32", "row", "file"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files alone.

    start needs an order over everything: files cover id ranges in turn, so a running sum over one row per file gives
    each file's first position and a running sum inside each file the rest.
    """
    small_batches(spark)
    stored, file = read_token_files(spark, path), F.col("_metadata.file_name").alias("file")
    # the sums read two narrow columns only; ids are read once, for their digests
    files = stored.select("doc_id", "n_tokens", file).groupBy("file").agg(F.sum("n_tokens").alias("in_file"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    before = W.orderBy(F.col("low").asc_nulls_first(), F.col("high").asc_nulls_first(), "file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("before"))
    rows = stored.select("doc_id", "n_tokens", "ids", "row", file).mapInArrow(_crc, "doc_id long, n_tokens long, ids_crc32 long, row long, file string")
    inside = W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(files, "file")
    return rows.select("doc_id", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def write_and_index(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Encode, write and read back: the index over the written files."""
    spark = docs.sparkSession
    path = path or scratch_dir(spark)
    write_token_files(docs, path, **how)
    return token_index(spark, path)
