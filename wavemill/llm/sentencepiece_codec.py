"""SentencePiece encoding and decoding by a distinct-chunk table.

Pieces of the model never run from a character into a following white space mark, so a text may be cut before every
run of marks. The distinct marked words of the whole corpus are counted, each one that comes often enough is segmented
once (``chunk_table.corpus_table``, a bounded table that is sent to the tasks), and ids are joined back by position.
Rarer words are segmented where they stand. The result is what the library gives for the whole text, the end id
appended, and its decode() of those ids.

Null text counts as empty: only the end id, decoded to "". Very long texts form a slice of their own. The mark itself
(U+2581) in a text is handled as the library does: it decodes to a space. An empty table gives an empty result. Repeated rows give repeated results; extra
columns of the input are kept unless named like an output column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_table import CORPUS_CHUNKS, ChunkTable, corpus_table
from .common import discard, small_batches, text_slices

DEFAULT_MODEL = "piece_bpe_32k.model"
_LOADED: dict[str, tuple] = {}
_TABLES: dict[tuple, ChunkTable] = {}


def _model(path: str):
    import sentencepiece

    if path not in _LOADED:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.vocab_size())):
            raise ValueError("a piece of this model runs across a white space mark: its texts cannot be cut into chunks")
        # No normalisation, a mark before the text, and runs of spaces kept: what cutting relies on.
        if sp.encode("½  a ", out_type=str)[0][0] != "▁" or sp.decode(sp.encode("½  a ")) != "½  a ":
            raise ValueError("this model normalises its input: its texts cannot be cut into chunks")
        _LOADED[path] = sp, sp.piece_to_id("▁")
    return _LOADED[path]


def _segmenter(path: str):
    sp, lone = _model(path)
    return sp, lambda chunks: [ids if c else [lone] for c, ids in zip(chunks, sp.encode(chunks, num_threads=1))]


def _table(path: str, given) -> ChunkTable:
    """The worker's table for a model and a corpus table (a broadcast of its rows, or None), kept between tasks."""
    key = path, given and given.value[0]
    if key not in _TABLES:
        _TABLES.clear()
        sp, encode = _segmenter(path)
        _TABLES[key] = ChunkTable(encode, lambda chunk, ids: sp.decode(ids), given=given and given.value[1:])
    return _TABLES[key]


def _encode_pairs(path: str):
    def run(chunks: list[str]) -> list[tuple[list[int], str]]:
        sp, encode = _segmenter(path)
        return [(ids, sp.decode(ids)) for ids in encode(chunks)]

    return run


def _cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunk keys of a slice and the first chunk of each text.

    A key is the chunk without its leading space: the library puts a mark before what it encodes. Only a text's own
    first chunk keeps a leading space.
    """
    inside = np.zeros(len(data), bool)
    if len(data):
        space = data == 32
        inside[1:] = space[1:] & ~space[:-1]
        mark = np.flatnonzero((data[:-3] == 0xE2) & (data[1:-2] == 0x96) & (data[2:-1] == 0x81)) + 3
        inside[mark] = False  # never between two marks
        inside[offsets[:-1][offsets[:-1] < len(data)]] = False
    cut = np.flatnonzero(inside)
    firsts = offsets[:-1][np.diff(offsets) > 0]
    starts = np.sort(np.concatenate((cut, firsts)))
    ends = np.append(starts[1:], len(data))
    led = inside[starts] if len(starts) else np.zeros(0, bool)
    return starts + led, ends, np.searchsorted(starts, offsets)


def _coder(model_path: str, outputs: tuple[str, ...], given=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = _model(model_path)
        end, table = sp.eos_id(), _table(model_path, given)
        for batch in batches:
            made: dict[str, list] = {name: [] for name in outputs}
            for i, j, data, offsets in text_slices(batch.column(0)):
                starts, ends, first = _cuts(data, offsets)
                rows = table.look_up(data, starts, ends)
                per_text = first.tolist()
                counts = np.concatenate(([0], np.cumsum(table.count[rows])))[first]
                if "n_tokens" in made:
                    made["n_tokens"].append(np.diff(counts) + 1)
                if "ids" in made:
                    flat, _ = table.gather(rows)
                    flat = np.insert(flat, counts[1:], end)
                    made["ids"].append(pa.ListArray.from_arrays(pa.array((counts + np.arange(j - i + 1)).astype(np.int32)), pa.array(flat, pa.int32())))
                if "text" in made or "decoded_sha256" in made:
                    plain = [table.extras[r] for r in rows.tolist()]
                    texts = [" ".join(plain[a:b]) for a, b in zip(per_text, per_text[1:])]
                    if "text" in made:
                        made["text"] += texts
                    if "decoded_sha256" in made:
                        made["decoded_sha256"] += [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                if "ids_sha256" in made:
                    plain = [table.decimals[r] for r in rows.tolist()]
                    tail = str(end)
                    made["ids_sha256"] += [hashlib.sha256(" ".join((*plain[a:b], tail)).encode()).hexdigest() for a, b in zip(per_text, per_text[1:])]
            columns = list(batch.columns[1:])
            for name in outputs:
                x = made[name]
                if name == "n_tokens":
                    columns.append(pa.array(np.concatenate(x) if x else [], pa.int64()))
                elif name == "ids":
                    columns.append(pa.concat_arrays(x) if x else pa.array([], pa.list_(pa.int32())))
                else:
                    columns.append(pa.array(x, pa.string()))
            yield pa.record_batch(columns, [*batch.schema.names[1:], *outputs])

    return run


_TYPES = {"n_tokens": "long", "ids": "array<int>", "text": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, text_col: str = "text", model_path: str | None = None, outputs: tuple[str, ...] = ("ids", "n_tokens"), table_chunks: int = CORPUS_CHUNKS) -> DataFrame:
    """The columns of docs (but the text) plus the wanted of ids, n_tokens, text (decoded), ids_sha256, decoded_sha256.

    table_chunks bounds the corpus table; with 0 every task segments for itself and the texts are read once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = model_path or public_tokenizers.path(DEFAULT_MODEL)
    kept = [c for c in docs.columns if c != text_col and c not in outputs]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{name} {_TYPES[name]}" for name in outputs])
    text, given = F.col(f"`{text_col}`").cast("string").alias("_text"), None
    if table_chunks:
        made = corpus_table(docs.select(text), _cuts, _encode_pairs(path), table_chunks)
        rows = made.toArrow()  # table_chunks rows at most
        chunks, ids, extras = (rows.column(k).to_pylist() for k in range(3))
        given = spark.sparkContext.broadcast((made._scratch, chunks, ids, extras))
        discard(made)
    return docs.select(text, *(F.col(f"`{c}`") for c in kept)).mapInArrow(_coder(path, outputs, given), schema)


def decode(encoded: DataFrame, ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """Replaces the id lists by the library's decode() of them in column text; null ids give null."""
    path = model_path or public_tokenizers.path(DEFAULT_MODEL)
    kept = [c for c in encoded.columns if c not in (ids_col, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = _model(path)
        for batch in batches:
            texts = [None if ids is None else sp.decode(ids) for ids in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])

    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept), "text string"])
    return encoded.select(F.col(ids_col).alias("_ids"), *(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)
