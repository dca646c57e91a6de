"""Distinct-chunk tables: a text is cut where tokens cannot cross, each distinct chunk is encoded once, ids are joined back by position.

The cut makes encoding a text equal to encoding its chunks one by one. ``corpus_table`` counts the chunks of the whole
corpus, encodes each distinct one that comes often enough once, in one Spark job, and sends that table to the tasks: at
most ``limit`` chunks can occur a ``limit``-th of all times or more, so the table is bounded at any corpus size. Rarer
chunks are encoded where they stand, once per slice or while the task's own part of the table holds them: sending each of
their positions through a join would move the corpus, not its vocabulary.

The table is keyed by a chunk's bytes. A 64-bit hash only finds the distinct chunks of a slice, and every chunk is then held
against the bytes that stand for its hash, so chunks whose hashes meet get their own ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_gather, materialize, span_hashes, text_slices

#: Distinct chunks that one Python worker keeps of its own, about 200 bytes each, and chunks encoded in one call.
TABLE_CHUNKS, CALL_CHUNKS = 400_000, 4096
#: Most chunks of a corpus table.
CORPUS_CHUNKS = 1 << 18


class ChunkTable:
    """encode: list of chunk strings -> list of id lists. extra: (chunk string, ids) -> a string kept beside them."""

    def __init__(
        self, encode: Callable[[list[str]], list[list[int]]], extra: Callable[[str, list[int]], str] | None = None, limit: int = TABLE_CHUNKS, hashes: Callable = span_hashes,
        given: tuple[list[bytes], list[list[int]], list[str]] | None = None,
    ):
        self.encode, self.extra, self.limit, self.hashes = encode, extra, limit, hashes
        self.place: dict[bytes, int] = {}  # row of each chunk
        self.ids = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.met = np.zeros(1 << 14, np.int32)  # slices that a row was met in
        self.used = self.size = 0
        self.raw: list[bytes] = []
        self.extras: list[str] = []
        self.decimals: list[str] = []
        if given and given[0]:
            self._append(*map(list, given))
        self.fixed = self.size, self.used

    def _shrink(self) -> None:
        """Keep the given chunks and those that came in more than one slice, unless these are most of the table."""
        size, used = self.fixed
        stay = np.flatnonzero(self.met[size : self.size] > 1) + size
        if len(stay) > self.limit // 2:
            stay = stay[:0]
        flat, counts = self.gather(stay)
        kept = [[column[k] for k in stay.tolist()] for column in (self.raw, self.extras, self.decimals) if column]
        for chunk in self.raw[size:]:
            del self.place[chunk]
        for column, values in zip([c for c in (self.raw, self.extras, self.decimals) if c], kept):
            column[size:] = values
        n = size + len(stay)
        self.ids[used : used + len(flat)] = flat
        self.first[size:n], self.count[size:n], self.met[size:] = used + np.cumsum(counts) - counts, counts, 0
        self.size, self.used = n, used + len(flat)
        self.place.update(zip(self.raw[size:], range(size, n)))

    def _append(self, raw: list[bytes], encoded: list[list[int]], extras: list[str] | None) -> None:
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter(chain.from_iterable(encoded), np.int32, int(counts.sum()))
        n, more = self.size, len(raw)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n + more > len(self.first):
            self.first, self.count, self.met = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.count, self.met))
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[n : n + more] = self.used + np.cumsum(counts) - counts
        self.count[n : n + more] = counts
        self.used += len(flat)
        self.size += more
        self.raw += raw
        self.place.update(zip(raw, range(n, n + more)))
        if self.extra:
            self.extras += extras
            self.decimals += [" ".join(map(str, ids)) for ids in encoded]

    def _add(self, raw: list[bytes]) -> None:
        for i in range(0, len(raw), CALL_CHUNKS):
            part = raw[i : i + CALL_CHUNKS]
            chunks = [c.decode("utf-8", "replace") for c in part]
            encoded = self.encode(chunks)
            self._append(part, encoded, [self.extra(c, ids) for c, ids in zip(chunks, encoded)] if self.extra else None)

    def _rows(self, chunks: list[bytes]) -> list[int]:
        """The row of each chunk by its bytes; new chunks are encoded."""
        new = [c for c in chunks if c not in self.place]
        self._add(list(dict.fromkeys(new)) if new else new)
        return list(map(self.place.__getitem__, chunks))

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's row for each chunk span of the slice."""
        codes, distinct = pd.factorize(self.hashes(data, starts, ends))
        if self.size - self.fixed[0] + len(distinct) > self.limit:
            self._shrink()
        where = np.empty(len(distinct), np.int64)
        where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)  # first place of each distinct hash
        text = data.tobytes()
        rows = np.array(self._rows([text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]), np.int64)
        self.met[rows] += 1
        out = rows[codes]
        # a hash has found its first chunk only: all others are held against that chunk's bytes
        size, model = ends - starts, where[codes]
        apart = size != size[model]
        check = ~apart & (model != np.arange(len(codes)))
        if self.hashes is span_hashes:
            check &= size > 8  # up to 8 bytes the hash is a bijection
        check = np.flatnonzero(check & (size > 0))
        if len(check):
            n = size[check]
            same = data[flat_gather(starts[check], n)] == data[flat_gather(starts[model[check]], n)]
            if not same.all():
                apart[check] = np.add.reduceat(same.astype(np.int64), np.cumsum(n) - n) != n
        apart = np.flatnonzero(apart)
        if len(apart):
            out[apart] = self._rows([text[a:b] for a, b in zip(starts[apart].tolist(), ends[apart].tolist())])
        return out

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the given table rows in order, and how many each has."""
        counts = self.count[rows]
        return self.ids[flat_gather(self.first[rows], counts)], counts


def _count_chunks(cut: Callable):
    """Distinct chunks of a task's texts with how often they come; sent on whenever very many are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["chunk", "n"])
            held.clear()
            return out

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                starts, ends, _ = cut(data, offsets)
                codes, distinct = pd.factorize(span_hashes(data, starts, ends))
                where = np.empty(len(distinct), np.int64)
                where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
                text = data.tobytes()
                # a count only chooses what the table holds, so hashes may stand for chunks here
                for a, b, n in zip(starts[where].tolist(), ends[where].tolist(), np.bincount(codes, minlength=len(distinct)).tolist()):
                    chunk = text[a:b]
                    held[chunk] = held.get(chunk, 0) + n
                if len(held) > TABLE_CHUNKS:
                    yield flush()
        yield flush()

    return run


def corpus_table(texts: DataFrame, cut: Callable, encode: Callable, limit: int = CORPUS_CHUNKS) -> DataFrame:
    """(chunk, ids, extra) of the distinct chunks with at least two and a ``limit``-th of all occurrences: at most ``limit`` rows.

    texts has one string column; cut gives chunk starts and ends of a slice; encode maps chunk strings to (ids, extra) pairs.
    """
    counts = materialize(texts.mapInArrow(_count_chunks(cut), "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n")).where("n > 1"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = encode([c.decode("utf-8", "replace") for c in batch.column(0).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.string())], ["chunk", "ids", "extra"])

    often = counts.where(F.col("n") >= max(2, total / limit)).select("chunk")
    return materialize(often.mapInArrow(run, "chunk binary, ids array<int>, extra string"))
