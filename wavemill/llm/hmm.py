"""Language-model scoring by a hidden Markov model.

Tokens are lower-cased words and one end per text. The model factors a text's probability exactly:

    P(text) = sum over state paths of  prod A(z' | z) B(g(w) | z)  *  prod over rare words  P(w | g(w))

``g`` maps a frequent word to itself and any other word to a class by its ending and length; classes and frequent
words are the emissions of the hidden chain, and within a class words share the class's mass by smoothed training
counts, unseen words included. Baum-Welch counts (expected transitions and emissions) are made in every partition and
added up across them; the scaled forward recursion runs over each whole text.

Vocabulary sizes are bounded by counts, not by cutting the data: at most ``M`` words can have a count of N / M or more.
 * emissions: words with at least N / SYMBOLS training occurrences, plus the classes;
 * broadcast counts: words with at least N / COUNTED occurrences (12 bytes each);
 * all other words join their counts through a shuffle, so counts cover the whole corpus at any size.

The chain starts from random emissions and is fitted on all training texts for ``rounds`` rounds. Texts are turned into
emissions once. Null text counts as empty: its only token is the end. Very long texts are a run of their own. Repeated rows
are scored each. A null id counts as training text. Without training texts every probability is the smoothing's; an empty
table gives an empty result. Only the id and text columns are used, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, small_batches, span_hashes, text_slices, word_bounds

STATES = 6
SYMBOLS, COUNTED = 1 << 15, 1 << 21
CLASSES = 1 << 11
ADD = 0.1
#: Texts that run through the recursions side by side, tokens of such a group, and tokens gathered before a run.
LANES, LANE_TOKENS, GATHER = 2048, 1_000_000, 6_000_000
END = np.uint64(0)


@dataclass
class Lexicon:
    """What the executors need to turn words into emissions; every array has a bound given above."""

    total: int  # N, training tokens
    distinct: int  # V, distinct training tokens
    keys: np.ndarray  # hashes of the counted words, ascending
    counts: np.ndarray
    symbol: np.ndarray  # emission of a counted word, -1: its class
    n_symbols: int  # frequent words; classes follow
    class_log: np.ndarray  # log10 of a class's denominator

    @property
    def emissions(self) -> int:
        return self.n_symbols + CLASSES


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: row range, distinct hashes with their class, codes of all tokens (end included), first token of each text."""
    for i, j, data, offsets in text_slices(column):
        low = lower_ascii(data)
        starts, ends, first = word_bounds(low, offsets)
        h = span_hashes(low, starts, ends)
        h[h == END] = 1
        tail = span_hashes(low, np.maximum(starts, ends - 4), ends) + np.minimum(ends - starts, 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        cls = (tail >> np.uint64(40)).astype(np.int64) % CLASSES
        at = first[1:]
        h, cls = np.insert(h, at, END), np.insert(cls, at, 0)
        bounds = first + np.arange(j - i + 1)
        codes, distinct = pd.factorize(h)
        where = np.empty(len(distinct), np.int64)
        where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        yield i, j, distinct, cls[where], codes, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, distinct, cls, codes, _ in _words(batch.column(0)):
            yield pa.record_batch([pa.array(distinct.view(np.int64)), pa.array(cls), pa.array(np.bincount(codes, minlength=len(distinct)))], ["word", "cls", "n"])


def count_words(train: DataFrame) -> DataFrame:
    """(word hash, cls, c) of all training tokens, summed per slice before the shuffle; the end has word 0."""
    counts = train.select("text").mapInArrow(_count, "word long, cls long, n long")
    return materialize(counts.groupBy("word").agg(F.min("cls").alias("cls"), F.sum("n").alias("c")))


def build_lexicon(counts: DataFrame) -> Lexicon:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # at most COUNTED rows reach this threshold, whatever the corpus
    rows = counts.where((F.col("c") >= max(1.0, n / COUNTED)) | (F.col("word") == 0)).select("word", "c").toPandas()
    keys = rows["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, held = keys[order], rows["c"].to_numpy(np.int64)[order]
    often = (held >= max(2.0, n / SYMBOLS)) | (keys == END)
    symbol = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
    rare = counts.join(_frequent(counts, n), "word", "left_anti")
    per_class = rare.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()  # CLASSES rows
    mass = np.full(CLASSES, ADD)
    mass[per_class["cls"].to_numpy(np.int64)] += per_class["n"].to_numpy(float) + ADD * per_class["v"].to_numpy(float)
    return Lexicon(int(n), int(v), keys, held, symbol, int(often.sum()), np.log10(mass))


def _frequent(counts: DataFrame, n: int) -> DataFrame:
    return counts.where((F.col("c") >= max(2.0, n / SYMBOLS)) | (F.col("word") == 0)).select("word")


def _coded(column: pa.Array, lexicon: Lexicon) -> Iterator[tuple]:
    """Per slice: row range, emissions of all tokens, bounds, and per distinct word: its emission, class, known count, hash."""
    for i, j, distinct, cls, codes, bounds in _words(column):
        at = np.searchsorted(lexicon.keys, distinct)
        at[at == len(lexicon.keys)] = 0
        found = lexicon.keys[at] == distinct if len(lexicon.keys) else np.zeros(len(distinct), bool)
        count = np.where(found, lexicon.counts[at] if len(lexicon.keys) else 0, 0)
        own = np.where(found, lexicon.symbol[at] if len(lexicon.keys) else -1, -1)
        emission = np.where(own >= 0, own, lexicon.n_symbols + cls)
        yield i, j, emission[codes].astype(np.int32), codes, bounds, own < 0, cls, count, found, distinct


# ---------------------------------------------------------------- the chain


@dataclass
class Chain:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # emissions x K

    @staticmethod
    def fresh(emissions: int, states: int, seed: int) -> Chain:
        rng = np.random.default_rng(seed)
        emit = 0.2 + rng.random((emissions, states))
        move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        return Chain(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _lanes(emissions: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of similar length side by side: (their rows, steps x texts of emissions, lengths), longest first."""
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    ordered = length[order]
    first = 0
    while first < len(order):
        longest = int(ordered[first])
        similar = int(np.searchsorted(-ordered, -(longest // 2), "right"))  # at least half as long
        rows = order[first : min(similar, first + LANES, first + max(1, LANE_TOKENS // longest))]
        first += len(rows)
        n = length[rows]
        grid = np.full((n[0], len(rows)), -1, np.int32)
        column = np.repeat(np.arange(len(rows)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        grid[step, column] = emissions[np.repeat(bounds[rows], n) + step]
        yield rows, grid, n


def _alive(n: np.ndarray, steps: int) -> np.ndarray:
    """How many of the (longest first) texts still run at each step."""
    return len(n) - np.searchsorted(n[::-1], np.arange(steps), "right")


def log_likelihood(chain: Chain, emissions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 of each text's emission sequence: the scaled forward recursion, exact over whole texts."""
    out = np.zeros(len(bounds) - 1)
    fore, start, emit = np.ascontiguousarray(chain.move.T), chain.start[:, None], np.ascontiguousarray(chain.emit.T)
    for rows, grid, n in _lanes(emissions, bounds):
        state, scales = start, np.ones(grid.shape)
        for t, m in enumerate(_alive(n, len(grid)).tolist()):
            state = (fore @ state[:, :m] if t else start) * emit.take(grid[t, :m], axis=1)
            state /= state.sum(axis=0, out=scales[t, :m])
        out[rows] = np.log10(scales).sum(axis=0)
    return out


def expected_counts(chain: Chain, emissions: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch sums over the texts: starts, moves, emissions, and the log10 likelihood. States are rows, texts lie side by side."""
    k = len(chain.start)
    starts, moves, emits, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros((k, len(chain.emit))), 0.0
    back = np.ascontiguousarray(chain.move, np.float32)
    fore, start, emit = np.ascontiguousarray(back.T), chain.start.astype(np.float32)[:, None], np.ascontiguousarray(chain.emit.T, np.float32)
    for _, grid, n in _lanes(emissions, bounds):
        steps, lanes = grid.shape
        alive = _alive(n, steps).tolist()
        ahead, state, arriving = (np.zeros((steps, k, lanes), np.float32) for _ in range(3))
        scales = np.ones((steps, lanes), np.float32)
        before = start
        for t, m in enumerate(alive):
            made = emit.take(grid[t, :m], axis=1)
            ahead[t, :, :m] = fore @ before[:, :m] if t else start
            before = state[t, :, :m]
            np.multiply(ahead[t, :, :m], made, out=before)
            scale = before.sum(axis=0, out=scales[t, :m])
            before /= scale
            np.divide(made, scale, out=arriving[t, :, :m])
        behind = np.ones((k, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            a = arriving[t, :, : alive[t]]
            a *= behind[:, : alive[t]]
            behind[:, : alive[t]] = back @ a
        likelihood += float(np.log10(scales, dtype=float).sum())
        moves += np.matmul(state[:-1], arriving[1:].transpose(0, 2, 1)).sum(axis=0, dtype=float) * chain.move
        ahead *= arriving  # the posteriors
        starts += ahead[0].sum(axis=1)
        seen = np.flatnonzero(grid.ravel() >= 0)
        at = grid.ravel()[seen]
        for s in range(k):
            emits[s] += np.bincount(at, weights=ahead[:, s].ravel()[seen], minlength=emits.shape[1])
    return starts, moves, emits.T, likelihood


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray, object]]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Joins (emissions, bounds, rest) until about GATHER tokens are held: wide groups of texts make the recursions fast."""
    held, tokens = [], 0
    for part in parts:
        held.append(part)
        tokens += len(part[0])
        if tokens >= GATHER:
            yield _joined(held)
            held, tokens = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, list]:
    lengths = np.concatenate([np.diff(b) for _, b, _ in held])
    return np.concatenate([e for e, *_ in held]), np.concatenate(([0], np.cumsum(lengths))), [r for *_, r in held]


def _emissions(lexicon):
    """One row per text: its emissions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, emissions, _, bounds, *_ in _coded(batch.column(0), lexicon.value):
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(emissions))], ["emissions"])

    return run


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, None]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets.astype(np.int64) - offsets[0], None


def _expect(chain):
    """One row per emission met (row >= 0) and, with row = -1 - k, of transitions and starts (row -1 - K), per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = chain.value
        k = len(c.start)
        starts, moves, emits, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros(c.emit.shape), 0.0
        for emissions, bounds, _ in _gathered(_listed(batch.column(0)) for batch in batches):
            found = expected_counts(c, emissions, bounds)
            for total, more in zip((starts, moves, emits), found):
                total += more
            likelihood += found[3]
        met = np.flatnonzero(emits.sum(axis=1))
        rows = np.concatenate((met, -1 - np.arange(k + 2)))
        extra = np.zeros(k)
        extra[0] = likelihood
        values = np.concatenate((emits[met], moves, starts[None], extra[None]))
        yield pa.record_batch([pa.array(rows), *(pa.array(values[:, s]) for s in range(k))], ["row", *(f"s{s}" for s in range(k))])

    return run


def baum_welch(train: DataFrame, chain: Chain, lexicon, rounds: int) -> tuple[Chain, list[float]]:
    """rounds of expectation over all partitions of train (column text) and re-estimation; the model is bounded, so it meets on the driver."""
    spark = train.sparkSession
    k, said = len(chain.start), []
    base = np.maximum(_unigram(lexicon.value), 1e-12)
    coded = materialize(train.select("text").mapInArrow(_emissions(lexicon), "emissions array<int>")) if rounds else None
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(chain)
        schema = "row long, " + ", ".join(f"s{s} double" for s in range(k))
        found = coded.mapInArrow(_expect(sent), schema).groupBy("row").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(k))).toPandas()
        rows, values = found["row"].to_numpy(np.int64), found.drop(columns="row").to_numpy(float)
        emits, rest = np.zeros(chain.emit.shape), np.zeros((k + 2, k))
        emits[rows[rows >= 0]] = values[rows >= 0]
        rest[-1 - rows[rows < 0]] = values[rows < 0]
        said.append(float(rest[k + 1, 0]))
        # each state backs off to the corpus's own distribution with the weight of one token per emission
        weight = 0.02 * len(base)
        emits = emits + weight * base[:, None]
        moves = rest[:k] + 0.1
        chain = Chain((rest[k] + 0.1) / (rest[k] + 0.1).sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    return chain, said


def _unigram(lexicon: Lexicon) -> np.ndarray:
    """Smoothed training share of every emission."""
    mass = np.concatenate((np.full(lexicon.n_symbols, ADD), 10.0**lexicon.class_log))
    own = lexicon.symbol >= 0
    mass[lexicon.symbol[own]] += lexicon.counts[own]
    return mass / mass.sum()


# ---------------------------------------------------------------- scoring


def _score(chain, lexicon):
    """(id, text) -> id, row sums that need no other row, and (word, times) of the words whose counts are not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, lex = chain.value, lexicon.value
        complete = lex.total <= COUNTED  # then every counted word was broadcast

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray, object]]:
            for batch in batches:
                for i, j, emissions, codes, bounds, rare, cls, count, found, distinct in _coded(batch.column(1), lex):
                    owner = np.repeat(np.arange(j - i), np.diff(bounds))
                    add = lambda w, owner=owner, n=j - i: np.bincount(owner, weights=w, minlength=n)
                    open_ = ~found & (not complete)
                    log_count = np.where(open_, 0.0, np.log10(count + ADD))
                    inner = np.where(rare, log_count - lex.class_log[cls], 0.0)
                    missing = np.flatnonzero(open_[codes])
                    pair, times = np.unique(owner[missing] * np.int64(len(distinct)) + codes[missing], return_counts=True)
                    cuts = np.searchsorted(pair // max(1, len(distinct)), np.arange(j - i + 1)).astype(np.int32)
                    words = distinct[pair % max(1, len(distinct))].view(np.int64)
                    lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (words, times.astype(np.int64))]
                    sums = [np.diff(bounds), add((count > 0)[codes].astype(float)).astype(np.int64), add(log_count[codes])]
                    yield emissions, bounds, (batch.column(0).slice(i, j - i), sums, add(inner[codes]), lists)

        for emissions, bounds, rest in _gathered(parts()):
            chained, first = log_likelihood(c, emissions, bounds), 0
            for ids, sums, inner, lists in rest:
                score = chained[first : first + len(ids)] + inner
                first += len(ids)
                yield pa.record_batch([ids, *map(pa.array, sums), pa.array(score), *lists], ["id", "n_tokens", "n_known", "log_counts", "score", "words", "times"])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = 10, seed: int = 5) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out_of_training = F.coalesce(F.crc32(F.col("id").cast("string")) % 10 == 0, F.lit(False))
    train = docs.where(~out_of_training)
    counts = count_words(train)
    lexicon = build_lexicon(counts)
    sent = spark.sparkContext.broadcast(lexicon)
    chain = Chain.fresh(lexicon.emissions, states, seed)
    chain = Chain(chain.start, chain.move, chain.emit * _unigram(lexicon)[:, None])
    chain.emit /= chain.emit.sum(axis=0)
    chain, _ = baum_welch(train, chain, sent, rounds)

    schema = "id long, n_tokens long, n_known long, log_counts double, score double, words array<long>, times array<long>"
    scored = docs.mapInArrow(_score(spark.sparkContext.broadcast(chain), sent), schema)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()))
    tail = scored.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
    tail = tail.select("row", F.col("w.words").alias("word"), F.col("w.times").alias("n"))
    tail = tail.join(counts.where((F.col("c") < max(1.0, lexicon.total / COUNTED)) & (F.col("word") != 0)).select("word", "c"), "word", "left")
    tail = tail.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"))
    out = scored.drop("words", "times").join(tail, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    norm = float(np.log10(lexicon.total + ADD * (lexicon.distinct + 1)))
    return out.select(
        F.col("id").alias(id_col), out_of_training.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"), (F.col("log_counts") + more - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("score") + more).alias("score"),
    )
