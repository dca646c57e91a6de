"""Quality classifier by co-training two views of a document.

The content view reads the words: hashed words, pairs of neighbouring words and word endings, and how much the text
repeats itself. The metadata view sees what a page record tells without reading it as language: length, lines, layout
and character classes, language, source. Each view is a logistic regression. In every round each view labels the
unlabelled documents that it is sure of, and the other view is fitted on the labelled rows and these. At the end both
views are calibrated on labelled rows that no fit has seen, and the mean of their calibrated log-odds scores every
document.

Nothing is sampled: features of all documents are stored once (some 700 bytes a document), every Newton step of a fit is
one pass over them whose sums are made in the tasks and added up by Spark, and the driver only solves for the few hundred
weights. Scoring is one pass without a shuffle.

Null text counts as empty; null language or source is a value of its own. Documents with several labels take the
majority, ties count as good; null labels and labels of unknown documents are ignored. With labels of one class only,
every score is that class's share; without any labels everything scores 1. Repeated rows score alike and each take part
in the fit. Extra columns are kept; a column named like an output column is replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_ascii, materialize, mix, small_batches, span_hashes, text_slices, word_bounds

ENDINGS, WORDS, PAIRS = 96, 64, 32  # buckets of word endings, words, pairs of neighbouring words
LEXICAL = ENDINGS + WORDS + PAIRS
HASHED = 8  # buckets of language and of source
CURVATURE = 0.05  # the least curvature of a row: keeps Newton steps short where guesses are sure
CONTENT, METADATA = LEXICAL + 5, 12 + 2 * HASHED


def content_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: shares of hashed word endings (two bytes), words and word pairs, and how much it repeats itself."""
    n = len(offsets) - 1
    low = lower_ascii(data)
    starts, ends, first = word_bounds(low, offsets)
    h = span_hashes(low, starts, ends)
    ending = (span_hashes(low, np.maximum(starts, ends - 2), ends) >> np.uint64(33)).astype(np.int64) % ENDINGS
    counts = np.diff(first)
    owner = np.repeat(np.arange(n), counts)
    total = np.maximum(counts, 1)
    out = np.zeros((n, CONTENT))
    pair = mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])[owner[1:] == owner[:-1]] if len(h) else h
    for bucket, whose, at, width in (
        (ending, owner, 0, ENDINGS),
        ((h >> np.uint64(40)).astype(np.int64) % WORDS, owner, ENDINGS, WORDS),
        ((pair >> np.uint64(40)).astype(np.int64) % PAIRS, owner[1:][owner[1:] == owner[:-1]], ENDINGS + WORDS, PAIRS),
    ):
        held = np.bincount(whose * width + bucket, minlength=n * width).reshape(n, width)
        out[:, at : at + width] = np.sqrt(held / total[:, None])
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    out[:, LEXICAL] = np.bincount(owner, weights=same, minlength=n) / total
    order = np.lexsort((h, owner))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    whose = owner[order][new]
    out[:, LEXICAL + 1] = np.bincount(whose, minlength=n) / total
    np.maximum.at(out[:, LEXICAL + 2], whose, runs)
    out[:, LEXICAL + 2] /= total
    out[:, LEXICAL + 3] = np.bincount(whose, weights=runs == 1, minlength=n) / total
    out[:, LEXICAL + 4] = counts == 0
    return out


def _hashed(column: pa.Array) -> np.ndarray:
    """One-hot buckets of a string column; null has its own value."""
    values = column.to_pylist()
    known = {v: (-1 if v is None else int(span_hashes(np.frombuffer(v.encode() or b"\x00", np.uint8), np.array([0]), np.array([max(1, len(v.encode()))]))[0] >> np.uint64(40)) % (HASHED - 1)) for v in set(values)}
    out = np.zeros((len(values), HASHED))
    out[np.arange(len(values)), [known[v] for v in values]] = 1.0
    return out


def metadata_features(data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Per text: length, lines, widths, character classes, hashed language and source."""
    size = np.diff(offsets).astype(float)
    total = np.maximum(size, 1)
    starts, ends, first = word_bounds(data, offsets)
    count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    words = np.maximum(np.diff(first), 1)
    upper, lower = count((data >= 65) & (data <= 90)), count(((data >= 97) & (data <= 122)) | (data >= 128))
    lines = count(data == 10)
    stops = count((data == 46) | (data == 44))
    marks = count((data == 33) | (data == 63))
    odd = count((data >= 33) & (data <= 126)) - upper - count((data >= 97) & (data <= 122)) - stops - marks
    digits = count((data >= 48) & (data <= 57))
    width = count(data > 32) / words
    stats = [np.log1p(size) / 8, np.log1p(lines) / 4, lines / words, width / 8, np.abs(width - 5.5) / 8, upper / total, lower / total, stops / words, marks / words, (odd - digits) / words, digits / total, size == 0]
    return np.column_stack([*stats, lang, source]).astype(float)


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of (text, lang, source) rows."""
    lang, source = _hashed(batch.column(1)), _hashed(batch.column(2))
    content, meta = [np.zeros((0, CONTENT))], [np.zeros((0, METADATA))]
    for i, j, data, offsets in text_slices(batch.column(0)):
        content.append(content_features(data, offsets))
        meta.append(metadata_features(data, offsets, lang[i:j], source[i:j]))
    return np.concatenate(content), np.concatenate(meta)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        views = [v.astype(np.float32) for v in _features(batch)]
        yield pa.record_batch([*batch.columns[3:], *(pa.array([row.tobytes() for row in v], pa.binary()) for v in views)], [*batch.schema.names[3:], "content", "meta"])


@dataclass
class View:
    """A calibrated logistic regression: log-odds = slope * (w x + b) + offset."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (x @ self.weights + self.bias) + self.offset


@dataclass
class Quality:
    views: tuple[View, View] | None
    prior: float

    def score(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good text by content, by metadata, and combined."""
        if self.views is None:
            p = np.full(len(content), self.prior)
            return p, p, p
        a, b = self.views[0].log_odds(content), self.views[1].log_odds(meta)
        return tuple(1 / (1 + np.exp(-np.clip(z, -500, 500))) for z in (a, b, (a + b) / 2))


def _stored(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), width).astype(float)


def _pairs(parts: list[np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate([p.ravel() for p in parts])
    return pa.record_batch([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "v"])


def _summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """Adds up the tasks' (k, v) sums; size numbers come to the driver."""
    found = rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[found["k"].to_numpy(np.int64)] = found["v"].to_numpy(float)
    return out


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = [np.zeros(1)] + [np.zeros((2, w)) for w in (CONTENT, METADATA)]
    for batch in batches:
        sums[0] += len(batch)
        for total, column, width in zip(sums[1:], (2, 3), (CONTENT, METADATA)):
            x = _stored(batch.column(column), width)
            total += x.sum(axis=0), (x * x).sum(axis=0)
    yield _pairs(sums)


def _newton_sums(views, teachers, means, scales, confident: float, trust: float):
    """Gradient and curvature of both views' likelihoods. Labelled rows count 1; an unlabelled row that the other view's teacher is sure of counts ``trust``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[np.zeros(w + 2), np.zeros((w + 1, w + 1))] for w in (CONTENT, METADATA)]
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)  # NaN: unlabelled
            xs = [np.column_stack(((_stored(batch.column(c), w) - m) / s, np.ones(len(batch)))) for c, w, m, s in zip((2, 3), (CONTENT, METADATA), means, scales)]
            for k, x in enumerate(xs):
                target, weight = y, (~np.isnan(y)).astype(float)
                if teachers is not None:
                    told = xs[1 - k] @ teachers[1 - k]
                    sure = np.isnan(y) & (np.abs(told) >= confident)
                    target, weight = np.where(sure, told > 0, y), np.where(sure, trust, weight)
                used = weight > 0
                x, target, weight = x[used], target[used], weight[used]
                p = 1 / (1 + np.exp(-np.clip(x @ views[k], -30, 30)))
                sums[k][0][:-1] += x.T @ (weight * (target - p))
                sums[k][0][-1] += weight.sum()
                sums[k][1] += (x * (weight * np.maximum(p * (1 - p), CURVATURE))[:, None]).T @ x
        yield _pairs([part for view in sums for part in view])

    return run


def _step(weights: np.ndarray, sums: np.ndarray, rows: float, share: float) -> np.ndarray:
    """One damped Newton step with a ridge worth ``rows`` rows and a share of all; the constant is free of it."""
    d = len(weights)
    gradient, n, curvature = sums[:d], sums[d], sums[d + 1 :].reshape(d, d)
    ridge = np.full(d, rows + share * n + 1e-9)
    ridge[-1] = 1e-6 * n + 1e-9
    step = np.linalg.solve(curvature + np.diag(ridge), gradient - ridge * weights)
    return weights + step * min(1.0, 10.0 / max(1e-9, float(np.abs(step).max())))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", lang_col: str = "lang", source_col: str = "source",
    rounds: int = 3, confident: float = 2.5, trust: float = 0.2, first_steps: int = 6, steps: int = 2, ridge_rows: float = 5.0, ridge_share: float = 1e-4,
) -> Quality:
    """``rounds`` of exchange over all unlabelled documents: a view labels for the other those with |log-odds| >= confident, each counting ``trust``."""
    small_batches(docs.sparkSession)
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    wanted = [F.col(f"`{c}`").cast("string").alias(f"_{k}") for k, c in enumerate((text_col, lang_col, source_col))]
    rows = docs.select(*wanted, F.col(f"`{id_col}`").alias("id")).mapInArrow(_feature_rows, f"id {docs.schema[id_col].dataType.simpleString()}, content binary, meta binary")
    rows = rows.join(marked, "id", "left").select("y", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(5)).cast("int").alias("fold"), "content", "meta")
    rows = materialize(rows)
    try:
        return _co_train(rows, rounds, confident, trust, first_steps, steps, ridge_rows, ridge_share)
    finally:
        discard(rows)


def _co_train(rows: DataFrame, rounds: int, confident: float, trust: float, first_steps: int, steps: int, ridge_rows: float, ridge_share: float) -> Quality:
    known = rows.where("y is not null")
    n, good = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    train, held = known.where("fold > 0"), known.where("fold = 0")
    classes = train.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    if not n or min(classes) < 2:
        return Quality(None, good / n if n else 1.0)
    found = _summed(train, _moments, 1 + 2 * (CONTENT + METADATA))
    halves = found[1 : 1 + 2 * CONTENT].reshape(2, -1), found[1 + 2 * CONTENT :].reshape(2, -1)
    means = [h[0] / found[0] for h in halves]
    scales = [np.sqrt(np.maximum(h[1] / found[0] - m * m, 0)) for h, m in zip(halves, means)]
    scales = [np.where(s > 1e-6, s, 1e3) for s in scales]  # a feature that never varies stays silent

    widths = [CONTENT + 1, METADATA + 1]
    cuts = np.cumsum([0] + [w + 1 + w * w for w in widths])
    views, teachers = [np.zeros(w) for w in widths], None

    def fitted(part: DataFrame, times: int) -> None:
        for _ in range(times):
            sums = _summed(part, _newton_sums(views, teachers, means, scales, confident, trust), cuts[-1])
            before = list(views)
            views[:] = [_step(v, sums[a:b], ridge_rows, ridge_share) for v, a, b in zip(views, cuts, cuts[1:])]
            if max(np.abs(a - b).max() for a, b in zip(before, views)) < 1e-3:
                break

    fitted(train, first_steps)
    learning = rows.where("y is null or fold > 0")
    for _ in range(rounds):
        teachers = list(views)
        fitted(learning, steps)
    made = tuple(View(v[:-1] / s, float(v[-1] - (v[:-1] * m / s).sum())) for v, m, s in zip(views, means, scales))
    classes = held.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    if min(classes) >= 2:
        _calibrate(held, made)
    return Quality(made, good / n)


def _calibrate(held: DataFrame, views: tuple[View, View]) -> None:
    """Fits slope and offset of each view's log-odds on rows that no fit has seen."""
    lines = [np.array([1.0, 0.0]) for _ in views]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.zeros(3 + 4) for _ in views]
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            for part, view, line, c, w in zip(parts, views, lines, (2, 3), (CONTENT, METADATA)):
                x = np.column_stack((_stored(batch.column(c), w) @ view.weights + view.bias, np.ones(len(batch))))
                p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
                part += np.concatenate((x.T @ (y - p), [len(y)], ((x * (p * (1 - p))[:, None]).T @ x).ravel()))
        yield _pairs(parts)

    for _ in range(5):
        found = _summed(held, sums, 14)
        lines[:] = [_step(line, found[7 * k : 7 * k + 7], 0.0, 1e-2) for k, line in enumerate(lines)]
    for view, line in zip(views, lines):
        if line[0] > 0:
            view.slope, view.offset = float(line[0]), float(line[1])


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.score(*_features(batch))
            yield pa.record_batch([*batch.columns[3:], *map(pa.array, scores)], [*batch.schema.names[3:], "p_content", "p_metadata", "score"])

    return run


def score_quality(docs: DataFrame, model: Quality, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) plus p_content, p_metadata and score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    outputs = ("p_content", "p_metadata", "score")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} double" for c in outputs)])
    rows = docs.select(*(F.col(f"`{c}`").cast("string").alias(f"_{k}") for k, c in enumerate((text_col, lang_col, source_col))), *(F.col(f"`{c}`") for c in keep))
    return rows.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), schema)
