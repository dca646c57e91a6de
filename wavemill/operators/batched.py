"""Many logistic regressions fitted together: one aggregation per Newton step holds the sums of all models.

A model is named by a group of rows, a repeat and a held-out part. A row carries its group and one part per repeat; it is
fitted by the models of its group that do not hold its part out and scored by the one that does; a negative part is in
neither. Folds, repeats, inner folds and hyperparameters are thus all models of one pass.

Every task sums loss, gradient and curvature of each model over its rows; the sums (one row per task, model and entry) are
added by Spark, and the driver solves one small system per model. What it holds is bounded by models x features squared.
Steps are halved where the loss would rise, so separable classes and small penalties converge too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..sources.tables import stored
from .metrics import auc, ratio


@dataclass(frozen=True)
class Fit:
    """penalty: of half the squared coefficients (the inverse of C), against the sum of the rows' losses; the intercept is free."""

    group: int
    held: int = 1
    repeat: int = 0
    penalty: float = 1.0
    balanced: bool = True


def by_role(rows: DataFrame) -> DataFrame:
    """parts for rows with a role: fit rows are fitted, all others scored (held = 1)."""
    return rows.withColumn("parts", F.array(F.when(F.col("role") == "fit", 0).otherwise(1)))


#: The only column of packed rows.
BLOCK = "block"


def packed(rows: DataFrame, features: list[str], group: str = "fold", y: str = "y", parts: str = "parts") -> DataFrame:
    """rows for many fits, a compressed Arrow batch a row: a pass over them costs Spark and the way to Python next to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                told = pa.BufferOutputStream()
                with pa.ipc.new_stream(told, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch)
                yield pa.record_batch([pa.array([told.getvalue().to_pybytes()], pa.binary())], [BLOCK])

    return rows.select(*features, y, group, parts).mapInArrow(run, f"{BLOCK} binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that are not empty; packed ones one by one."""
    for batch in batches:
        if batch.schema.names == [BLOCK]:
            for block in batch.column(0):
                yield from pa.ipc.open_stream(block.as_buffer())
        elif len(batch):
            yield batch


def _arrays(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (null and NaN as 0), label, group and parts of a batch whose first columns they are.

    Parts are a list or, in less space, one signed byte each. Label and group may be lists too: their row stands for as many
    rows with the same features, whose parts follow each other.
    """
    x = np.column_stack([np.nan_to_num(batch.column(k).to_numpy(zero_copy_only=False).astype(float)) for k in range(features)])
    y, group = (batch.column(features + k) for k in (0, 1))
    if pa.types.is_list(y.type):
        y, group = y.flatten(), group.flatten()
        x = np.repeat(x, len(y) // len(batch), 0)
    parts = batch.column(features + 2)
    if pa.types.is_binary(parts.type):
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset :]
        flat = np.frombuffer(parts.buffers()[2], np.int8)[offsets[0] : offsets[len(parts)]]
    else:
        flat = parts.flatten().to_numpy(zero_copy_only=False)
    return x, y.to_numpy(zero_copy_only=False).astype(float), group.to_numpy(zero_copy_only=False), flat.reshape(len(y), -1)


#: Rows of a group that are summed together; what is made of them stays in a core's cache.
TILE_ROWS = 2048


def _summed(rows: DataFrame, columns: list[str], features: int, fits: list[Fit], models: list[int], width: int, add) -> np.ndarray:
    """(fits x width) sums of what ``add(models of a group, x, y, fitted)`` gives for its rows; fitted tells (rows x models) who is fitted by whom."""
    groups = {g: np.array([k for k in models if fits[k].group == g]) for g in {fits[k].group for k in models}}
    repeat, held = np.array([f.repeat for f in fits]), np.array([f.held for f in fits])
    total = len(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((total, width))
        for batch in _unpacked(batches):
            x, y, group, parts = _arrays(batch, features)
            for g, own in groups.items():
                at = np.flatnonzero(group == g)
                for start in range(0, len(at), TILE_ROWS):
                    some = at[start : start + TILE_ROWS]
                    part = parts[some][:, repeat[own]]
                    fitted = (part >= 0) & (part != held[own])
                    sums[own] += add(own, x[some], np.where(fitted.any(1), y[some], 0.0), fitted)
        found = np.flatnonzero(sums.any(1))
        yield pa.record_batch([pa.array(found, pa.int32()), pa.array(sums[found].tolist(), pa.list_(pa.float64()))], ["model", "sums"])

    out = np.zeros((total, width))
    per = rows.select(*columns).mapInArrow(run, "model int, sums array<double>").select("model", F.posexplode("sums").alias("at", "v"))
    for model, at, v in per.groupBy("model", "at").agg(F.sum("v")).collect():  # models x width rows
        out[model, at] = v
    return out


class Fitted:
    """Coefficients of all models in the units of the features, intercept last; ``rows``: fitted rows of each model and how many are positive.

    ``mean`` and ``scale`` are those of the features over a model's fitted rows.
    """

    def __init__(self, fits: list[Fit], features: list[str], coef: np.ndarray, rows: np.ndarray, steps: int, mean: np.ndarray, scale: np.ndarray):
        self.fits, self.features, self.coef, self.rows, self.steps, self.mean, self.scale = fits, features, coef, rows, steps, mean, scale


def _columns(rows: DataFrame, features: list[str], y: str, group: str, parts: str) -> list[str]:
    return [BLOCK] if rows.columns == [BLOCK] else [*features, y, group, parts]


def logistic_fits(rows: DataFrame, features: list[str], fits: list[Fit], group: str = "fold", y: str = "y", parts: str = "parts", most_steps: int = 60, start: np.ndarray | None = None) -> Fitted:
    """All ``fits`` over a stored table, which may be packed; features are standardised by the fitted rows of each model (so the penalty is on standard units).

    start: coefficients of each model in the units of the features from which its steps begin.
    """
    p, columns, everyone = len(features), _columns(rows, features, y, group, parts), list(range(len(fits)))

    def moments(own, x, y_, fitted):
        m = fitted.astype(float)
        return np.column_stack((m.sum(0), y_ @ m, m.T @ x, m.T @ (x * x)))

    found = _summed(rows, columns, p, fits, everyone, 2 + 2 * p, moments)
    n, pos = found[:, 0], found[:, 1]
    size = np.maximum(n, 1)[:, None]
    mean = found[:, 2 : 2 + p] / size
    scale = np.sqrt(np.maximum(found[:, 2 + p :] / size - mean**2, 0))
    scale[scale < 1e-12 * np.maximum(1, np.abs(mean))] = 1.0
    balanced = np.array([f.balanced for f in fits])
    w1, w0 = (np.where(balanced, n / (2 * np.maximum(c, 1)), 1.0) for c in (pos, n - pos))
    penalty = np.array([f.penalty for f in fits])
    upper = np.triu_indices(p + 1)
    width = 1 + (p + 1) + len(upper[0])
    # a group's rows are standardised once, by its first model that has rows; ``turn`` leads from there to the units of each model
    first = {g: next((k for k in everyone if fits[k].group == g and n[k]), 0) for g in {f.group for f in fits}}
    base = [first[f.group] for f in fits]
    turn = np.zeros((len(fits), p + 1, p + 1))
    turn[:, range(p), range(p)] = scale[base] / scale
    turn[:, :p, p] = (mean[base] - mean) / scale
    turn[:, p, p] = 1.0
    beta, ahead = np.zeros((len(fits), p + 1)), np.zeros((len(fits), p + 1))  # accepted and tried
    if start is not None:
        ahead = np.column_stack((start[:, :p] * scale, start[:, p] + (start[:, :p] * mean).sum(1)))
    loss, step, share = np.full(len(fits), np.inf), np.zeros((len(fits), p + 1)), np.ones(len(fits))
    active = [k for k in everyone if 0 < pos[k] < n[k]]  # a single class has nothing to learn
    steps = 0
    while active and steps < most_steps:
        steps += 1
        tried = ahead.copy()
        slope = np.einsum("kij,ki->kj", turn, tried)

        def sums(own, x, y_, fitted, slope=slope):
            z = np.column_stack(((x - mean[base[own[0]]]) / scale[base[own[0]]], np.ones(len(x))))
            t = y_[:, None]
            eta = z @ slope[own].T
            w = np.where(t > 0, w1[own], w0[own]) * fitted
            e = np.exp(-np.abs(eta))
            prob = np.where(eta >= 0, 1.0, e) / (1 + e)
            loss = (w * (np.maximum(eta, 0) + np.log(1 + e) - t * eta)).sum(0)
            return np.column_stack((loss, (w * (prob - t)).T @ z, (w * prob * (1 - prob)).T @ (z[:, upper[0]] * z[:, upper[1]])))

        got = _summed(rows, columns, p, fits, active, width, sums)
        left = []
        for k in active:
            ridge = np.append(np.full(p, penalty[k]), 0.0)
            here = got[k, 0] + 0.5 * (ridge * tried[k] ** 2).sum()
            if here > loss[k] + 1e-9 * max(1.0, abs(loss[k])) and share[k] > 1e-4:
                share[k] /= 2
            else:
                beta[k], loss[k], share[k] = tried[k], here, 1.0
                curve = np.zeros((p + 1, p + 1))
                curve[upper] = got[k, 2 + p :]
                curve = turn[k] @ (curve + curve.T - np.diag(curve.diagonal())) @ turn[k].T + np.diag(ridge + 1e-12)
                step[k] = np.linalg.lstsq(curve, turn[k] @ got[k, 1 : 2 + p] + ridge * tried[k], rcond=None)[0]
                if np.abs(step[k]).max() < 1e-8:
                    continue
            ahead[k] = beta[k] - share[k] * step[k]
            left.append(k)
        active = left
    slopes = beta[:, :p] / scale
    return Fitted(fits, features, np.column_stack((slopes, beta[:, p] - (slopes * mean).sum(1))), found[:, :2].astype(int), steps, mean, scale)


def score_held(rows: DataFrame, fitted: Fitted, keep: list[str], models: list[int] | None = None, group: str = "fold", y: str = "y", parts: str = "parts") -> DataFrame:
    """(keep, y, model, prob): every row scored by the models of its group that hold its part out; models are numbers of ``fitted.fits``."""
    features, coef, fits = fitted.features, fitted.coef, fitted.fits
    wanted = list(range(len(fits))) if models is None else models
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, group_, parts_ = _arrays(batch, len(features))
            kept = batch.select(range(len(features) + 3, batch.num_columns))
            for k in wanted:
                f = fits[k]
                at = np.flatnonzero((group_ == f.group) & (parts_[:, f.repeat] == f.held))
                if len(at):
                    prob = 1 / (1 + np.exp(-np.clip(x[at] @ coef[k, :-1] + coef[k, -1], -700, 700)))
                    some = kept.take(pa.array(at))
                    yield pa.record_batch([*some.columns, pa.array(np.full(len(at), k, np.int32)), pa.array(prob)], [*some.schema.names, "model", "prob"])

    carried = [F.col(c).alias(f"kept{k}") for k, c in enumerate([*keep, y])]
    schema = ", ".join([*(f"kept{k} {types[c]}" for k, c in enumerate([*keep, y])), "model int", "prob double"])
    out = rows.select(*_columns(rows, features, y, group, parts), *carried).mapInArrow(run, schema)
    return out.select(*(F.col(f"kept{k}").alias(c) for k, c in enumerate(keep)), F.col(f"kept{len(keep)}").alias("y"), "model", "prob")


def drawn_configs(spark, n: int, seed: str = "search", low: float = 1e-4, high: float = 1e1) -> list[tuple[float, bool]]:
    """(C, balanced) of n configurations: C log-uniform, both drawn by MD5."""
    unit = lambda what: draw(F.lit(seed), F.lit(what), "id") / F.lit(float(1 << 32))
    rows = spark.range(n).select("id", (F.lit(low) * F.pow(F.lit(high / low), unit("c"))).alias("c"), (unit("w") < 0.5).alias("w"))
    return [(r.c, r.w) for r in rows.orderBy("id").collect()]


def search_val_auc(rows: DataFrame, features: list[str], configs: list[tuple[float, bool]], groups: list[int], keep: list[str], group: str = "fold") -> tuple[DataFrame, DataFrame]:
    """All configurations of all groups in one fit. (predictions of the best one of each group, trace: group, config, auc).

    A configuration is judged by its AUC on role = 'val'; of equal ones the first is taken. Its model then scores val and test.
    """
    fits = [Fit(g, penalty=1 / c, balanced=w) for g in groups for c, w in configs]
    fitted = logistic_fits(rows, features, fits, group)
    val = score_held(rows.where("role = 'val'"), fitted, keep, group=group)
    trace = auc(val, ["model"]).withColumn("auc", F.coalesce("auc", F.lit(0.5))).collect()  # one row per model
    found = {r.model: r.auc for r in trace}
    best = [max((g * len(configs) + k for k in range(len(configs))), key=lambda m: (round(found.get(m, 0.5), 12), -m)) for g in range(len(groups))]
    told = rows.sparkSession.createDataFrame([(m, groups[m // len(configs)], m % len(configs), float(configs[m % len(configs)][0]), bool(configs[m % len(configs)][1]), found.get(m, 0.5)) for m in range(len(fits))], f"model int, {group} int, config int, c double, balanced boolean, auc double")
    preds = score_held(rows, fitted, ["role", *keep], best, group)
    return preds.join(F.broadcast(told.select("model", "config", "c", "balanced")), "model").drop("model"), told.drop("model")


#: Fitted rows of a model for each range into which its scores are cut; scores that a task holds before it sends them.
RANGE_ROWS, SENT_SCORES = 500_000, 4_000_000


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(column.to_pylist()), np.float64))


def held_auc(rows: DataFrame, fitted: Fitted, group: str = "fold", y: str = "y", parts: str = "parts") -> dict[int, float]:
    """ROC AUC of every model over the rows that it holds out, ties at mid-rank; none on a single class.

    Rows of many repeats have many scores, so they are not moved as rows: a task sends the scores of a model and range as two
    arrays, one for each class. A range is put in order alone, and the ranges' sums meet per model. Groups come one
    after the other; inside ``short_shuffles`` the disk holds one group's scores. Scores are those before the logistic curve.
    """
    p, coef, found = len(fitted.features), fitted.coef, {}
    reach = (np.abs(coef[:, :p]) * fitted.scale).sum(1)  # at least the scores' deviation
    ranges = np.where(reach > 0, 1 + fitted.rows[:, 0] // RANGE_ROWS, 1)
    low = (coef[:, :p] * fitted.mean).sum(1) + coef[:, p] - 4 * reach
    wide = ranges / np.where(reach > 0, 8 * reach, 1.0)  # ranges are of equal width, the outer ones open
    models = {}
    for model, f in enumerate(fitted.fits):
        models.setdefault(f.group, []).append((model, f.repeat, f.held))

    for g, own in models.items():

        def send(batches: Iterator[pa.RecordBatch], g=g, own=own) -> Iterator[pa.RecordBatch]:
            def ranged(kept):
                out = []
                for model, scores in kept.items():
                    value, hit = (np.concatenate(a) for a in zip(*scores))
                    sides = [np.sort(value[hit]), np.sort(value[~hit])]
                    cuts = [np.searchsorted(np.clip((side - low[model]) * wide[model], 0, ranges[model] - 1).astype(int), np.arange(ranges[model] + 1)) for side in sides]
                    for r in np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0)):
                        out.append((model, int(r), *(side[cut[r] : cut[r + 1]].tobytes() for side, cut in zip(sides, cuts))))
                columns = list(zip(*out)) or [[]] * 4
                types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["model", "range", "pos", "neg"])

            kept, size = {}, 0
            for batch in _unpacked(batches):
                x, y_, group_, parts_ = _arrays(batch, p)
                some = group_ == g
                x, y_, parts_ = x[some], y_[some], parts_[some]
                for model, repeat, held in own:
                    at = np.flatnonzero(parts_[:, repeat] == held)
                    if len(at):
                        # column by column, so that equal rows have equal scores wherever they stand
                        score = sum((x[at, j] * coef[model, j] for j in range(p)), np.full(len(at), coef[model, p]))
                        kept.setdefault(model, []).append((score, y_[at] == 1))
                        size += len(at)
                if size >= SENT_SCORES:
                    yield ranged(kept)
                    kept, size = {}, 0
            yield ranged(kept)

        def inside(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            pos, neg = _doubles(table.column("pos")), _doubles(table.column("neg"))
            won = (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2
            return pa.table({"model": [key[0].as_py()], "range": [key[1].as_py()], "won": [float(won)], "pos": [len(pos)], "neg": [len(neg)]}, pa.schema([("model", pa.int32()), ("range", pa.int32()), ("won", pa.float64()), ("pos", pa.int64()), ("neg", pa.int64())]))

        sent = rows.select(*_columns(rows, fitted.features, y, group, parts)).mapInArrow(send, "model int, range int, pos binary, neg binary")
        per = sent.groupBy("model", "range").applyInArrow(inside, "model int, range int, won double, pos bigint, neg bigint")
        before = F.sum("neg").over(W.partitionBy("model").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
        per = per.withColumn("before", F.coalesce(before, F.lit(0)))
        sums = per.groupBy("model").agg(F.sum(F.col("won") + F.col("pos").cast("double") * F.col("before")).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        found |= {r.model: r.auc for r in sums.select("model", ratio(F.col("won"), F.col("pos") * F.col("neg")).alias("auc")).where("auc is not null").collect()}  # a row per model
    return found


def predictability(rows: DataFrame, features: list[str], group: str, groups: list[int], repeats: int = 10, k: int = 5, c: float = 0.1, least: int = 8) -> DataFrame:
    """(group, n, n_err, auc, auc_sd): repeated stratified cross validation of a logistic regression on y, all repeats and folds in one fit.

    rows need parts (the fold of each repeat); y and group may be arrays, see ``_arrays``. They are read once and kept packed. Groups with fewer than ``least`` rows of a
    class get no AUC; folds without both classes are left out.
    """
    rows = stored(packed(rows, features, group))
    # models of all rows of a group are near those of its parts, whose steps begin there
    whole = logistic_fits(rows, features, [Fit(g, -1, 0, 1 / c, False) for g in groups], group)
    fits = [Fit(g, held, r, 1 / c, False) for g in groups for r in range(repeats) for held in range(k)]
    fitted = logistic_fits(rows, features, fits, group, start=np.repeat(whole.coef, repeats * k, 0))
    told = [(fits[model].group, value) for model, value in held_auc(rows, fitted, group).items()]
    found = rows.sparkSession.createDataFrame(told, f"{group} int, auc double")
    counts = [(g, int(n), int(pos)) for g, (n, pos) in zip(groups, whole.rows) if n]
    counts = rows.sparkSession.createDataFrame(counts, f"{group} int, n long, n_err long")
    found = found.groupBy(group).agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("auc_sd"))
    enough = (F.col("n_err") >= least) & (F.col("n") - F.col("n_err") >= least)
    out = counts.join(found, group, "left")
    return out.select(group, "n", "n_err", *(F.when(enough, F.col(x)).alias(x) for x in ("auc", "auc_sd")))
