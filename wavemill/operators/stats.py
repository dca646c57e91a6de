"""Statistics over evaluation tables: resampling, multiple testing, exact tests, subset values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.hashing import uniforms as _uniforms


def corrected_t(diffs: DataFrame, by: list[str], value: str, test_over_train: float) -> DataFrame:
    """Corrected resampled t: mean / sqrt((1/J + n_test/n_train) * sample variance); NULL without variance."""
    rows = diffs.groupBy(*by).agg(F.count(value).alias("j"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    return rows.select(*by, "j", "mean", F.when(F.col("var") > 1e-18, F.col("mean") / F.sqrt((F.lit(1.0) / F.col("j") + F.lit(test_over_train)) * F.col("var"))).alias("t"))


def holm(pvalues: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    """Step-down adjusted p: running maximum of (m - rank) * p, at most 1. A missing p counts as 1."""
    q = F.coalesce(F.col(p), F.lit(1.0))
    order = W.partitionBy(*by).orderBy(q, tie)
    rows = pvalues.withColumn("_s", (F.count("*").over(W.partitionBy(*by)) - F.row_number().over(order) + 1) * q)
    return rows.withColumn("holm", F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(W.unboundedPreceding, 0)))).drop("_s")


# The distribution function of Poisson(1) up to 7.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253)
#: Units whose weights a task holds at a time.
UNIT_ROWS = 512
#: Rows of a matrix product: groups times counts.
GROUP_ROWS = 256


# thresholds as whole numbers, and the weight by the upper 16 bits of a number; _MIXED where a threshold lies among them
_LIMITS = np.array([math.ceil(c * (1 << 32)) for c in POISSON])
_MIXED = 255
_BY_UPPER = np.searchsorted(_LIMITS, np.arange(1 << 16) << 16, "right").astype(np.uint8)
_BY_UPPER[_LIMITS >> 16] = _MIXED


def poisson_weights(units: list[str], draws: int, seed: str = "boot") -> np.ndarray:
    """(units x draws) independent Poisson(1) weights: each MD5 of "seed:number:unit" gives four uniforms of 32 bits."""
    u = _uniforms(units, 0, draws, seed)
    out = _BY_UPPER.take(u >> np.uint32(16))
    mixed = np.nonzero(out == _MIXED)
    out[mixed] = np.searchsorted(_LIMITS, u[mixed], "right")
    return out


COUNTS = ("tp", "fp", "tn", "fn")


def replicate_sums(tallies: DataFrame, unit: str, groups: list[str], draws: int, seed: str = "boot") -> DataFrame:
    """(groups, b, tp, fp, tn, fn): the counts of every group in every bootstrap replicate of the units.

    A unit brings all its rows with one weight per replicate, so groups are paired. Its weights are one vector; a task adds
    counts x weights as a matrix product, whose size is groups x replicates whatever the number of units, and sends that alone.
    """
    said = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in groups))
    rows = tallies.select(F.col(unit).cast("string").alias("unit"), said.alias("g"), *(F.col(c).cast("double") for c in COUNTS))
    # dealt by the number of shuffle partitions: the rows are few, the work on each is not, so parts are not to be joined
    parts = int(tallies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.repartition(parts, "unit").groupBy("unit").agg(F.collect_list(F.struct("g", *COUNTS)).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for first in range(0, len(batch), UNIT_ROWS):
                part = batch.slice(first, UNIT_ROWS)
                weights = poisson_weights(part.column(0).to_pylist(), draws, seed)
                items = part.column(1)
                offsets = items.offsets.to_numpy()
                flat = items.values.slice(offsets[0], offsets[-1] - offsets[0])
                owner = np.repeat(np.arange(len(part)), np.diff(offsets))
                names = flat.field("g").dictionary_encode()
                code, counts = names.indices.to_numpy(), [flat.field(c).to_numpy() for c in COUNTS]
                # single precision is exact as long as no sum of a block can pass 2^24
                most = max(float(np.abs(c).max(initial=0.0)) for c in counts) * len(flat) * len(POISSON)
                weights = weights.astype(np.float32 if most < 1 << 24 else float)
                many = max(1, GROUP_ROWS // len(COUNTS))
                known = names.dictionary.to_pylist()
                for start in range(0, len(known), many):
                    own = (code >= start) & (code < start + many)
                    place = (code[own] - start) * len(part) + owner[own]
                    here = min(many, len(known) - start)
                    table = np.stack([np.bincount(place, c[own], here * len(part)).reshape(here, -1) for c in counts], 1)
                    found = (table.reshape(-1, len(part)).astype(weights.dtype) @ weights).astype(float).reshape(here, len(COUNTS), -1)
                    for name, more in zip(known[start : start + here], found):
                        sums[name] = sums[name] + more if name in sums else more
        for name, found in sums.items():
            yield pa.record_batch([pa.array([name] * draws), pa.array(range(draws), pa.int32()), *map(pa.array, found)], ["g", "b", *COUNTS])

    per = packed.mapInArrow(run, "g string, b int, tp double, fp double, tn double, fn double").groupBy("g", "b").agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS))
    named = tallies.select(*groups).distinct().withColumn("g", said)
    return named.join(per, "g").select(*groups, "b", *COUNTS)


def interval(replicates: DataFrame, by: list[str], value: str) -> DataFrame:
    """95 % interval and two-sided p of a difference."""
    ends = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    rows = replicates.groupBy(*by).agg(F.avg(value).alias("mean"), ends.alias("_e"), F.avg((F.col(value) <= 0).cast("double")).alias("_l"), F.avg((F.col(value) >= 0).cast("double")).alias("_g"))
    return rows.select(*by, "mean", F.col("_e")[0].alias("low"), F.col("_e")[1].alias("high"), F.least(F.lit(1.0), 2 * F.least("_l", "_g")).alias("p"))


def paired_differences(sums: DataFrame, arm: str, pairs: list[tuple[str, str]], by: list[str], metrics: dict[str, Column]) -> DataFrame:
    """(pair, by, b, metric, diff): each metric's difference (second arm less first), per seed, then averaged over seeds."""
    long = sums.select(arm, *by, "seed", "b", *(c.cast("double").alias(k) for k, c in metrics.items())).unpivot([arm, *by, "seed", "b"], list(metrics), "metric", "value")
    per = long.groupBy(arm, *by, "b", "metric").agg(F.avg("value").alias("value"))
    pair = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in pairs))).alias("pair")
    sides = per.select("*", pair).where((F.col(arm) == F.col("pair.x")) | (F.col(arm) == F.col("pair.y")))
    value = lambda side: F.max(F.when(F.col(arm) == F.col(f"pair.{side}"), F.col("value")))
    return sides.groupBy(F.concat_ws("-", "pair.x", "pair.y").alias("pair"), *by, "b", "metric").agg((value("y") - value("x")).alias("diff"))


#: Log likelihoods this far below the likeliest cell's are zero as doubles.
_NEGLIGIBLE = 750.0


def _fisher_p(a: int, b: int, c: int, d: int, step: int = 1 << 16) -> float:
    """Two-sided p of one table: the share of all tables with its margins that are at most as likely.

    Cells are visited in runs from the likeliest one to either side, until they add nothing to a double: some eighty
    deviations, so the cells grow with the square root of the counts.
    """
    r, k, n = a + b, a + c, a + b + c + d
    low, high = max(0, r + k - n), min(r, k)
    mode = min(high, max(low, (r + 1) * (k + 1) // (n + 2)))

    def side(end: int, sign: int) -> np.ndarray:
        """Log likelihoods, relative to the likeliest cell's, of the cells after it."""
        found, at, x = [np.empty(0)], 0.0, mode
        while x != end and at > -_NEGLIGIBLE:
            stop = min(end, x + step) if sign > 0 else max(end, x - step)
            cell = np.arange(x, stop, sign, dtype=float)
            if sign > 0:
                moves = np.log((r - cell) * (k - cell)) - np.log((cell + 1) * (n - r - k + cell + 1))
            else:
                moves = np.log(cell * (n - r - k + cell)) - np.log((r - cell + 1) * (k - cell + 1))
            found.append(at + np.cumsum(moves))
            at, x = float(found[-1][-1]), stop
        return np.concatenate(found)

    over, under = side(high, 1), side(low, -1)
    near = np.concatenate((under[::-1], [0.0], over))
    place = a - mode + len(under)
    if not 0 <= place < len(near):
        return 0.0
    shares = np.exp(near)
    return min(1.0, float(shares[near <= near[place] + 1e-7].sum() / shares.sum()))


def fisher_exact(tables: DataFrame, key: list[str], a: str = "a", b: str = "b", c: str = "c", d: str = "d") -> DataFrame:
    """Two-sided p and odds ratio of 2 x 2 tables, one row each, in one pass without a shuffle."""

    @F.pandas_udf("double")
    def p(w: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([_fisher_p(*map(int, t)) for t in zip(w, x, y, z)], dtype=float)

    odds = F.when(F.col(b) * F.col(c) > 0, F.col(a) * F.col(d) / (F.col(b) * F.col(c)).cast("double")).alias("odds_ratio")
    return tables.select(*key, odds, p(*(F.col(x).cast("long") for x in (a, b, c, d))).alias("p"))


def shapley(values: DataFrame, players: int, mask: str = "mask", value: str = "v", empty: float = 0.5) -> DataFrame:
    """Shapley value of each player from the value of every non-empty subset (bit mask)."""
    spark = values.sparkSession
    all_ = values.select(F.col(mask).cast("long").alias("mask"), F.col(value).alias("v")).unionByName(spark.createDataFrame([(0, empty)], "mask long, v double"))
    fact = F.element_at(F.array(*(F.lit(float(_factorial(k))) for k in range(players + 1))), F.bit_count("mask") + 1)
    rest = F.element_at(F.array(*(F.lit(float(_factorial(k))) for k in range(players + 1))), F.lit(players) - F.bit_count("mask"))
    base = all_.select("mask", "v", F.explode(F.sequence(F.lit(0), F.lit(players - 1))).alias("player")).where(F.expr("(mask & shiftleft(1L, player)) = 0"))
    base = base.withColumn("bigger", F.expr("mask + shiftleft(1L, player)")).withColumn("w", fact * rest / F.lit(float(_factorial(players))))
    joined = base.join(all_.select(F.col("mask").alias("bigger"), F.col("v").alias("v2")), "bigger")
    return joined.groupBy("player").agg(F.sum(F.col("w") * (F.col("v2") - F.col("v"))).alias("shapley"))


def _factorial(n: int) -> int:
    out = 1
    for k in range(2, n + 1):
        out *= k
    return out


#: Rows that trade places with one another in a permutation, on average.
BLOCK_ROWS = 2048
#: Replicates that a task holds for a block at a time.
DRAW_STEP = 200
#: Bits of a row's place in its block, beside the 32 of its number.
PLACE_BITS = 31


def permutation_test(rows: DataFrame, a: str, b: str, key: str, draws: int, seed: str = "perm", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(rho, p): correlation of a and b, and the share of permutations of b with at least that |correlation|.

    Rows are dealt to blocks by a draw of their key, and b is permuted inside every block. The blocks do not depend on the
    values, so these permutations are a group under which the null hypothesis holds, and the test is exact; up to block_rows
    rows it is the full permutation test. A block is put in order by one task and meets all replicates there; a task sends one
    number per replicate, whatever the number of rows. Rows without a or b are left out, keys are taken as unique. Without
    rows p is null, without variation of a or b rho is as well.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(key).alias("k"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null")
    whole = base.agg(F.count("*").alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), F.covar_pop("a", "b").alias("cov"))
    whole = whole.withColumn("rho", F.col("cov") / F.nullif(F.col("sa") * F.col("sb"), F.lit(0.0)))  # one row
    dealt = base.join(F.broadcast(whole)).select("k", (F.col("a") - F.col("ma")).alias("a"), (F.col("b") - F.col("mb")).alias("b"), (draw(F.lit(seed), F.lit("block"), F.col("k")) % F.ceil(F.col("n") / F.lit(block_rows))).alias("block"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = dealt.repartition(parts, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", F.col("k").cast("string").alias("u"), "a", "b"))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(draws)
        for batch in batches:
            for items in batch.column("items"):
                items = items.values
                units, x, y = items.field("u").to_pylist(), items.field("a").to_numpy(), items.field("b").to_numpy()
                for first in range(0, draws, DRAW_STEP):
                    # number and place in one value: plain sorting orders places, ties by place
                    drawn = _uniforms(units, first, min(DRAW_STEP, draws - first), seed).T.astype(np.uint64) << np.uint64(PLACE_BITS)
                    drawn |= np.arange(len(units), dtype=np.uint64)
                    drawn.sort(axis=1)
                    drawn &= np.uint64((1 << PLACE_BITS) - 1)
                    sums[first : first + DRAW_STEP] += y[drawn.view(np.int64)] @ x
        yield pa.record_batch([pa.array(range(draws), pa.int32()), pa.array(sums)], ["r", "s"])

    null = blocks.mapInArrow(run, "r int, s double").groupBy("r").agg(F.sum("s").alias("s"))
    scale = F.nullif(F.col("n") * F.col("sa") * F.col("sb"), F.lit(0.0))
    far = (F.abs(F.col("s") / scale) >= F.abs("rho") - 1e-12).cast("double")
    return null.join(F.broadcast(whole)).agg(F.max("rho").alias("rho"), F.avg(far).alias("p"))


def auc_replicates(rows: DataFrame, unit: str, groups: list[str], score: str, label: str, draws: int, seed: str = "boot") -> DataFrame:
    """(groups, b, auc): area under the curve of every group in every bootstrap replicate of its rows; null without both classes.

    Rows lie in order of score in ranges, and a row's weights are one vector. A task walks its range in blocks of rows and
    keeps running vectors alone: it sends the weight of both classes and the area inside its range, and the first and last
    score apart, which another range may go on with. One value that very many rows share is thereby split over tasks. What
    is shuffled after that is ranges x replicates. Rows without a score or label are left out.
    """
    spark = rows.sparkSession
    said = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in groups))
    told = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(said.alias("g"), F.col(score).cast("double").alias("v"), F.concat_ws(":", said, F.col(unit).cast("string")).alias("u"), F.col(label).cast("double").alias("y"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = told.repartitionByRange(parts, "g", "v", F.xxhash64("u")).sortWithinPartitions("g", "v", "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(draws)

        def piece(g: str, low: float, edge: bool, pos: np.ndarray, neg: np.ndarray, area: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array([g] * draws), pa.array(range(draws), pa.int32()), pa.array([low] * draws), pa.array([edge] * draws), *map(pa.array, (pos, neg, area))], ["g", "b", "low", "edge", "pos", "neg", "area"])

        group, open_, started, inner = None, None, False, None  # open_: the value that may go on; inner: values between the edges

        def ends() -> Iterator[pa.RecordBatch]:
            if inner is not None:
                yield piece(group, inner[0], False, *inner[1:])
            if open_ is not None:
                yield piece(group, open_[0], True, *open_[1:], none)

        for batch in batches:
            names = batch.column("g").to_pylist()
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for start, stop in ((s, e) for x, y in zip(cuts, cuts[1:]) for s, e in _steps(x, y)):
                if names[start] != group:
                    yield from ends()
                    group, open_, started, inner = names[start], None, False, None
                part = batch.slice(start, stop - start)
                v, y = part.column("v").to_numpy(), part.column("y").to_numpy()
                w = poisson_weights(part.column("u").to_pylist(), draws, seed).astype(float)
                at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                pos, neg = np.add.reduceat(w * y[:, None], at), np.add.reduceat(w * (1 - y)[:, None], at)
                values = v[at]
                if open_ is not None:
                    if open_[0] == values[0]:
                        pos[0] += open_[1]
                        neg[0] += open_[2]
                    else:
                        values, pos, neg = np.r_[open_[0], values], np.vstack([open_[1], pos]), np.vstack([open_[2], neg])
                done = len(values) - 1
                open_ = (float(values[-1]), pos[-1], neg[-1])
                first = 0
                if done and not started:
                    yield piece(group, float(values[0]), True, pos[0], neg[0], none)
                    started, first = True, 1
                if first < done:
                    p, n = pos[first:done], neg[first:done]
                    low, sum_p, sum_n, area = inner or (float(values[first]), none, none, none)
                    under = sum_n + np.cumsum(n, axis=0) - n
                    inner = (low, sum_p + p.sum(0), sum_n + n.sum(0), area + (p * (under + n / 2)).sum(0))
        yield from ends()

    pieces = ranges.mapInArrow(run, "g string, b int, low double, edge boolean, pos double, neg double, area double")
    pieces = pieces.groupBy("g", "b", "low", "edge").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "area")))
    order = W.partitionBy("g", "b").orderBy("low", "edge").rowsBetween(W.unboundedPreceding, 0)
    under = F.sum("neg").over(order) - F.col("neg")
    area = F.col("pos") * under + F.when(F.col("edge"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("area"))
    per = pieces.select("g", "b", "pos", "neg", area.alias("area")).groupBy("g", "b").agg((F.sum("area") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))
    return rows.select(*groups).distinct().withColumn("g", said).join(per, "g").select(*groups, "b", "auc")


def _steps(start: int, stop: int) -> Iterator[tuple[int, int]]:
    return ((k, min(k + UNIT_ROWS, stop)) for k in range(start, stop, UNIT_ROWS))
