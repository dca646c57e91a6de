"""Joins, set operations and picks that evaluation tables are put together with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.ranking import ranked


def select_where(rows: DataFrame, **conditions) -> DataFrame:
    """Rows where each column equals a value or is in a list."""
    return rows.where(reduce(lambda a, b: a & b, (F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in conditions.items()), F.lit(True)))


def holdout_by_signature(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Leave one device out: its rows are the test."""
    return rows.withColumn("role", F.when(F.col(column) == value, "test").otherwise("train"))


def pair_join(metrics: DataFrame, arm: str, a: str, b: str, on: list[str], value: str) -> DataFrame:
    left, right = (metrics.where(F.col(arm) == v).select(*on, F.col(value).alias(n)) for v, n in ((a, "a"), (b, "b")))
    return left.join(right, on).withColumn("diff", F.col("b") - F.col("a"))


def common_keys(rows: DataFrame, key: str, arm: str) -> DataFrame:
    """Keys that every arm has."""
    arms = rows.agg(F.countDistinct(arm).alias("_arms"))
    return rows.groupBy(key).agg(F.countDistinct(arm).alias("n")).join(F.broadcast(arms)).where("n = _arms").select(key)


def split_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has; empty when both agree."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not in new, and all of new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def condition_cross(rows: DataFrame, conditions: DataFrame, draws: int) -> DataFrame:
    """Every row under every condition and draw; the conditions are a small fixed table."""
    return rows.crossJoin(F.broadcast(conditions)).withColumn("draw", F.explode(F.when(F.col("stochastic"), F.sequence(F.lit(0), F.lit(draws - 1))).otherwise(F.array(F.lit(0)))))


def donor_swap(rows: DataFrame, key: str, record: str, label: str, alarm: str, seed: str = "swap") -> DataFrame:
    """(key, donor): a row of another record with the same label and alarm type, else with the same label; NULL without one.

    The records of a pool are put in MD5 order, each takes the next record, the last the first; a record lends its rows in
    turn. Only records are ordered, no pool is joined with itself but place by place.
    """

    def next_in(pool: list[str], name: str) -> DataFrame:
        own = W.partitionBy(*pool, record)
        numbered = rows.select(*pool, record, key, (F.row_number().over(own.orderBy(key)) - 1).alias("_k"), F.count("*").over(own).alias("_n"))
        records = numbered.groupBy(*pool, record).agg(F.max("_n").alias("_n"))
        # places come from counts of ranges: a pool of very many records is ordered by many tasks
        records = ranked(records, pool, draw(F.lit(seed), F.col(record)), [record], 0.0, float(1 << 32), "_place")
        sizes = records.groupBy(*pool).agg(F.count("*").alias("_size"))
        records = records.join(sizes, pool).withColumn("_after", F.col("_place") % F.col("_size") + 1)
        others = records.select(*pool, F.col("_place").alias("_after"), F.struct(record, "_n").alias("_next"))
        records = records.join(others, [*pool, "_after"]).select(*pool, record, "_next").where(F.col("_next")[record] != F.col(record))
        wants = numbered.drop("_n").join(records, [*pool, record]).select(*pool, key, F.col(f"_next.{record}").alias(record), (F.col("_k") % F.col("_next._n")).alias("_k"))
        lends = numbered.select(*pool, record, F.col(key).alias(name), "_k")
        return rows.select(key).join(wants.join(lends, [*pool, record, "_k"]).select(key, name), key, "left")

    same = next_in([label, alarm], "d1").join(next_in([label], "d2"), key)
    return same.select(key, F.coalesce("d1", "d2").alias("donor"))


def union_runs(*runs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def pivot_means(rows: DataFrame, by: list[str], column: str, values: list, value: str) -> DataFrame:
    return rows.groupBy(*by).pivot(column, values).agg(F.avg(value))


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def round_robin_pick(rows: DataFrame, groups: list[str], record: str, key: str, n: int) -> DataFrame:
    """n rows, one per record, taken from the groups in turn."""
    one = top_per_group(rows, [record], [F.col(key)], 1)
    ranked = one.withColumn("turn", F.row_number().over(W.partitionBy(*groups).orderBy(record))).where(F.col("turn") <= n)
    return ranked.orderBy("turn", *groups).limit(n)
