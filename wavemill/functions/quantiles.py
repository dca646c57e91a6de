"""Exact quantiles of whole columns: ranges are counted, only those that hold a wanted rank are looked into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Rows of a range that are put in order by one task; larger ranges are cut again.
RANGE_ROWS = 1_000_000
#: Cuts of one range in a round.
CUTS = 255


def exact_quantiles(rows: DataFrame, values: list[str], probs: list[float], by: list[str] | None = None, range_rows: int = RANGE_ROWS, cuts: int = CUTS) -> DataFrame:
    """(by, q_<value>: array in the order of probs), linearly interpolated between ranks; null and NaN are left out.

    A round cuts each open range at values of a bounded sketch and counts what lies between and at them, in one aggregation
    with partial sums. Counts are exact, so the ranges that hold the wanted ranks are known exactly; a value that very many
    rows share is a range of its own. Rounds grow with the logarithm of the rows. A group without any value has no row.
    """
    by = by or []
    told = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in values))).alias("told")
    long = rows.select(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), F.lit(0).alias("one")).alias("at"), told)
    long = stored(long.select("at", "told.name", "told.v").where("v is not null and not isnan(v)"))
    whole = stored(long.groupBy("at", "name").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).withColumn("before", F.lit(0).cast("long")))
    wanted = whole.select("at", "name", F.posexplode(F.array(*(F.lit(p) * (F.col("n") - 1) for p in probs))).alias("nr", "place"))
    wanted = wanted.select("at", "name", "nr", (F.col("place") - F.floor("place")).alias("share"), F.floor("place").alias("under"), F.ceil("place").alias("over"))
    ranks = stored(wanted.select("at", "name", F.explode(F.array("under", "over")).alias("rank")).distinct())
    renamed = lambda t, cols: t.select(F.col("at").alias("at_"), F.col("name").alias("name_"), *cols)

    def holding(ranges: DataFrame) -> DataFrame:
        """The ranges in which a wanted rank lies."""
        right = renamed(ranks, ["rank"])
        return ranges.join(right, (F.col("at") == F.col("at_")) & (F.col("name") == F.col("name_")) & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")), "left_semi")

    def inside(open_: DataFrame) -> DataFrame:
        """The values of open ranges, each with its range's low end and the rows before it."""
        right = renamed(open_, ["low", "high", "before"])
        return long.join(right, (F.col("at") == F.col("at_")) & (F.col("name") == F.col("name_")) & F.col("v").between(F.col("low"), F.col("high"))).select("at", "name", "v", "low", "before")

    one_value = whole.limit(0)
    open_ = whole
    while True:
        one_value = one_value.unionByName(open_.where("low = high"))
        open_ = open_.where("low < high")
        most = open_.agg(F.max("n")).first()[0]
        if most is None or most <= range_rows:
            break
        held = inside(open_)
        sketch = held.groupBy("at", "name", "low").agg(F.percentile_approx("v", [k / (cuts + 1) for k in range(1, cuts + 1)], 10 * cuts).alias("cuts"))
        sketch = renamed(sketch, [F.col("low").alias("low_"), F.array_distinct("cuts").alias("cuts")])
        held = held.join(sketch, (F.col("at") == F.col("at_")) & (F.col("name") == F.col("name_")) & (F.col("low") == F.col("low_")))
        # between two cuts an even number, at a cut the odd one after it
        part = 2 * F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int")
        counted = held.groupBy("at", "name", F.col("low").alias("range"), "before", part.alias("part")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
        under = F.sum("n").over(W.partitionBy("at", "name", "range").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
        open_ = stored(holding(counted.select("at", "name", "low", "high", "n", (F.col("before") + under).alias("before"))))
    distinct = inside(open_).groupBy("at", "name", "low", "before", "v").agg(F.count("*").alias("n"))
    under = F.sum("n").over(W.partitionBy("at", "name", "low").orderBy("v").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    found = distinct.select("at", "name", "v", (F.col("before") + under).alias("before"), "n").unionByName(one_value.select("at", "name", F.col("low").alias("v"), "before", "n"))
    found = renamed(found, ["v", "before", "n"])
    known = ranks.join(found, (F.col("at") == F.col("at_")) & (F.col("name") == F.col("name_")) & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select("at", "name", "rank", "v")
    known = stored(known)  # one row per wanted rank
    pick = lambda rank, v: known.select("at", "name", F.col("rank").alias(rank), F.col("v").alias(v))
    out = wanted.join(pick("under", "a"), ["at", "name", "under"]).join(pick("over", "b"), ["at", "name", "over"])
    # between equal values nothing is interpolated: the two products of one value need not add up to it
    value = F.when((F.col("share") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise((1 - F.col("share")) * F.col("a") + F.col("share") * F.col("b"))
    out = out.groupBy("at", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("nr", value.alias("q")))), lambda s: s["q"]).alias("q"))
    out = out.groupBy("at").agg(*(F.first(F.when(F.col("name") == c, F.col("q")), ignorenulls=True).alias(f"q_{c}") for c in values))
    return out.select(*(F.col(f"at.k{i}").alias(c) for i, c in enumerate(by)), *(f"q_{c}" for c in values))
