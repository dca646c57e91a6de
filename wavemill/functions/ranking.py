"""Row numbers without an ordered pass through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges into which the first sort key is cut.
RANGES = 4096
#: Rows that a task gets on average at most; only tables beyond this times the shuffle partitions are dealt by it.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, by: list[str], total: int | None) -> DataFrame:
    """rows, equal ``by`` in one task; total is about how many they are, and the tasks of a large table grow in number with it."""
    parts = -(-(total or 0) // TASK_ROWS)
    return rows.repartition(parts, *by) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*by)


def part_of(value: Column, low: Column | float, high: Column | float) -> Column:
    """The range, from 0, of a value in [low, high]."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    part = F.floor((value - low) * F.lit(RANGES) / F.greatest(high - low, F.lit(1e-300)))
    return F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), part)).cast("int")


def ranked(rows: DataFrame, by: list[str], value: Column, ties: list[str], low: Column | float, high: Column | float, name: str, total: int | None = None) -> DataFrame:
    """rows with their number, from 1, in the order of value and ties within each ``by``; value lies in [low, high].

    The values' span is cut into RANGES equal parts. Rows of one part and one ``by`` are sorted together; the numbers before
    them come from the parts' counts, RANGES rows for each ``by``. Rows and counts meet by one key, which null values of
    ``by`` do not break, so the rows are moved and sorted once. total: how many rows there are, if known.
    """
    rows = rows.withColumn("_value", value).withColumn("_part", part_of(F.col("_value"), low, high))
    counts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.struct(*by, "_part").alias("_of"), before.alias("_before"))
    rows = dealt(rows.withColumn("_at", F.struct(*by, "_part")), ["_at"], total)
    inside = F.row_number().over(W.partitionBy("_at").orderBy("_value", *ties))
    rows = rows.withColumn("_inside", inside).join(counts, F.col("_at") == F.col("_of"))
    return rows.withColumn(name, F.col("_before") + F.col("_inside")).drop("_value", "_part", "_at", "_of", "_before", "_inside")
