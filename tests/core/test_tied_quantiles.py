"""A quantile between two equal values is that value, to the last bit."""

from pyspark.sql import functions as F

from wavemill.functions.quantiles import exact_quantiles


def test_ties_are_not_interpolated(spark):
    rows = spark.range(1, 200).select(F.round(F.lit(0.8) + F.col("id") / 997, 9).alias("v"), F.explode(F.array(F.lit(1), F.lit(2))))
    found = exact_quantiles(rows.withColumn("n", F.col("v")), ["v"], [0.9, 1 / 3], ["n"]).collect()
    assert len(found) == 199
    assert [r.n for r in found if set(r.q_v) != {r.n}] == []
