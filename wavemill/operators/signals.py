"""Signal conditioning and windowing over long tables (record_id, channel, i, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def channel_select(channels: DataFrame, priority: list[str], pulses: list[str]) -> DataFrame:
    """Per record: primary and second lead by priority (then any other channel that is no pulse, by name) and the first pulse present."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.upper("channel")).cast("int"), F.lit(0))
    pulse = F.upper("channel").isin(*pulses)
    order = W.partitionBy("record_id").orderBy(F.when(rank > 0, rank).otherwise(1000), "channel")
    leads = channels.where(~pulse).select("record_id", "channel").distinct().withColumn("lead", F.row_number().over(order)).where("lead <= 2")
    found = leads.groupBy("record_id").agg(F.max(F.when(F.col("lead") == 1, F.col("channel"))).alias("primary"), F.max(F.when(F.col("lead") == 2, F.col("channel"))).alias("second"))
    pr = F.array_position(F.array(*map(F.lit, pulses)), F.upper("channel"))
    first_pulse = channels.where(pulse).groupBy("record_id").agg(F.min_by("channel", pr).alias("pulse"))
    return found.join(first_pulse, "record_id", "full")


def lead_signature(channels: DataFrame, pulses: list[str]) -> DataFrame:
    """Pipe-joined sorted names of the channels that are no pulse."""
    return channels.where(~F.upper("channel").isin(*pulses)).groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("channel")), "|").alias("signature"))


def fill_zero(x: Column) -> Column:
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def interpolate_gaps(rows: DataFrame, by: list[str], order: str = "i", value: str = "x") -> DataFrame:
    """NULL runs become straight lines; at the edges the nearest value holds."""
    w = W.partitionBy(*by).orderBy(order)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    rows = rows.withColumns({"_p": F.last(value, True).over(back), "_n": F.first(value, True).over(ahead), "_pi": F.last(at, True).over(back), "_ni": F.first(at, True).over(ahead)})
    line = F.col("_p") + (F.col("_n") - F.col("_p")) * (F.col(order) - F.col("_pi")) / F.nullif(F.col("_ni") - F.col("_pi"), F.lit(0))
    return rows.withColumn(value, F.coalesce(F.col(value), line, F.col("_p"), F.col("_n"))).drop("_p", "_n", "_pi", "_ni")


def window_end_at_trigger(rows: DataFrame, triggers: DataFrame, by: list[str], length: int, post: int = 0) -> DataFrame:
    """Samples [trigger - length, trigger + post); windows that leave the recording are dropped whole. k counts from 0."""
    cut = rows.join(triggers, by).where((F.col("i") >= F.col("trigger") - length) & (F.col("i") < F.col("trigger") + post))
    n = F.count("*").over(W.partitionBy(*by, "trigger"))
    return cut.withColumn("_n", n).where(F.col("_n") == length + post).drop("_n").withColumn("k", F.col("i") - (F.col("trigger") - length))


def window_tumbling(rows: DataFrame, by: list[str], length: int) -> DataFrame:
    """Non-overlapping windows; the incomplete tail is dropped."""
    rows = rows.withColumn("win", F.floor(F.col("i") / length))
    return rows.withColumn("_n", F.count("*").over(W.partitionBy(*by, "win"))).where(F.col("_n") == length).drop("_n")


def window_pick_even(windows: DataFrame, by: list[str], most: int) -> DataFrame:
    """At most ``most`` evenly spaced windows per group: positions floor(k * (n - 1) / (most - 1))."""
    order = W.partitionBy(*by).orderBy("win")
    numbered = windows.select(*by, "win").distinct().withColumn("pos", F.row_number().over(order) - 1)
    n = numbered.groupBy(*by).agg(F.count("*").alias("n"))
    picks = n.select(*by, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * (F.col("n") - 1) / F.lit(float(max(most - 1, 1))))))).alias("pos"))
    return numbered.join(picks, [*by, "pos"], "left_semi").drop("pos")


def resample_linear(rows: DataFrame, by: list[str], up: int, down: int) -> DataFrame:
    """x on a grid of n * up / down points; between two samples by a straight line."""
    n = rows.groupBy(*by).agg((F.max("i") + 1).alias("n"))
    grid = n.select(*by, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") * up - 1) / down))).alias("k"))
    grid = grid.withColumn("pos", F.least(F.col("k") * down / F.lit(float(up)), (F.col("n") - 1).cast("double"))).withColumn("i", F.floor("pos"))
    nxt = F.lead("x").over(W.partitionBy(*by).orderBy("i"))
    pairs = rows.select(*by, "i", "x", nxt.alias("x2"))
    share = F.col("pos") - F.col("i")
    return grid.join(pairs, [*by, "i"]).select(*by, "k", (F.col("x") + F.when(share > 0, (F.col("x2") - F.col("x")) * share).otherwise(F.lit(0.0))).alias("x"))


def decimate(rows: DataFrame, by: list[str], k: int, mean: bool = False) -> DataFrame:
    if not mean:
        return rows.where(F.col("i") % k == 0).withColumn("i", F.floor(F.col("i") / k))
    return rows.groupBy(*by, F.floor(F.col("i") / k).alias("i")).agg(F.avg("x").alias("x"))


def z_normalize(rows: DataFrame, by: list[str]) -> DataFrame:
    w = W.partitionBy(*by)
    return rows.withColumn("x", (F.col("x") - F.avg("x").over(w)) / (F.stddev_pop("x").over(w) + F.lit(1e-8)))


def flatline_fraction(rows: DataFrame, by: list[str], block: int = 25) -> DataFrame:
    """Share of complete blocks whose deviation is below a thousandth of the window's."""
    rows = rows.withColumn("_s", F.stddev_pop("x").over(W.partitionBy(*by)))
    blocks = rows.groupBy(*by, F.floor(F.col("i") / block).alias("_b")).agg(F.stddev_pop("x").alias("_d"), F.max("_s").alias("_s"), F.count("*").alias("_n")).where(F.col("_n") == block)
    return blocks.groupBy(*by).agg(F.avg((F.col("_d") < F.lit(1e-3) * (F.col("_s") + F.lit(1e-8))).cast("double")).alias("flat"))


def clip_fraction(rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of samples within a thousandth of the span of the window's own extremes; 1 without a span."""
    w = W.partitionBy(*by)
    rows = rows.withColumn("_lo", F.min("x").over(w)).withColumn("_hi", F.max("x").over(w))
    span = F.col("_hi") - F.col("_lo")
    hit = (F.col("x") <= F.col("_lo") + 0.001 * span) | (F.col("x") >= F.col("_hi") - 0.001 * span)
    return rows.groupBy(*by).agg(F.when(F.max(span) < 1e-8, F.lit(1.0)).otherwise(F.avg(hit.cast("double"))).alias("clip"))


def quality_score(flat: Column, clip: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - 0.5 * F.least(flat / F.lit(0.01), F.lit(1.0)) - 0.5 * F.least(clip / F.lit(0.2), F.lit(1.0)))


def signal_quality(rows: DataFrame, by: list[str], block: int = 25) -> DataFrame:
    both = flatline_fraction(rows, by, block).join(clip_fraction(rows, by), by)
    return both.withColumn("quality", quality_score(F.col("flat"), F.col("clip")))


def cohort_build(qualities: DataFrame, least: float = 0.05) -> DataFrame:
    """(record_id, ecg, ppg, abp qualities) -> source of the pulse, quality, or the reason of exclusion."""
    with_ppg, with_abp = F.least("ecg", "ppg"), F.least("ecg", "abp")
    source = F.when(F.col("ecg").isNull(), None).when(F.col("ppg").isNotNull() & (with_ppg >= least), "ppg").when(F.col("abp").isNotNull() & (with_abp >= least), "abp")
    reason = F.when(F.col("ecg").isNull(), "no ecg").when(source.isNotNull(), "kept").when(F.col("ppg").isNull() & F.col("abp").isNull(), "no pulse").otherwise("low quality")
    return qualities.select("record_id", source.alias("pulse_source"), reason.alias("reason"), F.when(source == "ppg", with_ppg).when(source == "abp", with_abp).alias("quality"))
