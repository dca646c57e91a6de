"""Error taxonomy: which records go wrong again and again, and in which subgroups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles


def wrong_share(prob: Column, y: Column) -> Column:
    """Aggregate: share of rows that are wrong at one half."""
    return F.avg(((prob >= 0.5).cast("int") != y).cast("double"))


def consensus_error(preds: DataFrame, by: list[str]) -> DataFrame:
    """Share of seeds in which a record is wrong at one half, its mean score and label."""
    return preds.groupBy(*by).agg(wrong_share(F.col("prob"), F.col("y")).alias("error"), F.avg("prob").alias("prob"), F.max("y").alias("y"), F.count("*").alias("seeds"))


def error_category(error: Column, y: Column) -> Column:
    return F.when((error >= 0.8) & (y == 1), "persistent_fn").when(error >= 0.8, "persistent_fp").when(error <= 0.2, "stable_correct").otherwise("unstable")


def tercile_levels(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """For every value -> name: low, mid, high by the 1/3 and 2/3 quantiles; ties stay together. All edges come from one pass."""
    edges = exact_quantiles(rows, list(names), [1 / 3, 2 / 3])  # one row
    level = lambda v: F.when(F.col(v) < F.col(f"q_{v}")[0], "low").when(F.col(v) < F.col(f"q_{v}")[1], "mid").when(F.col(v).isNotNull(), "high")
    return rows.join(F.broadcast(edges)).withColumns({name: level(v) for v, name in names.items()}).drop(*(f"q_{v}" for v in names))


def terciles(rows: DataFrame, value: str, name: str) -> DataFrame:
    return tercile_levels(rows, {value: name})


def subgroup_breakdown(rows: DataFrame, factors: list[str], by: list[str]) -> DataFrame:
    """One pass over grouping sets: population, persistent errors, their share and mean error per factor level.

    Rows with the same levels of all factors are summed first, so the sets multiply combinations of levels and not rows.
    """
    alike = rows.groupBy(*by, *factors).agg(F.count("*").alias("n"), F.count_if(F.col("category").startswith("persistent")).alias("persistent"), F.sum(F.col("error").cast("double")).alias("_error"), F.count("error").alias("_told"))
    sets = [[*by, f] for f in factors]
    out = alike.groupingSets(sets, *by, *factors).agg(*(F.sum(c).alias(c) for c in ("n", "persistent", "_error", "_told")), *(F.grouping(f).alias(f"_g_{f}") for f in factors))
    factor = F.coalesce(*(F.when(F.col(f"_g_{f}") == 0, F.lit(f)) for f in factors))
    level = F.coalesce(*(F.when(F.col(f"_g_{f}") == 0, F.coalesce(F.col(f).cast("string"), F.lit("none"))) for f in factors))
    mean = F.when(F.col("_told") > 0, F.col("_error") / F.col("_told")).alias("mean_error")
    return out.select(*by, factor.alias("factor"), level.alias("level"), "n", "persistent", (F.col("persistent") * 100.0 / F.col("n")).alias("percent"), mean)


def rule_annotations(rows: DataFrame, rules: list[tuple[str, Column]], most: int = 3) -> DataFrame:
    """The first few tags whose rule holds, joined by '; '."""
    tags = F.array_compact(F.array(*(F.when(rule, F.lit(tag)) for tag, rule in rules)))
    return rows.withColumn("tags", F.concat_ws("; ", F.slice(tags, 1, most)))


def tag_rates(rows: DataFrame, tags: list[str], by: list[str]) -> DataFrame:
    tag = F.explode(F.array(*map(F.lit, tags))).alias("tag")
    return rows.select(*by, "tags", tag).groupBy(*by, "tag").agg(F.avg(F.col("tags").contains(F.col("tag")).cast("double")).alias("rate"))
