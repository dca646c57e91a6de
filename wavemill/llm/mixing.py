"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each row draws one exponential key, divided by its quality weight; rows in key order are a weighted sample without
replacement of any length. A source's target is a number of words: complete epochs come first (every row that often),
the remaining words go to the rows in key order by a prefix sum, and the row where the budget ends gives only its
first words, so a source's taken words equal its target rounded to a word.

Without a weight column a row's quality weight is made of its text: words of a usual length (mean near six bytes), words
of letters without digits, and words that differ from each other weigh more.

Scale: a source may hold a third of all rows. Rows are dealt by sampled ranges of (source, key); ranges are summed first,
and only rows of one range of one source are ever sorted together. Texts move once, for the rows that are taken.

Size: words ``[^\\x20\\x09-\\x0D]+``, null text 0. Sources in code point order, null last, weigh 1, 2, 3, repeating.
Targets stop at ``max_epochs`` times the source's size, the excess is reshared by weight. Rows without words take
nothing. Very long texts are counted in whole. Repeated rows count each. An empty table has no source and gives an empty
result. Draws depend on the seed and the id only, so reruns agree. ``mix`` carries all columns inside one, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small_batches, span_hashes, text_slices, word_bounds

def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row its number of words, their bytes, how many are of letters without digits, and how many differ; the text is the first column."""
    for batch in batches:
        made: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        for i, j, data, offsets in text_slices(batch.column(0)):
            starts, ends, first = word_bounds(data, offsets)
            count = lambda mask: np.concatenate(([0], np.cumsum(mask)))
            held = lambda mask: count(mask)[ends] > count(mask)[starts]
            letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
            plain = held(letter) & ~held((data >= 48) & (data <= 57)) if len(starts) else np.zeros(0, bool)
            owner = np.repeat(np.arange(j - i), np.diff(first))
            h = span_hashes(data, starts, ends)
            order = np.lexsort((h, owner))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            made[0].append(np.diff(first))
            made[1].append(np.diff(count(ends - starts)[first]))
            made[2].append(np.diff(count(plain)[first]))
            made[3].append(np.bincount(owner[order][new], minlength=j - i))
        yield pa.record_batch([*batch.columns[1:], *(pa.array(np.concatenate(x)) for x in made)], [*batch.schema.names[1:], "size", "width", "plain", "differ"])


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, seed: int) -> DataFrame:
    """One row per input row: id, source, digest of the text, size, key (exponential, scaled by the quality weight), bucket.

    Rows are dealt by ranges of (source, key), so a bucket is one stored partition: a source of very many rows, or of very
    unusual weights, is cut by its own keys.
    """
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    wanted = [text.alias("text"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.xxhash64(text).alias("digest")]
    if weight_col:
        wanted.append(F.col(f"`{weight_col}`").cast("double").alias("weight"))
    rows = docs.select(*wanted)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]] + ["size long", "width long", "plain long", "differ long"])
    rows = rows.mapInArrow(_measures, schema)
    words = F.greatest("size", F.lit(1))
    share = lambda c: F.lit(0.1) + F.col(c).cast("double") / words
    # without a given weight: usual word length, words of letters, little repetition
    weight = F.col("weight") if weight_col else F.lit(1.0) / (F.lit(1.0) + F.abs(F.col("width") / words - F.lit(6.0))) * share("plain") * share("differ")
    weight = F.when(weight > 1e-6, F.least(weight, F.lit(1e6))).otherwise(F.lit(1e-6))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))), 1, 13), 16, 10).cast("long")
    uniform = (drawn.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = materialize(rows.select("id", "source", "digest", "size", (-F.log(uniform) / weight).alias("key")))
    # the sampling of ranges reads the narrow rows, not the texts
    return materialize(rows.repartitionByRange("source", "key").withColumn("bucket", F.spark_partition_id()))


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """From (source, source_size), one row per source: adds weight and target. The table has one row per source."""
    everything = W.partitionBy()
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("long")
    rows = sizes.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * max_epochs)
    # the most easily filled sources fill first: each is full if its share, with all before it full, exceeds its cap
    filling = W.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    rows = rows.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("full", (F.col("total") - F.col("cap_before")) * F.col("weight") > F.col("cap") * (F.col("weights") - F.col("weight_before")))
    rows = rows.withColumn("full_caps", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)))
    rows = rows.withColumn("open_weights", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything), F.lit(0)))
    share = ((F.col("total") - F.col("full_caps")) * F.col("weight")).cast("double") / F.col("open_weights").cast("double")
    return rows.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _place(c: str = "source") -> Column:
    """A source as a value that joins, null included."""
    return F.struct(F.col(c).isNull().alias("none"), F.coalesce(c, F.lit("")).alias("name"))


def _plan(rows: DataFrame, max_epochs: int) -> DataFrame:
    """(place, bucket, source_size, target, epochs, rest, before) from sized rows: one row per source and bucket."""
    buckets = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")))
    sizes = buckets.groupBy("source").agg(F.sum("in_bucket").alias("source_size"))
    targets = materialize(source_targets(sizes, max_epochs)).select(_place().alias("place"), "source_size", "target")
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    running = W.partitionBy("place").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("place", _place()).withColumn("before", F.coalesce(F.sum("in_bucket").over(running), F.lit(0)))
    return materialize(buckets.join(targets, "place").select("place", "bucket", "source_size", "target", "epochs", "rest", "before"))


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target, taken to sized rows."""
    joined = rows.withColumn("place", _place()).join(plan, ["place", "bucket"])
    inside = W.partitionBy("place", "bucket").orderBy("key", F.col("id").asc_nulls_first(), "size", "digest").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return joined.withColumn("taken", F.col("epochs") * F.col("size") + part)


def mix_amounts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, seed: int = 17, max_epochs: int = 3) -> DataFrame:
    """One row per input row: id, size, source_size, target (its source's), taken (words the mix takes, repeats counted)."""
    rows = _sized(docs, id_col, text_col, source_col, weight_col, seed)
    return _taken(rows, _plan(rows, max_epochs)).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, seed: int = 17, max_epochs: int = 3) -> DataFrame:
    """The mixed rows with the columns of docs: whole copies, and the boundary row of a source cut to its first words (joined by one space)."""
    rows = _sized(docs, id_col, text_col, source_col, weight_col, seed)
    amounts = _taken(rows, _plan(rows, max_epochs)).where("taken > 0")
    # rows that are alike in id, source and text get their amounts in any order, so they are told apart by a number only
    alike = ["id", "place", "digest"]
    number = F.row_number().over(W.partitionBy(*alike).orderBy(F.desc("taken")))
    amounts = materialize(amounts.select("id", "place", "digest", "size", "taken", number.alias("number")))
    text = F.col(f"`{text_col}`").cast("string")
    whole = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), _place(f"`{source_col}`").alias("place"), F.xxhash64(text).alias("digest"), text.alias("text"))
    doubled = amounts.where("number = 2").select(*alike)
    on = lambda left, right: left["id"].eqNullSafe(right["id"]) & (left["place"] == right["place"]) & (left["digest"] == right["digest"])
    single = amounts.hint("shuffle_hash")
    if doubled.isEmpty():
        out = whole.join(single, on(whole, single)).select("row", "text", "size", "taken")
    else:
        twice = doubled.hint("shuffle_hash")
        once = whole.join(twice, on(whole, twice), "left_anti")
        lone = amounts.join(doubled, on(amounts, doubled), "left_anti").hint("shuffle_hash")
        some = whole.join(twice, on(whole, twice), "left_semi").withColumn("number", F.row_number().over(W.partitionBy(*alike).orderBy(F.lit(0))))
        out = once.join(lone, on(once, lone)).select("row", "text", "size", "taken").unionByName(some.join(amounts, on(some, amounts) & (some["number"] == amounts["number"])).select("row", "text", "size", "taken"))
    copies = F.array_repeat(F.lit(None).cast("string"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, 1, (F.col("taken") % F.col("size")).cast("int")), " ")
    copies = F.when(F.col("taken") % F.col("size") == 0, copies).otherwise(F.concat(copies, F.array(cut)))
    out = out.withColumn("cut", F.explode(copies)).select("row", "cut")
    return out.select(*(F.coalesce("cut", F.col(f"row.`{c}`")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
