"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, DataFrame functions only.

The ring has ``cells`` places. A shard stands at ``vnodes`` of them, a row at one, both drawn by MD5. A row belongs to the
first shard clockwise. A shard takes rows up to its load bound, in an order that does not depend on the shards; what
overflows continues clockwise to the next shard that is not full, until nothing is left. Without slack the bounds add up to
the number of rows and differ by at most one, so every shard ends with its bound exactly (law ``rows``); with slack
shards may end below it and fewer rows move when shards come or go.

Scale: rows move once, as (id, size, crc32), to be numbered within their cell. The ring itself works on counts per cell,
at most ``cells`` rows, however many rows there are: whole cells change hands, and of the one cell where a bound ends
the first rows by number. The resulting pieces (at most ``cells`` and one per shard and round) are joined to the rows.

Edge cases: null text counts as empty, null ids are a value. Rows that are alike in id, size and crc32 are numbered as
copies, in each part of the input alone and then by the parts' sums, so a third of all rows may be one row; copies stand at
places of their own. An empty table gives an empty result. Very long texts are measured in whole. Only the id and text are
used besides ``keep``; kept columns may not be named like an output column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Places of the ring: bounds the tables of the ring and the rows that are numbered together (a 65,536th of all).
CELLS = 1 << 16
#: Places of one shard.
VNODES = 256
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
OUTPUTS = ("size", "text_crc32", "shard", "slot")


def _drawn(said: Column) -> tuple[Column, Column]:
    """(32 bits, the rest) of the digest of a string."""
    digest = F.md5(said)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.substring(digest, 9, 24)


def load_bounds(rows: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard may hold."""
    if slack:
        return [max(-(-rows // shards), int((1 + slack) * rows / shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _copies(rows: DataFrame, kept: list[str]) -> DataFrame:
    """Adds ``copy``: 0, or a number among the rows that are alike in id, size and crc32."""
    alike = ["id", "size", "text_crc32"]
    several = rows.groupBy(*alike).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    several = materialize(several.toDF("id_", "size_", "crc_"))
    if several.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("size") == F.col("size_")) & (F.col("text_crc32") == F.col("crc_"))
    lone = rows.join(several, same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    more = rows.join(several, same, "left_semi")
    parts = more.groupBy(*alike, "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*alike).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("id").alias("id_"), F.col("size").alias("size_"), F.col("text_crc32").alias("crc_"), F.col("part").alias("part_"), before.alias("before"))
    order = F.xxhash64(*kept) if kept else F.lit(0)
    more = more.withColumn("number", F.row_number().over(W.partitionBy(*alike, "part").orderBy(order)))
    more = more.join(parts, same & (F.col("part") == F.col("part_"))).withColumn("copy", F.col("before") + F.col("number") - 1)
    return lone.unionByName(more.select(*lone.columns))


def _ring(spark: SparkSession, shards: int, vnodes: int, cells: int, seed: int) -> DataFrame:
    """(at, owner): the cells at which shards stand."""
    nodes = spark.range(0, shards * vnodes, 1, 1).select((F.col("id") % shards).cast("int").alias("owner"), F.floor(F.col("id") / shards).alias("v"))
    place, _ = _drawn(F.concat_ws(":", F.lit(f"shard{seed}"), "owner", "v"))
    return nodes.select((place % cells).alias("at"), "owner")


def _pieces(counts: DataFrame, shards: int, vnodes: int, cells: int, slack: float, seed: int) -> DataFrame:
    """(cell, lo, hi, shard) from (cell, n): rows lo + 1 .. hi of the cell go to the shard. Tables of at most ``cells`` rows."""
    spark = counts.sparkSession
    ring = materialize(_ring(spark, shards, vnodes, cells, seed))
    left = materialize(counts.coalesce(1).select("cell", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"), F.md5(F.concat(F.lit("cell"), F.col("cell").cast("string"))).alias("turn")))
    waiting = left.agg(F.coalesce(F.sum("hi"), F.lit(0))).first()[0]
    room = load_bounds(waiting, shards, slack)
    done: list[DataFrame] = []
    onward = W.partitionBy().orderBy(F.desc("at"), F.desc("is_node")).rowsBetween(W.unboundedPreceding, 0)
    queue = W.partitionBy("owner").orderBy("turn", "lo").rowsBetween(W.unboundedPreceding, -1)
    while waiting:
        # the first open shard at or after each cell; after the last one comes the first
        nodes = ring.where(F.col("owner").isin([s for s, r in enumerate(room) if r])).groupBy("at").agg(F.min("owner").alias("owner"))
        first = nodes.orderBy("at").limit(1).select((F.col("at") + cells).alias("at"), "owner")
        nodes = nodes.unionByName(first).withColumn("is_node", F.lit(True))
        both = nodes.unionByName(left.withColumn("at", F.col("cell")).withColumn("is_node", F.lit(False)), allowMissingColumns=True)
        asked = both.withColumn("owner", F.last("owner", ignorenulls=True).over(onward)).where("not is_node")
        free = F.element_at(F.array(*(F.lit(r).cast("long") for r in room)), F.col("owner") + 1)
        before = F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(queue), F.lit(0))
        taken = F.greatest(F.lit(0), F.least(F.col("hi") - F.col("lo"), free - before))
        step = materialize(asked.select("cell", "lo", "hi", "turn", "owner", taken.alias("taken")))
        for s, n in step.groupBy("owner").agg(F.sum("taken")).collect():  # one row per shard
            room[s] -= n
            waiting -= n
        done.append(step.where("taken > 0").select("cell", "lo", (F.col("lo") + F.col("taken")).alias("hi"), F.col("owner").alias("shard")))
        left = step.where("lo + taken < hi").select("cell", (F.col("lo") + F.col("taken")).alias("lo"), "hi", "turn")
    out = counts.limit(0).select("cell", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).alias("shard"))
    for part in done:
        out = out.unionByName(part)
    return out


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), slack: float = 0.0, vnodes: int = VNODES, cells: int = CELLS, seed: int = 1) -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes of the text and ROW_BYTES), text_crc32, shard, slot (gapless from 0), and the columns of ``keep``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    names = [f"kept{k}" for k in range(len(keep))]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), *(F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)), F.spark_partition_id().alias("part"))
    rows = materialize(rows)
    said = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), "size", "text_crc32", "copy")
    place, rest = _drawn(said)
    rows = _copies(rows, names).withColumn("cell", place % cells).withColumn("rest", rest)
    number = F.row_number().over(W.partitionBy("cell").orderBy("rest", F.col("id").asc_nulls_first(), "size", "text_crc32", "copy"))
    rows = materialize(rows.withColumn("number", number.cast("long")).drop("rest", "copy", "part"))
    counts = materialize(rows.groupBy("cell").agg(F.max("number").alias("n")))
    pieces = materialize(_pieces(counts, shards, vnodes, cells, slack, seed))
    first = F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(W.partitionBy("shard").orderBy("cell", "lo").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = F.broadcast(pieces.withColumn("first", first))  # at most ``cells`` rows and one per shard and round
    rows = rows.join(pieces, (rows["cell"] == pieces["cell"]) & (F.col("number") > F.col("lo")) & (F.col("number") <= F.col("hi")))
    slot = (F.col("first") + F.col("number") - F.col("lo") - 1).alias("slot")
    return rows.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", slot, *(F.col(k).alias(c) for c, k in zip(keep, names)))


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 100_000, **ring) -> None:
    """docs as Parquet below ``path``/shard=K, in order of slot, at most ``rows_per_file`` rows a file."""
    others = tuple(c for c in docs.columns if c != id_col and c not in OUTPUTS)
    out = assign_shards(docs, shards, id_col, text_col, others, **ring)
    files = F.floor(F.col("slot") / rows_per_file)
    out = out.repartition("shard", files).sortWithinPartitions("shard", "slot")
    out.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
