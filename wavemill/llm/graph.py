"""Connected components of a link table: union inside tasks, then minimum labels and pointer jumping across them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Links that one task joins in its memory.
TASK_LINKS = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's links as stars: (node, smallest node it reaches within the task)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b", task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component): component is the smallest id reachable; only linked nodes are listed.

    Each task first joins its own links, at most about ``task_links`` of them. Where one task does not hold all, each round
    hooks every root to the smallest root seen across a link, then shortens all paths; rounds grow with the logarithm of a
    chain's length. All state is in tables of the shared folder; the driver sees counts. A self link lists its node.
    Nulls are ignored.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = materialize(edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).distinct())
    tasks = max(1, -(-edges.count() // task_links))
    stars = materialize(edges.repartition(tasks, "a").mapInArrow(_forest, "node long, component long"))
    discard(edges)
    if tasks == 1:
        return stars
    labels = materialize(stars.groupBy("node").agg(F.min("component").alias("component")))
    alive = stars.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    # the labels are hooks of nodes to smaller nodes: shorten them to roots first
    while True:
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = materialize(labels.join(up, "component", "left").select("node", F.coalesce("next", "component").alias("component"), F.coalesce(F.col("next") != F.col("component"), F.lit(False)).alias("moved")))
        discard(labels)
        labels = jumped
        if labels.where("moved").isEmpty():
            labels = labels.select("node", "component")
            break
    first = True
    while True:
        at = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        bt = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        # links between roots only: each round contracts the graph
        left = alive.join(at, "a").join(bt, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        left = materialize(left)
        if not first:
            discard(alive)
        alive, first = left, False
        if alive.isEmpty():
            return labels
        hooks = materialize(alive.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        # a root hooks to a smaller root, so chains of hooks end; jump until no parent has a parent
        while True:
            up = hooks.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jumped = materialize(hooks.select("node", "up").join(up, "up", "left").select("node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
            discard(hooks)
            hooks = jumped
            if jumped.where("moved").isEmpty():
                break
        shorter = labels.join(hooks.select(F.col("node").alias("component"), "up"), "component", "left")
        labels = materialize(shorter.select("node", F.coalesce("up", "component").alias("component")))
