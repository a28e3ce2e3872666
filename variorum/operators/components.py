"""Connected components of a link table, by contraction within tasks and alternating stars between them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.runtime import cut

#: as many links as one task contracts in memory
TASK_LINKS = 1 << 18


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v") if not large else edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def stars(links: Iterable[tuple[int, int]]) -> dict[int, int]:
    """node -> smallest node reachable, of all nodes but the smallest ones."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while top in parent:
            top = parent[top]
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for u, v in links:
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = stars(x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["u", "v"])


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component) of every node of links (u, v); component is the smallest node reachable.

    Each task contracts at most about `task_links` links to stars, which keeps what is
    connected; where one task holds all that is left, that is the result. Beyond it
    rounds of a large and a small star (Kiveris et al., 2014) join the tasks' stars,
    after a number of rounds that grows with the logarithm of the size. Nothing but
    two figures a round reaches the driver. Nulls and self links count for nothing.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    left, seen = edges.count(), None
    while left:
        tasks = -(-left // task_links)
        own = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks, "u", "v")
        edges = cut(own.mapInArrow(_contract, "u long, v long"))
        if tasks == 1:
            break
        edges = cut(_star(_star(edges, True), False).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        left, seen = now[0], now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select("v", F.col("v").alias("component")).distinct().toDF("node", "component"))
