"""Connected components by alternating large-star and small-star steps on tables of links.

Each step groups links by node with map-side minima and joins the minimum back, so no task holds a node's neighbours.
Links are written to the shared folder after each round; the number of rounds grows with the logarithm of a
component's size. Up to ``ONE_TASK`` links (16 MB), a single task with union-find does the same at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

ONE_TASK = 1_000_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over undirected links given once in each direction (a, b)."""
    least = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    near = links.join(least, "a")
    if large:
        return near.where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.where("b < a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.where("m < a").select("a", F.col("m").alias("b")))


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): the least node that it reaches."""
    now = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if now.count() <= ONE_TASK:
        return now.coalesce(1).mapInArrow(_united, "node bigint, component bigint")
    mark = None
    while True:
        large = _star(_both(now), True).distinct()
        nxt = written(_star(_both(large), False).distinct(), "links")
        dropped(now)
        now = nxt
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
