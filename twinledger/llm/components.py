"""Connected components of a distributed edge list: tasks join the edges that they have, then large-star and small-star
steps alternate over what is left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, tidy, written

#: Edges that a task joins by itself, in memory for their nodes. Where there are no more in all, nothing is left to do.
LOCAL = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node of a task's edges (u, v) but the smallest of its component, an edge to that one."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := above.get(top, top)) != top:
            top = y
        while x != top:
            above[x], x = top, above[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                above[max(u, v)] = min(u, v)
    nodes = list(above)
    for i in range(0, len(nodes), 1 << 16):
        some = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(list(map(root, some)), pa.int64())], ["u", "v"])


def _star(edges: DataFrame) -> DataFrame:
    """(u, least of u and its neighbours v). Written, so that the join below can split a hot u."""
    return written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "star")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; the component is its smallest node.

    Edges with a null end and loops count for nothing; repeated edges count once. Each of the O(log^2) rounds is
    written to the shared folder, and deleted after the next. No node's neighbours are gathered: only minima per node, and
    joins that Spark can split.
    """
    given = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v"), "edges")
    parts = max(1, -(-given.count() // LOCAL))
    edges, before = written(given.coalesce(parts).mapInArrow(tidy(_joined), "u long, v long"), "edges"), None
    forget(given)
    while parts > 1 and (now := _digest(edges)) != before:
        before = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = _star(both)
        large = written(both.join(star, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = _star(large)
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done, edges = edges, written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(done, star, large, least)
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("v", "v"))
