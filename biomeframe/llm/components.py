"""Connected components.

Large-star and small-star steps alternate: each is a partial aggregation (least neighbour per node) and a join on the
node, in DataFrame functions only.  A caller may ask for union-find in one executor task instead, for at most ``local``
edges (counted first), whose memory that bound limits.  Links and components never reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut

#: Edges that one task joins: some 30 bytes each, and twice that for its table of nodes.
LOCAL_EDGES = 500_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = parent[y]
            x = y
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([root(x) for x in part])], names=["node", "component"])


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    links = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.union(least.select("u", F.col("m").alias("v"))).distinct()


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", local: int = 0) -> DataFrame:
    """``(node, component)`` for each node of an edge; component is the least node reachable.

    Null ends and loops are ignored; an empty edge table gives an empty result.
    Repeated edges count once.  Python runs only where ``local`` is positive and covers the edges.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    )
    e = cut(e.distinct())
    before = _sum(e)
    if 0 < before[0] <= local:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(_union_find, f"node {kind}, component {kind}")
    while before[0]:
        e = cut(_small(_large(e)))
        now = _sum(e)
        if now == before:
            break
        before = now
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(out.select(F.col("component").alias("node"), "component")).distinct()
