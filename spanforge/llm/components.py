"""Connected components by repeated contraction, all on shuffled tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.stage import cut


FEW = 10_000  # edges that one task may finish


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, target) for all of a few edges (a, b), the target being the smallest node in reach."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "target"])


def components(edges: DataFrame, kept: list[str]) -> DataFrame:
    """`edges(a, b)`, both long -> `(node, component_id)` for every node of an edge, the id being the
    smallest node that it can reach. Nulls and loops are dropped; repeated edges count once.

    A round sends every node to the smallest of itself and its neighbours and keeps the edges between
    different targets. Rounds 0, 1, 3, 5, ... order nodes by number, which ends stars and groups of
    near copies at once; the others by a hash of node and round, of which about half the nodes of any
    graph survive, so even a long chain takes rounds of its logarithm. Degrees are never gathered: a
    minimum combines before its shuffle, and joins on a hub can be split by adaptive execution because
    both sides come straight from files. The last FEW edges, if any, are finished at once.
    """
    e = cut(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(),
        kept,
    )
    first, maps, n = e, [], 0
    while left := e.count():
        if left <= FEW:
            maps.append(cut(e.coalesce(1).mapInArrow(_finish, "node long, target long"), kept))
            break
        rank = (lambda c: F.xxhash64(F.lit(n), c)) if n and n % 2 == 0 else (lambda c: F.col(c))
        pair = lambda x, y: F.struct(rank(x).alias("r"), F.col(x).alias("u"), rank(y).alias("s"), F.col(y).alias("v"))  # noqa: B023, E731
        both = e.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("p"))
        low = both.groupBy(F.col("p.u").alias("node")).agg(
            F.least(F.min(F.struct("p.s", "p.v")), F.min(F.struct(F.col("p.r").alias("s"), F.col("p.u").alias("v")))).alias("m")
        )
        low = cut(low.select("node", F.col("m.v").alias("target")), kept)
        maps.append(low)
        a, b = low.toDF("a", "ta"), low.toDF("b", "tb")
        e = e.join(a, "a").join(b, "b").filter("ta <> tb")
        e = cut(e.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), kept)
        n += 1
    label = first.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", F.col("node"))
    for low in maps:
        label = label.join(low.toDF("at", "to"), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    label = cut(label, kept)
    root = label.groupBy("at").agg(F.min("node").alias("component_id"))
    return label.join(cut(root, kept), "at").select("node", "component_id")


