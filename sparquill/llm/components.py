"""Connected components by contraction with random priorities.

A graph of at most ``LOCAL_EDGES`` edges (counted) is solved by one task, in memory of a known bound.
Above that, rounds contract it until it is small enough. In each round every node picks, among itself and its neighbours, the one of least hash under that
round's seed; the graph is contracted along the picks and loops and repeated edges go. A round
removes a constant share of the edges' nodes on average, so rounds grow with the logarithm of the
graph. Each round is written to the shared folder: lineage stays short, and neither edges nor
labels reach the driver, only their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.storage import passing, written

LOCAL_EDGES = 500_000


def _picked(edges: DataFrame, seed: int) -> DataFrame:
    """(node, to) for each node with an edge; least hash wins, and pre-aggregation keeps hubs cheap."""
    def order(c: Column) -> Column:
        return F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), c.alias("v"))

    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select(F.col("b"), F.col("a")))
    best = both.groupBy("node").agg(F.min(order(F.col("other"))).alias("m"))
    return best.select("node", F.least(F.col("m"), order(F.col("node")))["v"].alias("to"))


def _solved(edges: DataFrame) -> DataFrame:
    """(node, to): the least node reachable, for each node of a small graph, found by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        nodes = list(root)
        for at in range(0, len(nodes), 50_000):
            some = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], names=["node", "to"])

    return edges.repartition(1).mapInArrow(run, "node long, to long")


def _relabelled(labels: DataFrame | None, picked: DataFrame) -> DataFrame:
    if labels is None:
        return picked.select("node", F.col("to").alias("label"))
    to = picked.select(F.col("node").alias("label"), "to")
    return labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``node`` and ``component`` (least node reachable) of every node of ``edges(a, b)``; loops and nulls are ignored."""
    with passing(edges.sparkSession) as keep:
        edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
        labels: DataFrame | None = None
        seed = 0
        while edges.count() > local_edges:
            seed += 1
            picked = written(_picked(edges, seed), "picked")
            labels = written(_relabelled(labels, picked), "labels")
            left, right = picked.toDF("a", "to_a"), picked.toDF("b", "to_b")
            moved = edges.join(left, "a").join(right, "b").filter("to_a <> to_b")
            edges = written(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        last = _solved(edges)
        if labels is None:
            return keep(written(last.select("node", F.col("to").alias("component")), "components"))
        labels = written(_relabelled(labels, last), "labels")
        least = labels.groupBy("label").agg(F.min("node").alias("component"))
        return keep(written(labels.join(least, "label").select("node", "component"), "components"))
