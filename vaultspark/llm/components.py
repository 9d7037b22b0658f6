"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, trim


class Forest:
    """Union-find over any hashable nodes; a root is its tree's least node."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Nodes of one union-find; more begin another.
_NODES = 200_000


def stars(forest: Forest, nodes) -> pa.RecordBatch:
    """Edges from each of ``nodes`` to its root, where that is another node."""
    out = [(x, r) for x in nodes if (r := forest.find(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(2)], schema=_EDGE)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars: the same components with at most one edge for each node of a union-find."""
    forest = Forest()
    for batch in batches:
        a, b = (batch.column(i).to_pylist() for i in range(2))
        for x, y in zip(a, b, strict=True):
            forest.join(x, y)
        if len(forest.up) > _NODES:
            yield stars(forest, list(forest.up))
            forest = Forest()
    if forest.up:
        yield stars(forest, list(forest.up))
    trim()


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Whether each node has one edge downwards at most, and none if edges end in it: then ``e`` is the answer."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("root")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("root")))
    bad = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("root").alias("root")).where("down + root > 1")
    return not bad.select("node").limit(1).collect()


def components(edges: DataFrame, contract: bool = True) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b longs); root is the least node of the component.

    Edges stay tables in the shared checkpoint folder; only whether they are stars already reaches the driver.
    Hubs are aggregated before they are shuffled, and the joins are plain ones that adaptive execution can split.
    ``contract`` is for edges that were not contracted where they were made.
    """
    # Which stars a partition gives depends on the order in which its rows come, so they are computed once and kept:
    # the loop reads them several times, and two different sets of stars would lose links between them.
    e = edges.where("a <> b")
    e = e.mapInArrow(_contract, "a long, b long") if contract else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = checkpointed(e.distinct())
    while not _is_forest_of_stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        e = checkpointed(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
