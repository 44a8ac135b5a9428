"""Connected components of an edge table by alternating stars, all in joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..staging import stage


class Forest:
    """Union-find over row numbers; tells which links join two trees."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        la, lb = self.label[a], self.label[b]
        _, first = np.unique(np.minimum(la, lb) * len(self.label) + np.maximum(la, lb), return_index=True)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        for i in first.tolist():
            x, y = find(int(la[i])), find(int(lb[i]))
            if x != y:
                root[max(x, y)] = min(x, y)
                self.links.append((int(a[i]), int(b[i])))
        if root:
            old, where = np.unique(self.label, return_inverse=True)
            self.label = np.fromiter((find(int(x)) for x in old), np.int64, len(old))[where]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # A table of its own, so that adaptive execution can split the join where a node is a hub.
    least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
    return (both.filter("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = stage(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
    moved = (edges.join(least, "a").filter("b != least")
             .select(F.col("b").alias("a"), F.col("least").alias("b")))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the least node reachable.

    Both stars keep the components and never make more edges than there were; the number
    of rounds grows with the logarithm of the longest chain. Each round is a written
    table. A node with very many neighbours is one aggregate row and one side of a join
    that adaptive execution can split. Self links and repeated links are harmless; a
    link with a null end is no link; no edges give no rows.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .filter("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = stage(_small_star(stage(_large_star(edges), "edges")), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
