"""Connected components of a table of links, by joins that shrink it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obligor.session import pin


class UnionFind:
    """Components of links that one task finds; remembers only nodes that have a link."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, node: int) -> int:
        parent = self.parent
        top = parent.setdefault(node, node)
        while parent[top] != top:
            top = parent[top]
        while parent[node] != top:
            parent[node], node = top, parent[node]
        return top

    def join_all(self, left: np.ndarray, right: np.ndarray) -> None:
        """Join the pairs of two arrays; the smaller node becomes the root."""
        differ = left != right
        for a, b in zip(left[differ].tolist(), right[differ].tolist(), strict=True):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """One edge per node that is no root: (node, root)."""
        pairs = [(node, self.find(node)) for node in self.parent]
        pairs = [pair for pair in pairs if pair[0] != pair[1]]
        both = np.array(pairs, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; ``root`` is the component's smallest node.

    ``edges`` has columns src and dst. Large-star and small-star steps alternate until the
    edges stay the same: each node hands its larger, then its smaller neighbours to the
    smallest of them, so no step makes more rows than it reads. Each round is a written
    table; a lost executor repeats one round at most.
    """
    edges = pin(_both_ways(edges).where("src > dst").distinct(), "edges")
    size = _signature(edges)
    while size[0]:
        wide = _both_ways(edges)
        least = wide.groupBy("src").agg(F.min("dst").alias("least"))
        down = (
            wide.where("dst > src")
            .join(least, "src")
            .select(F.col("dst").alias("src"), F.least("least", "src").alias("dst"))
            .distinct()
        )
        lows = down.groupBy("src").agg(F.min("dst").alias("least"))
        small = (
            down.join(lows, "src")
            .select(F.col("dst").alias("src"), F.col("least").alias("dst"))
            .union(lows.select("src", F.col("least").alias("dst")))
            .where("src <> dst")
            .distinct()
        )
        edges = pin(small, "edges")
        before, size = size, _signature(edges)
        if size == before:
            break
    tops = edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return tops.union(edges.select(F.col("dst"), F.col("dst")).distinct())


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))


def _signature(edges: DataFrame) -> tuple:
    """Number of edges and a sum that changes with any of them."""
    return tuple(
        edges.agg(F.count("*"), F.coalesce(F.sum(F.hash("src", "dst").cast("long")), F.lit(0))).first()
    )
