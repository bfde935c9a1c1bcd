"""Connected components of links between documents, by joins that end in stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_salted, save_table

#: Parts into which the neighbours of a node are dealt.
SALTS = 64


class UnionFind:
    """Of the nodes that one task sees (numbers or tuples); the least node is a set's root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):  # noqa: ANN001, ANN201
        root = x
        while (up := self.up.get(root, root)) != root:
            root = up
        while (up := self.up.get(x, x)) != root:
            self.up[x] = root
            x = up
        return root

    def union(self, a, b) -> None:  # noqa: ANN001
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> list[tuple]:
        return [(r, x) for x in self.up if (r := self.find(x)) != x]


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node that can be reached) for every node of a link but the roots themselves.

    ``links`` has a and b (long, or structs that have an order; a < b). Rounds of large and small stars move links towards the least node until nothing
    changes, which takes about as many rounds as the logarithm of the longest way. Each round is written, so a lost executor
    costs one round. Nodes with many links are not gathered: minima are aggregates, and joins deal the links of a node.
    """
    edges = save_table(links.select("a", "b").filter("a < b").distinct(), "links")
    before = None
    while True:
        # large star: a node's greater neighbours go to the least of its neighbourhood
        both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = join_salted(both.filter("y > x"), least, ["x"], "y", SALTS).select(F.col("m").alias("a"), F.col("y").alias("b")).distinct()
        # small star: a node and its lesser neighbours go to the least of these
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = join_salted(large, low, ["b"], "a", SALTS).select(F.col("m").alias("r"), "a", "b")
        moved = small.select(F.col("r").alias("a"), "b").unionByName(small.filter("a > r").select(F.col("r").alias("a"), F.col("a").alias("b")))
        edges = save_table(moved.distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now
