"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtally.session import settle


class Forest:
    """Union-find over the nodes of one task; the smallest node is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class Links:
    """Union-find over numbered items of one task, in whole arrays; keeps the links that joined something."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.kept: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.up[a], self.up[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            # of the links that join one tree to a lower one, the first is enough for now
            tops, first = np.unique(np.maximum(ra, rb), return_index=True)
            self.up[tops] = np.minimum(ra, rb)[first]
            self.kept.append(np.stack((a[first], b[first]), 1))
            while not np.array_equal(self.up, above := self.up[self.up]):
                self.up = above

    def pairs(self) -> np.ndarray:
        return np.concatenate(self.kept) if self.kept else np.zeros((0, 2), np.int64)


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, one edge to the root for each linked node.

    The union-find holds at most ``LIMIT`` nodes; when full it is emitted and begun anew.
    """
    limit = 500_000
    forest = Forest()

    def out() -> pa.RecordBatch:
        nodes = list(forest.up)
        return pa.RecordBatch.from_pydict({
            "a": pa.array(nodes, pa.int64()), "b": pa.array([forest.root(x) for x in nodes], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.link(a, b)
        if len(forest.up) > limit:
            yield out()
            forest = Forest()
    if forest.up:
        yield out()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: BIGINT); root is the smallest node reachable.

    Edges are first thinned to a spanning forest per task, then large-star and
    small-star steps alternate until nothing changes. Each step writes its edges to the
    shared folder. A node with very many edges only meets them in a minimum that is
    combined before the shuffle, and in a join that AQE can split. NULL ends and
    self-links are ignored; no edges give no rows.
    """
    now = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    now = now.where("a is not null and b is not null and a <> b").mapInArrow(_spanning, "a bigint, b bigint")
    now = settle(now.distinct())  # a > b in every edge
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        low = settle(low)
        # large star: each larger neighbour points to the smallest one
        star = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .where("a <> b").distinct())
        star = settle(star)
        # small star: each node's smaller neighbours, and itself, point to the smallest one
        least = settle(star.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        if not least.where("n > 1").limit(1).count():
            pairs = star
            nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
            chained = nodes.alias("x").join(nodes.alias("y"), F.expr("x.root = y.node"), "left_semi")
            if not chained.limit(1).count():
                tops = nodes.select(F.col("root").alias("node"), "root").distinct()
                return settle(nodes.unionByName(tops))
        joined = star.join(least, "a")
        now = settle(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(joined.where("b = m").select("a", F.col("m").alias("b"))).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
