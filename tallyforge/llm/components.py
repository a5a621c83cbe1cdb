"""Connected components of a distributed edge list: local forests, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, trimmed

#: Edges that one local union-find holds.
FOREST_EDGES = 200_000


class Forest:
    """Union-find with path halving whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        pairs = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        return [x for x, _ in pairs], [r for _, r in pairs]


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, seen = Forest(), 0

    def flush() -> pa.RecordBatch:
        a, b = forest.stars()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(x, y)
        seen += batch.num_rows
        if seen >= FOREST_EDGES:
            yield flush()
            forest, seen = Forest(), 0
    yield flush()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come as (higher, lower)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of an edge, component being its smallest reachable node.

    edges: two bigint columns; loops, repeats and either direction are fine; rows with a null are
    ignored; an empty list gives an empty result. A node with very many neighbours is one
    aggregation key and one side of a join that adaptive execution splits; nothing is gathered in
    one task or on the driver. Each round's edges are written to the shared folder.
    """
    a, b = edges.columns[:2]
    plain = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).filter("a is not null and b is not null and a <> b")
    now = settle(plain.mapInArrow(lambda b: trimmed(_local_forests(b)), "a bigint, b bigint").filter("a <> b").distinct())
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if (seen.n, seen.x) == mark or not seen.n:
            break
        mark = (seen.n, seen.x)
        now = settle(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
