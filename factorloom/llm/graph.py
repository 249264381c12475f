"""Connected components of a graph given as edges, by alternating star contractions.

Each round hooks the larger neighbours of every node to the smallest node of its neighbourhood
(large star), then the smaller ones (small star), until nothing changes.  Smallest neighbours come
from partial aggregates; these are dealt anew for the joins, which so can split the edges of a node
with very many of them.  Rounds are written to the shared folder, the one before is deleted;
nothing is collected but two numbers per round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, dealt_anew, discard, materialise

#: Nodes of which a task keeps the components at once.
FOREST_NODES = 300_000


def _forest(edges: DataFrame) -> DataFrame:
    """Within each task: the edges' components as stars, up to ``FOREST_NODES`` nodes at a time."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        def stars():
            pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > FOREST_NODES:
                yield stars()
        yield stars()

    return arrow_map(edges, run, "a long, b long")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(dealt_anew(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hooked = down.join(dealt_anew(least, "a"), "a")
    moved = hooked.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node with an edge to another one; the root is the smallest node reachable.

    Edges of a node to itself and repeated edges don't matter; no edges: no rows.
    """
    e = materialise(_forest(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")), "edges", edges.count())
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        old, e = e, materialise(_small_star(_large_star(e)), "edges", now[0])
        discard(old)
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
