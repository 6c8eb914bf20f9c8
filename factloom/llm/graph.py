"""Connected components of an edge table, by distributed min-label contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import lean, settled


def forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b: long) of each partition reduced by union-find to at most one per vertex.

    Each vertex is joined to the smallest vertex that its partition's edges connect it with, so
    groups of any density shrink to stars before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        def flushed() -> pa.RecordBatch:
            rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 1_000_000:
                yield flushed()
                parent.clear()
        yield flushed()

    return edges.select("a", "b").mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame, local: bool = True) -> DataFrame:
    """(id, component): every vertex of the edges (a, b: long) with the smallest one it can reach.

    Rounds of two steps until nothing changes: each vertex's larger neighbours are linked to its
    smallest neighbour (or itself), then its smaller ones. Edges become stars in a logarithmic
    number of rounds. Null ends and loops are left out; an empty table gives none. Each round's
    edges are written to the shared folder, and only their counts come to the driver. Both steps
    aggregate before they shuffle, and their joins may be split where one vertex has very many
    edges.
    """
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    now = settled((forest(now) if local else now).distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        # Large step: larger neighbours go to the least; small step: the rest, and the vertex itself, too.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = settled(large, "edges")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(settled(small, "least"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = settled(moved.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
