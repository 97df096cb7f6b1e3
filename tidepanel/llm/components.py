"""Connected components of a link table: forests per task, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import shared

#: Edges that a task joins at a time, and by which the tasks of a forest are numbered.
PIECE_EDGES = 1 << 17


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the nodes 0 to n - 1 that links reach from each of them: roots hang below smaller ones."""
    root = np.arange(n)
    while True:
        one, two = root[a], root[b]
        apart = one != two
        if not apart.any():
            return root
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while True:
            higher = root[root]
            if (higher == root).all():
                break
            root = higher


def _forest(edges: DataFrame) -> DataFrame:
    """(u, v): the edges of every ``PIECE_EDGES`` of a task as stars around their smallest ids; the same nodes meet."""

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def stars() -> pa.RecordBatch:
            ends = [np.concatenate(x) for x in zip(*held, strict=True)]
            nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
            root = least_reached(place[: len(ends[0])], place[len(ends[0]) :], len(nodes))
            below = np.flatnonzero(root != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[root[below]])], names=["u", "v"])

        for batch in batches:
            for start in range(0, batch.num_rows, PIECE_EDGES):
                part = batch.slice(start, PIECE_EDGES)
                if held and sum(len(u) for u, _ in held) + part.num_rows > PIECE_EDGES:
                    yield stars()
                    held.clear()
                held.append((part.column("u").to_numpy(), part.column("v").to_numpy()))
        if held:
            yield stars()

    return edges.mapInArrow(run, "u bigint, v bigint")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest id that the node sees."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of a link: the smallest id that links reach from it.

    Every task first makes a forest of its links; what that leaves meets in as few tasks as its number needs. Where one
    piece holds it all, its forest is the answer; more go through rounds of stars, whose number grows with the logarithm of the
    longest path. Each round's edges are written to the shared folder, so a lost executor costs one round at most, and
    those of the round before are deleted. Links to itself and NULLs are passed over; no links give no rows.
    """
    ends = [F.col(left).cast("bigint"), F.col(right).cast("bigint")]
    edges = shared.stored(
        _forest(
            links.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
            .select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v")).filter("u > v")
        ), "edges",
    )
    tasks = max(1, -(-edges.count() // PIECE_EDGES))
    before, edges = edges, shared.stored(_forest(edges.coalesce(tasks)), "edges")
    shared.discard(before)
    state = None
    while tasks > 1:
        before, edges = edges, shared.stored(_small_star(_large_star(edges)), "edges")
        shared.discard(before)
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
