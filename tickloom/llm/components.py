"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_folder

#: Edges that one task contracts at once (16 MB of pairs). What is left of a graph is finished in one task if it is no larger.
CONTRACTED = 1_000_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the edges connect: each node but the smallest, with the smallest."""
    names, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(names))
    a, b = codes[: len(u)], codes[len(u) :]
    while True:
        ra, rb = root[a], root[b]
        if np.array_equal(ra, rb):
            break
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        u, v = contract(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        if sum(len(x[0]) for x in held) >= CONTRACTED:
            yield flush()
            held = []
    if held:
        yield flush()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Of edges (u, v) of longs: (node, root), root being the smallest node of its component.

    Nodes without an edge to another node are not listed. Self-loops, repeated edges and rows with a null count
    for nothing. Hot nodes only ever meet in ``min`` with partial aggregation and in a join on a unique key, whose skew
    the adaptive planner splits. A graph of at most ``CONTRACTED`` stars is contracted by one task, which spares the
    rounds; a larger one takes them. Raises if ``rounds`` steps did not suffice.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    edges = edges.select(F.col(edges.columns[0]).cast("long").alias("u"), F.col(edges.columns[1]).cast("long").alias("v"))
    stars = edges.where("u != v").mapInArrow(_contracted, "u long, v long").checkpoint()

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = signature(stars)
    if last[0] <= CONTRACTED:
        whole = stars.repartition(1).mapInArrow(_contracted, "u long, v long").checkpoint() if last[0] else stars
        return whole.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        # large-star: every larger neighbour of a node goes to the node's smallest neighbour (or itself)
        both = stars.union(stars.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # small-star: every smaller neighbour, and the node itself, goes to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        stars = small.where("u != v").distinct().checkpoint()
        now = signature(stars)
        if now == last:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
    raise RuntimeError(f"components not found in {rounds} rounds")
