"""Embedding near-dedup by cross-polytope hashing.

A vector is padded to a power of two and rotated by three rounds of random signs and a fast Hadamard transform; its hash is the
closest vertex of the cross-polytope, that is the place and sign of the entry with the largest magnitude. A bucket is named
by ``HASHES`` such vertices from independent rotations; in each of ``TABLES`` tables a vector enters the bucket of
its best vertices and ``PROBES`` more, reached by the runner-up that costs least. Vectors that share a bucket are candidates,
and every candidate pair is verified by its cosine in double precision.

Equal vectors are one class with a count, so copies cost one member. Within a bucket, verified pairs become counts and stars at
once; a pair that shares several buckets counts in the first alone, which both sides can tell from their bucket names.
Buckets above ``SPLIT`` members are cut into blocks and every pair of blocks is a unit of work of its own, so nothing is
dropped and no task holds a whole bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, contract
from .shared import n_partitions, prepare, stored, worker

#: Recall of pairs at cosine 0.9 in 64 dimensions is about 0.98 with these.
TABLES, HASHES, PROBES, SEED = 6, 3, 4, 77
#: Vectors that ``HASHES`` vertices serve; each further vertex serves ``PER_HASH`` times as many, and asks for ``MORE`` times the tables,
#: as pairs at the limit agree in a vertex less often than not. So buckets grow far more slowly than their number.
SERVED, PER_HASH, MORE = 100_000_000, 64, 1.7
SPLIT = 2048
#: Bucket entries, and pairs found, that a task verifies together.
HELD_ROWS, HELD_PAIRS = 16_384, 1_000_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform along the last axis (a power of two), unnormalised."""
    n, h = x.shape[-1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], -2).reshape(x.shape)
        h *= 2
    return x


def shape_for(vectors: int) -> tuple[int, int]:
    """Tables and hashes for this number of vectors."""
    extra = 0
    while vectors > SERVED * PER_HASH**extra:
        extra += 1
    return ceil(TABLES * MORE**extra), HASHES + extra


@cache
def _signs(table: int, k: int, turn: int, size: int) -> np.ndarray:
    return np.random.default_rng([SEED, table, k, turn]).integers(0, 2, size) * 2.0 - 1


def bucket_names(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """For unit vectors (n, d): names of the buckets each enters, (n, tables, 1 + probes), equal only within a table."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    out = np.zeros((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        vertex = np.zeros((n, hashes, probes + 1), np.int64)
        cost = np.zeros((n, hashes, probes + 1))
        for k in range(hashes):
            y = padded
            for r in range(3):
                y = hadamard(y * _signs(t, k, r, size)) / np.sqrt(size)
            top = np.argsort(-np.abs(y), 1, kind="stable")[:, : probes + 1]
            if top.shape[1] < probes + 1:
                top = np.pad(top, ((0, 0), (0, probes + 1 - top.shape[1])), mode="edge")
            value = np.take_along_axis(y, top, 1)
            vertex[:, k] = 2 * top + (value < 0)
            cost[:, k] = np.abs(value[:, :1]) - np.abs(value)
        home = vertex[:, :, 0]
        # a probe changes one hash to a runner-up; the cheapest such changes are taken
        changes = np.argsort(cost[:, :, 1:].reshape(n, -1), 1, kind="stable")[:, :probes]
        for p in range(1 + probes):
            v = home.copy()
            if p and changes.shape[1] >= p:
                k, r = np.divmod(changes[:, p - 1], probes)
                v[np.arange(n), k] = vertex[np.arange(n), k, 1 + r]
            name = np.full(n, t, np.int64)
            for k in range(hashes):
                name = name * (2 * size) + v[:, k]
            out[:, t, p] = name
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(float).tiny)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Unit vectors from an Arrow list column whose rows all have d entries."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))


def first_common(x: np.ndarray, i: np.ndarray, j: np.ndarray, bucket: np.ndarray, **how: int) -> np.ndarray:
    """Of pairs (i, j) of rows of x found in a bucket: whether it is the first bucket that they share."""
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    names = bucket_names(x[used], **how)
    i, j, keep = at[: len(i)], at[len(i) :], np.zeros(len(i), bool)
    for cut in range(0, len(i), 20_000):
        a, b = names[i[cut : cut + 20_000]], names[j[cut : cut + 20_000]]  # (pairs, tables, buckets)
        common = (a[:, :, :, None] == b[:, :, None, :]).any(3)
        keep[cut : cut + 20_000] = np.where(common, a, np.iinfo(np.int64).max).min((1, 2)) == bucket[cut : cut + 20_000]
    return keep


def _verified(table: pa.Table, least: float, how: dict) -> Iterator[pa.RecordBatch]:
    """Links among whole units of work (bucket, lo, hi) of vectors of one length: (cls, n, root)."""
    d = table["d"][0].as_py()
    x = _matrix(table["v"].combine_chunks(), d)
    bucket, lo, hi, mine, cls, copies = (table[c].to_numpy() for c in ("bucket", "lo", "hi", "mine", "cls", "copies"))
    cuts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), True])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        i, j, at = (np.concatenate(c) for c in zip(*found, strict=True))
        keep = first_common(x, i, j, at, **how)
        i, j = i[keep], j[keep]
        if len(i):
            n = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
            node, root = contract(cls[i], cls[j])
            at = np.flatnonzero(n)
            where = np.minimum(np.searchsorted(node, cls[at]), len(node) - 1)
            roots = np.where(node[where] == cls[at], root[where], cls[at])
            yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(n[at].astype(np.int64)), pa.array(roots)], names=["cls", "n", "root"])

    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        if lo[a] == hi[a]:
            i, j = np.nonzero(x[a:b] @ x[a:b].T >= least)
            i, j = a + i[i < j], a + j[i < j]
        else:
            left = np.flatnonzero(mine[a:b] == lo[a]) + a
            right = np.flatnonzero(mine[a:b] != lo[a]) + a
            i, j = np.nonzero(x[left] @ x[right].T >= least)
            i, j = left[i], right[j]
        if len(i):
            found.append((i, j, np.full(len(i), bucket[a])))
            size += len(i)
            if size >= HELD_PAIRS:
                yield from flush()
                found, size = [], 0
    if found:
        yield from flush()


def near_vectors(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, tables: int | None = None, hashes: int | None = None, probes: int = PROBES
) -> DataFrame:
    """For each row: its id, ``n_links`` (other vectors linked directly), ``component_id`` (smallest id reachable) and ``kept``.

    Null, empty, zero or non-finite vectors, and those holding a null, link with nothing. Vectors of different lengths do not
    link. tables, hashes: by default they follow the number of distinct vectors. Repeated ids are separate vectors; rows with a null id take part, and ``component_id`` is null only if no
    id is reachable. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    prepare(spark)
    parts = n_partitions(spark)
    kept_kind = "float" if embeddings.schema[vector_col].dataType.simpleString() == "array<float>" else "double"  # no digit is lost
    v = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    fine = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False))
    rows = embeddings.select(F.col(id_col).alias("_id"), F.when(fine, F.transform(v, lambda e: F.when(e == 0, F.lit(0.0)).otherwise(e)).cast(f"array<{kept_kind}>")).alias("v"))
    rows = rows.withColumn("cls", F.when(F.col("v").isNotNull(), F.shiftrightunsigned(F.xxhash64("v"), 1)))
    classes = rows.where("cls IS NOT NULL").groupBy("cls", "v").agg(F.count("*").alias("copies"), F.min("_id").alias("low"))
    classes = stored(classes, "vectors")  # grouping by the vector itself, so equal names mean equal vectors but for a collision

    wanted = shape_for(classes.count())
    how = {"tables": tables or wanted[0], "hashes": hashes or wanted[1], "probes": probes}

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, lengths = b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                names = bucket_names(_matrix(b.column(1).take(pa.array(at)), d), **how).reshape(len(at), -1)
                once = np.unique(np.stack([np.repeat(np.arange(len(at)), names.shape[1]), names.ravel()], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(once[:, 1]), pa.array(np.full(len(once), d, np.int32)), pa.array(cls[at][once[:, 0]])], names=["bucket", "d", "cls"])

    entries = stored(classes.select("cls", "v").mapInArrow(worker(enter), "bucket long, d int, cls long"), "entries")
    sizes = entries.groupBy("bucket", "d").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / SPLIT).cast("int")).drop("m")
    placed = entries.join(sizes, ["bucket", "d"])
    mine = F.pmod(F.xxhash64("cls", "bucket"), F.col("blocks")).cast("int")
    placed = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("bucket", "d", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "cls")
    placed = placed.join(classes.select("cls", "v", "copies"), "cls").repartition(parts, "bucket", "d", "lo", "hi").sortWithinPartitions("d", "bucket", "lo", "hi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            """Verifies the whole units among what is held, and keeps the last, which may go on."""
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            keys = [table[c].to_numpy() for c in ("d", "bucket", "lo", "hi")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            end = table.num_rows if last else int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if end < table.num_rows:
                held.extend(table.slice(end).to_batches())
            d = keys[0][:end]
            cuts = np.flatnonzero(np.r_[True, d[1:] != d[:-1], True]) if end else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield from _verified(table.slice(a, b - a), least, how)

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= HELD_ROWS:
                yield from done(False)
        if held:
            yield from done(True)

    found = stored(placed.mapInArrow(worker(verify), "cls long, n long, root long"), "links")
    linked = found.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = components(found.select("cls", "root")).withColumnsRenamed({"node": "cls"})
    named = classes.select("cls", "copies", "low").join(linked, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("cls", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("_id", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
