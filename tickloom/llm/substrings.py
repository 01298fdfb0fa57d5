"""Substring deduplication with a count-min prefilter.

A window is ``n`` consecutive words. Pass 1 sketches, for each window, its *anchor*: the lowest hash among the window's
``SUB``-word runs. Equal windows have equal anchors, and neighbouring windows mostly share theirs, so the sketch counts a
fifth of the windows' number. A task's sketch (``ROWS`` rows of 2^32 counters, sparse and sorted) is merged with the others by
ranges of cells; the least of an anchor's counters is never below the number of documents that hold a window of it. Pass 2
sends only windows whose counters all reached two, and groups them exactly: it carries the words, and windows are equal
where all their words are equal byte for byte.

Runs of neighbouring windows with one anchor travel as one piece of text. A task first settles what it can: of the documents
it holds, only the one with the smallest id sends a window on, the others' windows are known to be repeated. So a passage
that a third of all documents share costs one entry a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import PIECES, by_key, n_partitions, prepare, stored, worker
from .words import grams, mix, run_codes, text_slices, word_codes, word_spans

#: Words in the runs that anchors are taken from.
SUB = 5
#: Rows of the sketch, each of 2^32 cells.
ROWS = 2
#: Which cells of a row were counted twice is sent to all tasks as bits, ``SPARSE`` for each such cell, but 2^MOST_BITS (64 MB)
#: at most. Beyond that, more windows reach the second pass, and the result stays the same.
SPARSE, FEWEST_BITS, MOST_BITS = 16, 16, 29
#: Cells, windows and bytes that a map task holds before it sends them on.
HELD_CELLS, HELD_WINDOWS, HELD_BYTES = 2_000_000, 1_000_000, 16 << 20
_NO_ID = np.iinfo(np.int64).max


def anchors(h: np.ndarray, n: int) -> np.ndarray:
    """The lowest ``SUB``-word hash in each window of n words, mixed."""
    sub = min(SUB, n)
    low = grams(h, sub)
    left, size = n - sub + 1, 1
    while size < left:  # minimum over ``left`` neighbours, by doubling
        step = min(size, left - size)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        size += step
    return mix(low)


def cells_of(anchor: np.ndarray, row: int) -> np.ndarray:
    """The cells of anchors in a row of the sketch."""
    return (anchor >> np.uint64(32 * (1 - row))).astype(np.uint32)


def _windows(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text with a window: its row, the bytes around it, its words' starts and ends in them, and its windows' anchors."""
    for i, j, buf, offs in text_slices(texts):
        h, starts, ends, bounds = word_spans(buf, offs, lower=False)
        low = anchors(h, n)
        for k in range(j - i):
            a, b = int(bounds[k]), int(bounds[k + 1])
            if b - a >= n:
                yield i + k, buf, starts[a:b], ends[a:b], low[a : b - n + 1]


def _sketches(docs: DataFrame, n: int, shards: int) -> DataFrame:
    """Each task's sparse sketch, cut into ranges of cells by row: cells seen, and whether more than once."""
    shift = np.uint32(32 - (shards.bit_length() - 1))

    def run(batches):
        held, size = [], 0

        def flush(row: int):
            cells, counts = np.unique(cells_of(np.concatenate(held), row), return_counts=True)
            shard = (cells >> shift) if shards > 1 else np.zeros(len(cells), np.uint32)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            at = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([row * shards + s for s in at], pa.int32()),
                    pa.array([cells[cuts[s] : cuts[s + 1]].tobytes() for s in at], pa.binary()),
                    pa.array([np.packbits(counts[cuts[s] : cuts[s + 1]] > 1).tobytes() for s in at], pa.binary()),
                ],
                names=["shard", "cells", "again"],
            )

        for b in batches:
            for *_, low in _windows(b.column(2), n):
                once = np.unique(low)
                held.append(once)
                size += len(once)
                if size >= HELD_CELLS:
                    yield from map(flush, range(ROWS))
                    held, size = [], 0
        if held:
            yield from map(flush, range(ROWS))

    return docs.mapInArrow(worker(run), "shard int, cells binary, again binary")


def repeated_cells(docs: DataFrame, n: int) -> list[np.ndarray]:
    """For each row of the merged sketch a bit array of the cells counted at least twice, of a width that follows their number."""
    parts = n_partitions(docs.sparkSession)
    shards = 1 << min(MOST_BITS - 3, max(0, (PIECES * parts - 1).bit_length()))

    def merge(batches):
        for shard, rows in by_key(batches, "shard"):
            cells = [np.frombuffer(r["cells"], np.uint32) for r in rows]
            twice = [c[np.unpackbits(np.frombuffer(r["again"], np.uint8), count=len(c)).astype(bool)] for c, r in zip(cells, rows, strict=True)]
            ordered = np.sort(np.concatenate(cells))
            twice = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], *twice]))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(twice)], pa.int64()), pa.array([twice.tobytes()], pa.binary())], names=["shard", "n", "cells"])

    merged = _sketches(docs, n, shards).repartition(parts, "shard").sortWithinPartitions("shard")
    merged = stored(merged.mapInArrow(worker(merge), "shard int, n long, cells binary"), "cells")
    total = merged.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(FEWEST_BITS, shards.bit_length() + 2, (SPARSE * -(-total // ROWS)).bit_length()))
    width = (1 << bits) // shards

    def fold(batches):
        for b in batches:
            for r in b.to_pylist():
                flags = np.zeros(width, bool)
                flags[(np.frombuffer(r["cells"], np.uint32) >> np.uint32(32 - bits)).astype(np.int64) - r["shard"] % shards * width] = True
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]], pa.int32()), pa.array([zlib.compress(np.packbits(flags).tobytes(), 1)], pa.binary())], names=["shard", "bits"])

    out = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    for r in merged.mapInArrow(worker(fold), "shard int, bits binary").toLocalIterator():  # ROWS times 64 MB at most, all slices together
        row, s = divmod(r["shard"], shards)
        out[row, s * width // 8 : (s + 1) * width // 8] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return list(out)


def _estimated_repeated(flags: list[np.ndarray], low: np.ndarray) -> np.ndarray:
    """Places of the anchors whose counters all reached two."""
    at = np.arange(len(low))
    for row, bits in enumerate(flags):
        shift = np.uint32(30 - len(bits).bit_length())  # 2^bits flags are 2^(bits-3) bytes
        bit = cells_of(low[at], row) >> shift
        at = at[(bits[bit >> np.uint32(3)] >> (7 - (bit & np.uint32(7))).astype(np.uint8) & 1).astype(bool)]
    return at


def _runs(*same: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of neighbouring places begin among entries, and how long they are; entries of a run agree in all of ``same``."""
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1] + 1
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, len(place)])


class _Windows:
    """Windows of documents, given as runs of text: their exact codes and where their words are."""

    def __init__(self, buf: bytes, lengths: np.ndarray, n: int) -> None:
        """buf: runs one after the other, between white space; lengths: windows of each run."""
        self.buf = memoryview(buf)
        self.starts, self.ends, codes = word_codes(buf)
        base = np.cumsum(lengths + n - 1) - (lengths + n - 1)
        self.word = np.repeat(base - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        self.codes = run_codes(codes, n)[self.word] if len(self.word) else np.zeros(0, np.int64)
        self.n = n

    def again(self, ids: np.ndarray) -> np.ndarray:
        """Of each window, whether it is also in a document with a smaller id; ids: of the windows' documents."""
        if not len(ids):
            return np.zeros(0, bool)
        least = np.full(int(self.codes.max()) + 1, _NO_ID)
        np.minimum.at(least, self.codes, ids)
        return ids > least[self.codes]

    def text(self, first: np.ndarray, length: np.ndarray) -> list:
        """The text of runs of windows that begin at windows ``first``."""
        a, b = self.starts[self.word[first]], self.ends[self.word[first] + length + self.n - 2]
        return [self.buf[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


_PACKED = "shard int, ids binary, tags binary, counts binary, places binary, lengths binary, text binary"


def _packed(shard, who, ids, tags, places, lengths, texts: list | None, shards: int) -> pa.RecordBatch:
    """Runs of windows as one row for each shard, with each document's id and tag once; no texts: the windows are known to be repeated."""
    order = np.lexsort((places, who, shard))
    shard, who, places, lengths = shard[order], who[order], places[order].astype(np.uint32), lengths[order].astype(np.uint32)
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    cols: list[list] = [[] for _ in range(7)]
    for s in np.unique(shard).tolist():
        a, b = int(cuts[s]), int(cuts[s + 1])
        starts = np.flatnonzero(np.r_[True, who[a + 1 : b] != who[a : b - 1]])
        docs = who[a:b][starts]
        text = None if texts is None else b" ".join([texts[k] for k in order[a:b].tolist()])
        row = (s, ids[docs].tobytes(), tags[docs].tobytes(), np.diff(np.r_[starts, b - a]).astype(np.uint32).tobytes(), places[a:b].tobytes(), lengths[a:b].tobytes(), text)
        for col, x in zip(cols, row, strict=True):
            col.append(x)
    kinds = [pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _PACKED.split(", ")])


def _candidates(docs: DataFrame, n: int, bits, shards: int) -> DataFrame:
    """Windows estimated repeated, packed by shard; rows without text hold windows already known to be repeated."""

    def run(batches):
        flags = bits.value
        held: list[tuple] = []
        size = held_bytes = 0

        def flush():
            ids, tags = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
            who = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
            places, low = (np.concatenate([x[k] for x in held]) for k in (2, 3))
            w = _Windows(b" ".join([x[4] for x in held]), np.concatenate([x[5] for x in held]), n)
            again = w.again(ids[who])
            shard = ((low >> np.uint64(32)).astype(np.int64) * shards >> 32).astype(np.int64)
            sent = np.flatnonzero(~again)
            if len(sent):
                first, length = _runs(who[sent], shard[sent], place=places[sent])
                first = sent[first]
                yield _packed(shard[first], who[first], ids, tags, places[first], length, w.text(first, length), shards)
            known = np.flatnonzero(again)
            if len(known):  # these only travel to the place where all of a document's finds meet
                first, length = _runs(who[known], place=places[known])
                first = known[first]
                yield _packed(who[first] % shards, who[first], ids, tags, places[first], length, None, shards)

        for b in batches:
            ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k, buf, starts, ends, low in _windows(b.column(2), n):
                at = _estimated_repeated(flags, low)
                if len(at):
                    first, length = _runs(place=at)
                    a, z = starts[at[first]].tolist(), ends[at[first] + length + n - 2].tolist()
                    text = b" ".join([buf[x:y].tobytes() for x, y in zip(a, z, strict=True)])
                    held.append((ids[k], tags[k], at, low[at], text, length))
                    size += len(at)
                    held_bytes += len(text)
                    if size >= HELD_WINDOWS or held_bytes >= HELD_BYTES:
                        yield from flush()
                        held, size, held_bytes = [], 0, 0
        if held:
            yield from flush()

    return docs.mapInArrow(worker(run), _PACKED)


_FOUND = "bucket int, ids binary, tags binary, counts binary, places binary"


def _by_document(ids, tags, places) -> tuple:
    """Distinct (id, tag), the number of places of each, and the places in that order."""
    order = np.lexsort((tags, ids))
    ids, tags, places = ids[order], tags[order], places[order]
    cuts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])
    return ids[cuts], tags[cuts], np.diff(np.r_[cuts, len(ids)]).astype(np.uint32), places


def _unpacked(r: dict, *more: str) -> tuple:
    """Ids, tags and places of a row's entries, and other arrays of theirs."""
    counts = np.frombuffer(r["counts"], np.uint32)
    ids, tags = (np.repeat(np.frombuffer(r[k], np.int64), counts) for k in ("ids", "tags"))
    return ids, tags, *(np.frombuffer(r[k], np.uint32) for k in ("places", *more))


def _each_window(ids, tags, places, lengths) -> tuple:
    """Runs of windows as windows."""
    at = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(at)) - np.repeat(np.cumsum(lengths, dtype=np.int64) - lengths, lengths)
    return ids[at], tags[at], (places[at] + step).astype(np.uint32)


def _repeats(packed: DataFrame, n: int, parts: int) -> DataFrame:
    """(_id, _tag, places): starts of windows that also start in a document with a smaller id, a row for each document."""
    buckets = PIECES * parts

    def judge(batches):
        for _, rows in by_key(batches, "shard"):
            held = [_unpacked(r, "lengths") for r in rows if r["text"] is not None]
            known = [_each_window(*_unpacked(r, "lengths")) for r in rows if r["text"] is None]
            if held:
                ids, tags, places, lengths = (np.concatenate([x[k] for x in held]) for k in range(4))
                w = _Windows(b" ".join([r["text"] for r in rows if r["text"] is not None]), lengths.astype(np.int64), n)
                ids, tags, places = _each_window(ids, tags, places, lengths)
                again = w.again(ids)
                known.append((ids[again], tags[again], places[again]))
            ids, tags, places = (np.concatenate([x[k] for x in known]) for k in range(3))
            bucket = (mix(ids.view(np.uint64) ^ mix(tags.view(np.uint64))) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            for k in np.unique(bucket).tolist():
                at = order[np.searchsorted(bucket, k) : np.searchsorted(bucket, k, "right")]
                got = _by_document(ids[at], tags[at], places[at])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in got)], names=[x.split()[0] for x in _FOUND.split(", ")])

    def gather(batches):
        for _, rows in by_key(batches, "bucket"):
            held = [_unpacked(r) for r in rows]
            ids, tags, counts, places = _by_document(*(np.concatenate([x[k] for x in held]) for k in range(3)))
            ends = np.cumsum(counts, dtype=np.int64)
            for at in range(0, len(ids), 1000):
                some = [places[e - c : e].tobytes() for e, c in zip(ends[at : at + 1000].tolist(), counts[at : at + 1000].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 1000]), pa.array(tags[at : at + 1000]), pa.array(some, pa.binary())], names=["_id", "_tag", "places"])

    judged = packed.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(worker(judge), _FOUND)
    return judged.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(worker(gather), "_id long, _tag long, places binary")


def without(text: str | None, starts: np.ndarray, n: int) -> tuple[int, int, str]:
    """Number of words, number removed, and the kept words joined by one space."""
    words = (text or "").encode().split()
    if not len(starts):
        return len(words), 0, b" ".join(words).decode()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts.astype(np.int64) + n, -1)
    kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
    return len(words), len(words) - len(kept), b" ".join([words[k] for k in kept.tolist()]).decode()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 13, carry: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """For each row: its id, ``n_words``, ``n_removed`` and ``kept`` (the kept words, joined by one space), and ``carry``.

    as_is: texts that lose nothing keep their white space too.

    A word goes if a window of ``n`` words covers it whose words also start in a document with a smaller id; windows
    are judged on the input. Null and blank texts have no words. A null id counts as the largest there is, and two
    rows with the same id do not take words from each other; repeated rows yield repeated results. No rows: no result.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = n_partitions(spark)
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(_NO_ID))).alias("_id"),
        F.xxhash64(text_col).alias("_tag"),
        F.col(text_col).alias("_text"),
        F.struct(F.col(id_col).cast("long").alias("_own"), *[F.col(c).alias(f"c_{c}") for c in carry]).alias("_carried"),
    )
    slim = base.select("_id", "_tag", "_text")
    bits = spark.sparkContext.broadcast(repeated_cells(slim, n))
    found = _repeats(_candidates(slim, n, bits, PIECES * parts), n, parts).withColumnRenamed("places", "_places")
    joined = base.join(found, ["_id", "_tag"], "left").select("_id", "_text", "_places", "_carried")

    def cut(batches):
        for b in batches:
            got = []
            for text, places in zip(b.column(1), b.column(2), strict=True):
                starts = np.frombuffer(places.as_py() or b"", np.uint32)
                got.append(without(text.as_py(), np.unique(starts), n))
                if as_is and not got[-1][1]:
                    got[-1] = (*got[-1][:2], text.as_py())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.string()), b.column(3)],
                names=["_id", "n_words", "n_removed", "kept", "_carried"],
            )

    kind = joined.schema["_carried"].dataType.simpleString()
    out = joined.mapInArrow(worker(cut), f"_id long, n_words long, n_removed long, kept string, _carried {kind}")
    return out.select(F.col("_carried._own").alias(id_col), "n_words", "n_removed", "kept", *[F.col("_carried")[f"c_{c}"].alias(c) for c in carry])
