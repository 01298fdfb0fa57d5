"""Token files: texts as token ids, coded by a static range asymmetric numeral system.

Documents are range-partitioned by id and encoded in order. What a task encodes goes into segments of up to ``SEGMENT`` ids, each
with one frequency table, counted from all its ids, that the segment's blocks share (see ``rans``). A file is a Parquet table
with a row for each segment: part, segment, ids of its documents, their lengths in tokens, the table, and the blocks. Spark
writes and reads it on any store and commits a task's file only once; segments decode in parallel.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .shared import Memo, n_partitions, prepare, run_folder, worker
from .words import text_slices

SEGMENT = 1 << 22
#: Units of text whose ids a worker remembers (about 200 bytes each).
REMEMBERED = 800_000
#: Bytes of text that a task encodes at once.
TOGETHER = 16 << 20
END = 0


#: Characters that, at the end of a unit and after a letter or digit, are tokens of their own.
_TAIL = ".,;:!?$%*&#"
#: Bytes of ASCII white space but for space and line break, and first bytes of characters that may be other white space.
_ODD = np.zeros(256, bool)
_ODD[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_GAP = np.zeros(256, bool)
_GAP[[10, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def single_spaced(texts: pa.Array) -> np.ndarray:
    """Of each text (no nulls): whether it is not empty and all its white space is single spaces or line breaks between words."""
    fine = np.zeros(len(texts), bool)
    for i, j, buf, offs in text_slices(texts):
        gap = _GAP[buf]
        odd = _ODD[buf]
        odd[1:] |= gap[1:] & gap[:-1]
        starts, ends = offs[:-1], offs[1:]
        some = ends > starts
        n_odd = np.r_[0, np.cumsum(odd)]
        ok = some.copy()
        # the first byte of a row is odd only if it is so by itself, not by the row before
        ok[some] &= ~gap[starts[some]] & ~gap[ends[some] - 1] & (n_odd[ends[some]] == n_odd[starts[some]])
        for k in np.flatnonzero(some & ~ok).tolist():  # the bytes did not settle it
            text = bytes(buf[offs[k] : offs[k + 1]]).decode()
            ok[k] = " ".join(text.split()) == text.replace("\n", " ")
        fine[i:j] = ok
    return fine


class UnitEncoder:
    """Encodes texts with the tokenizers library, unit by unit, remembering units.

    The byte-level splitter never joins characters across white space but for one space before a word. So a text whose words
    are apart by exactly one space or line break is a sequence of independent units: its first word, each `` word``, each
    ``\\nword``. Marks after a unit's last letter or digit are a unit of their own. All other texts (other or repeated
    white space, or some at an end) go to the library whole. What is remembered never changes a result.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.known = Memo(REMEMBERED)
        self.marks: dict[str, bytes] = {"": b""}
        # in a byte-level vocabulary each character of a token stands for one byte of text
        self.n_bytes = np.array([len(self.library.id_to_token(k) or "") for k in range(self.library.get_vocab_size())], np.int64)

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of units that begin with white space: many go to the library as one text, cut again by their bytes."""
        out = []
        for at in range(0, len(units), 2000):
            some = units[at : at + 2000]
            text = "".join(some)
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            size = list(map(len, some)) if text.isascii() else [len(u.encode()) for u in some]
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(size)) + 1
            data, size = ids.tobytes(), ids.itemsize
            out += [data[a * size : b * size] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return out

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _remembered(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units, each beginning with a space or a line break."""
        got = list(map(self.known.young.get, units))
        if None in got:
            missing = [k for k, g in enumerate(got) if g is None]
            for k, ids in zip(missing, self.known.revived([units[k] for k in missing]), strict=True):
                got[k] = ids
            missing = [k for k in missing if got[k] is None]
            for k, ids in zip(missing, self._encode_units([units[k] for k in missing]), strict=True):
                got[k] = ids
            self.known.add({units[k]: got[k] for k in missing})
        return got

    def _units(self, units: pa.Array, whole: list[bytes], end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct units as ``encode`` marks them, one after the other, and how many each has."""
        cores = pc.utf8_rtrim(units, _TAIL)
        (data, starts, ends), (cut, cut_starts, cut_ends) = _bytes_of(units), _bytes_of(cores)
        marks = (ends - starts) - (cut_ends - cut_starts)
        # a letter or digit stands before the marks: of ASCII, or a letter from U+00C0 to U+023F (two bytes)
        some = np.flatnonzero((marks > 0) & (marks < 8) & (cut_ends > cut_starts))
        last, lead = cut[cut_ends[some] - 1], cut[np.maximum(cut_ends[some] - 2, cut_starts[some])]
        two = (lead >= 0xC3) & (lead <= 0xC8) & (last >= 0x80) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
        some = some[_ALNUM[last] | two]
        trimmed = np.zeros(len(units), bool)
        trimmed[some] = True
        tail = np.zeros(len(units), np.int64)
        at = cut_ends[some] - cut_starts[some] + starts[some]  # where the marks begin
        while len(some):  # most have one
            tail[some] = tail[some] << 8 | data[at]
            more = at + 1 < ends[some]
            some, at = some[more], at[more] + 1
        first = data[starts]
        text = lambda x: pa.scalar(x, pa.large_string())
        keys = pc.if_else(pa.array(trimmed), cores, units)
        keys = pc.if_else(pa.array(first == 0x0C), text("\n"), pc.replace_substring(keys, "\x0b", "\n"))
        keys = pc.binary_join_element_wise(pc.if_else(pa.array(first > 0x0C), text(" "), text("")), keys, text("")).dictionary_encode()
        names, tails = keys.dictionary.to_numpy(zero_copy_only=False).tolist(), np.unique(tail)
        specials = np.flatnonzero(first == 0x0C)
        special = [end if len(u) == 1 else whole[int(u[1:])] for u in units.take(pa.array(specials)).to_pylist()]
        # a table of cores, marks and special units; each unit is a core without its line break, if it has none, and marks
        parts = [*self._remembered(names), *self._tails([int(t).to_bytes(8, "big").lstrip(b"\0").decode() for t in tails.tolist()]), *special]
        size = np.dtype(self.dtype).itemsize
        flat, n = np.frombuffer(b"".join(parts), self.dtype), np.fromiter(map(len, parts), np.int64, len(parts)) // size
        at = np.stack([keys.indices.to_numpy(), len(names) + np.searchsorted(tails, tail)], 1)
        at[specials, 0] = len(names) + len(tails) + np.arange(len(specials))
        begin, m = (np.cumsum(n) - n)[at], n[at]
        skip = np.where(first == 0x0B, len(self._remembered(["\n"])[0]) // size, 0)
        begin[:, 0] += skip
        m[:, 0] -= skip
        return _gathered(flat, begin.ravel(), m.ravel()), m.sum(1)

    def _tails(self, tails: list[str]) -> list[bytes]:
        """The ids of marks, which follow a letter or digit and so have no space before them."""
        for t in tails:
            if t not in self.marks:
                self.marks[t] = self._encode_whole([t])[0]
        return [self.marks[t] for t in tails]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has; null and empty texts have none but ``end``, if given."""
        texts = pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks] if isinstance(texts, pa.ChunkedArray) else [texts.cast(pa.large_string())]).fill_null("")
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        fine, empty = single_spaced(texts), pc.binary_length(texts).to_numpy() == 0
        # marks that no single-spaced text holds: \x0b before a first word, \x0c for the end, \x0c and a number for a whole text
        text = lambda x: pa.scalar(x, pa.large_string())
        spaced = pc.binary_join_element_wise(text("\x0b"), pc.replace_substring(pc.if_else(pa.array(fine), texts, text("")), "\n", " \n"), text(" \x0c"), text(""))
        odd = np.flatnonzero(~fine & ~empty)
        names = np.zeros(len(texts), np.int64)
        names[odd] = np.arange(len(odd))
        named = pc.binary_join_element_wise(text("\x0c"), pa.array(names).cast(pa.large_string()), text(" \x0c"), text(""))
        rows = pc.if_else(pa.array(fine), spaced, pc.if_else(pa.array(empty), text("\x0c"), named))
        whole = self._encode_whole([texts[k].as_py() for k in odd.tolist()]) if len(odd) else []
        split = pc.split_pattern(rows, " ")
        coded = split.flatten().dictionary_encode()
        mark = b"" if end is None else np.array([end], self.dtype).tobytes()
        flat, n = self._units(coded.dictionary, whole, mark)
        at = coded.indices.to_numpy()
        m = n[at]
        starts = np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy())]
        return _gathered(flat, (np.cumsum(n) - n)[at], m), np.diff(np.r_[0, np.cumsum(m)][starts])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a large_string array without nulls, and where each text starts and ends in them."""
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8), offs[:-1], offs[1:]


def _gathered(flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of n entries of ``flat`` that begin at each place, one after the other."""
    at = np.repeat(begin - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return flat.take(at)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Runs of batches of about this many bytes; none is empty."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


_SEGMENTS = "part int, segment int, ids array<long>, lengths array<long>, symbols binary, freqs binary, blocks array<binary>"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token file of ``docs`` in ascending order of ids: null ids first, equal ids by a hash of their text.

    tokenizer: path of a file of the tokenizers library. Each document ends with the id 0; null and empty texts have only
    that. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    tag = F.xxhash64("_text")
    rows = rows.repartitionByRange(n_partitions(spark), F.col("_id"), tag).sortWithinPartitions(F.col("_id"), tag)

    def run(batches: Iterator[pa.RecordBatch], encoder: UnitEncoder) -> Iterator[pa.RecordBatch]:
        part, segment, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids, lengths, stream = [i for h in held for i in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            table = rans.Table.of(np.bincount(stream))
            coder = table.encoder()
            blocks = [rans.encode(stream[a : a + rans.BLOCK], coder) for a in range(0, len(stream), rans.BLOCK)]
            cols = [[part], [segment], [ids], [lengths], [table.symbols.tobytes()], [table.freqs.tobytes()], [blocks]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _SEGMENTS.split(", ")])

        for table in gathered(batches, TOGETHER):
            names, (stream, lengths) = table.column(0).to_pylist(), encoder.encode(table.column(1), END)
            ends, at = np.cumsum(lengths), 0
            while at < len(names):  # segments end with a document
                before = int(ends[at - 1]) if at else 0
                stop = min(len(names), int(np.searchsorted(ends, before + SEGMENT - size)) + 1)
                held.append((names[at:stop], lengths[at:stop], stream[before : int(ends[stop - 1])]))
                size += len(held[-1][2])
                at = stop
                if size >= SEGMENT:
                    yield flush()
                    size, segment = 0, segment + 1
                    held.clear()
        if held:
            yield flush()

    rows.mapInArrow(worker(run, "encoder", UnitEncoder, tokenizer), _SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Reads a token file back: for each document its id, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked, ``ids``.

    start: ids of all documents before. ids_crc32: of the ids as little-endian unsigned 32-bit integers. A damaged
    block raises.
    """
    prepare(spark)
    files = spark.read.schema(_SEGMENTS).parquet(path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                part, segment, ids, lengths = (b.column(k)[r].as_py() for k in range(4))
                slots = rans.Table(*(np.frombuffer(b.column(k)[r].as_py(), np.uint32) for k in (4, 5))).decoder()
                stream = np.concatenate([rans.decode(x.as_py(), slots) for x in b.column(6)[r].values])
                cuts = np.r_[0, np.cumsum(lengths)]
                data = memoryview(stream).cast("B")
                crcs = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                cols = [pa.array([part] * len(ids), pa.int32()), pa.array([segment] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(cuts[:-1]), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["part", "segment", "_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(stream.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = files.mapInArrow(worker(decoded), "part int, segment int, _id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    sizes = files.select("part", "segment", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.join(parts, "part").select("part", "segment", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("base"))
    out = rows.join(bases, ["part", "segment"])
    return out.select(F.col("_id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def new_path(spark: SparkSession) -> str:
    """A new place for a token file that lasts as long as the application."""
    return f"{run_folder(spark)}/tokens-{uuid.uuid4().hex}"
