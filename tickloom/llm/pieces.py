"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is indexed at once: its distinct stretches, but for those matched lately, are laid end to end and their suffixes
are sorted (up to the longest piece's length), every piece is looked up by binary search, which gives the range of suffixes that begin with it, and the resulting edges (place,
end, piece) are sorted by position. Relaxation then finds each stretch's pieces:

* unigram models: the best path, relaxing edges from left to right;
* BPE models: edges are relaxed in order of score, and leftmost first among equals; an edge applies if the current segmentation
  has a boundary at its ends and exactly one inside. That is what merging the best neighbouring pair does.

Stretches are what no piece reaches across: white space joins only what follows it, and characters that stand in no longer
piece stand alone. Characters that are no piece become the pieces of their bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Memo, prepare, worker

SPACE = "▁"
#: Stretches of text whose pieces a worker remembers, and the longest that is worth it.
REMEMBERED, LONGEST = 600_000, 64
#: Characters indexed at once.
INDEXED = 1 << 18


class PieceModel:
    """Pieces, scores and matching of a SentencePiece model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.pieces = [m.id_to_piece(k) for k in range(n)]
        self.unknown = m.unk_id()
        normal = [k for k in range(n) if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k) or m.is_unused(k))]
        self.bytes = {int(self.pieces[k][3:5], 16): k for k in range(n) if m.is_byte(k)}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.control = {k for k in range(n) if m.is_control(k)}
        self.ids = {self.pieces[k]: k for k in normal}
        self.scores = {k: m.get_score(k) for k in normal}
        # of a pair's edges the better score goes first; the rank keeps that order as a whole number
        order = sorted(normal, key=lambda k: (-self.scores[k], k))
        last, rank, self.rank = None, -1, {}
        for k in order:
            rank += self.scores[k] != last
            last, self.rank[k] = self.scores[k], rank
        self.ranks = np.zeros(n, np.int64)
        self.ranks[list(self.rank)] = list(self.rank.values())
        longer = [p for p in self.ids if len(p) > 1]
        joins = set("".join(longer))
        self.joins_space = any(SPACE in p[1:] and p.strip(SPACE) and SPACE in p.lstrip(SPACE) for p in longer)
        inner = "".join(re.escape(c) for c in sorted(joins - {SPACE}))
        # runs of joinable characters with the spaces before them; every other character alone
        self.stretch = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|." if not self.joins_space else f"[{SPACE}{inner}]+|.", re.DOTALL)
        self.width = max(len(p) for p in self.ids)
        # characters of longer pieces are numbered; all others share a number that stands in no piece
        alphabet = sorted(joins)
        if len(alphabet) > 65_000:
            raise ValueError("pieces with more than 65,000 different characters")
        self.number = np.full(0x110000, 1, np.uint16)
        self.number[[ord(c) for c in alphabet]] = np.arange(2, 2 + len(alphabet))
        self.number[0] = 0
        self.searched = sorted(longer)
        self.searched_ids = np.array([self.ids[p] for p in self.searched], np.int64)
        self.lengths = np.array([len(p) for p in self.searched], np.int64)
        self.low, self.high = (np.array([self._key(p, fill) for p in self.searched], f"S{2 * self.width}") for fill in (b"\0\0", b"\xff\xff"))
        self.is_bpe = self._looks_like_bpe(m)
        self.known = Memo(REMEMBERED)

    @staticmethod
    def _looks_like_bpe(m) -> bool:
        """BPE models score their pieces by whole numbers, one less for each merge."""
        scores = [m.get_score(k) for k in range(m.get_piece_size()) if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k))]
        return all(float(s).is_integer() for s in scores[:2000])

    def _key(self, p: str, fill: bytes) -> bytes:
        return b"".join(int(self.number[ord(c)]).to_bytes(2, "big") for c in p) + fill * (self.width - len(p))

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of pieces of two or more characters: starts, ends and ids, sorted by start, then end."""
        n, w = len(text), self.width
        codes = self.number[np.frombuffer((text + "\0" * w).encode("utf-32-le"), np.uint32)].astype(">u2")
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, w)[:n]).view(f"S{2 * w}").ravel()
        array = np.argsort(suffixes, kind="stable")
        ordered = suffixes[array]
        lo = np.searchsorted(ordered, self.low, "left")
        hi = np.searchsorted(ordered, self.high, "right")
        count = hi - lo
        starts = array[np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
        ids, ends = np.repeat(self.searched_ids, count), starts + np.repeat(self.lengths, count)
        by = np.lexsort((ends, starts))
        return starts[by], ends[by], ids[by]

    def _single(self, c: str) -> list[int]:
        if c in self.ids:
            return [self.ids[c]]
        return [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]

    def _relax_bpe(self, text: str, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Segmentation of all stretches of a batch at once; stretch k is text[first[k] : first[k + 1] - 1].

        In each turn every stretch applies its best edge among those that join two neighbouring pieces.
        """
        n = len(text)
        after = np.arange(1, n + 2)  # of a piece's start: its end
        begins = np.ones(n + 1, bool)
        name = np.full(n + 1, -1, np.int64)
        rank = self.ranks[ids]
        owner = np.searchsorted(first, starts, "right") - 1
        while len(starts):
            able = begins[starts] & (begins[ends] | (ends == n)) & (after[starts] < ends)
            starts, ends, ids, rank, owner = starts[able], ends[able], ids[able], rank[able], owner[able]
            ready = np.flatnonzero(after[after[starts]] == ends)
            if not len(ready):
                break
            own = owner[ready]
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            key = rank[ready] * (n + 1) + starts[ready]
            best = np.minimum.reduceat(key, heads)
            chosen = ready[key == np.repeat(best, np.diff(np.r_[heads, len(own)]))]
            s, e = starts[chosen], ends[chosen]
            begins[after[s]] = False
            after[s], name[s] = e, ids[chosen]
        out = []
        at = np.flatnonzero(begins[:n])
        cuts = np.searchsorted(at, first).tolist()
        plain = name[at]
        single = np.flatnonzero(plain < 0)
        chars = {c: self._single(c) for c in set(text)}
        odd = {c for c, k in chars.items() if len(k) != 1}
        where = at[single].tolist()
        plain[single] = [chars[text[i]][0] for i in where]
        more = {i for i in where if text[i] in odd} if odd - {"\0"} else set()
        plain32 = plain.astype(np.int32)
        data = plain32.tobytes()
        for k in range(len(first) - 1):
            a, b = cuts[k], cuts[k + 1] - 1  # without the separator
            if more and more.intersection(at[a:b].tolist()):
                got = [x for i in range(a, b) for x in (chars[text[at[i]]] if int(at[i]) in more else [int(plain[i])])]
                out.append(np.array(got, np.int32).tobytes())
            else:
                out.append(data[4 * a : 4 * b])
        return out

    def _relax_unigram(self, text: str, edges: list[tuple[int, int, int]]) -> list[int]:
        n, low = len(text), min(self.scores.values(), default=0.0) - 10
        best, via = [0.0] + [-np.inf] * n, [None] * (n + 1)
        by: dict[int, list] = {}
        for s, e, k in edges:
            by.setdefault(s, []).append((e, k))
        for s in range(n):
            k = self.ids.get(text[s])
            for e, k, gain in [(s + 1, k, self.scores[k] if k is not None else low), *((e, k, self.scores[k]) for e, k in by.get(s, ()))]:
                if best[s] + gain > best[e]:
                    best[e], via[e] = best[s] + gain, (s, k)
        out, e = [], n
        while e:
            s, k = via[e]
            out.append([k] if k is not None else self._single(text[s:e]))
            e = s
        return [k for part in reversed(out) for k in part]

    def match(self, stretches: list[str]) -> list[bytes]:
        """The ids of each stretch (int32, as bytes)."""
        out: list[bytes] = []
        at = 0
        while at < len(stretches):
            end, size = at, 0
            while end < len(stretches) and (end == at or size < INDEXED):
                size += len(stretches[end]) + 1
                end += 1
            some = stretches[at:end]
            text = "\0".join(some) + "\0"
            starts, ends, ids = self.edges(text)
            first = np.r_[0, np.cumsum([len(x) + 1 for x in some])]
            if self.is_bpe:
                out += self._relax_bpe(text, starts, ends, ids, first)
            else:
                cuts = np.searchsorted(starts, first).tolist()
                starts, ends, ids = starts.tolist(), ends.tolist(), ids.tolist()
                for k, x in enumerate(some):
                    base = int(first[k])
                    found = [(starts[i] - base, ends[i] - base, ids[i]) for i in range(cuts[k], cuts[k + 1])]
                    out.append(np.array(self._relax_unigram(x, found), np.int32).tobytes())
            at = end
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null and empty texts have none. A dummy space goes before a text, spaces are kept."""
        get = self.known.young.get
        split, missing = [], {}
        for t in texts:
            parts = self.stretch.findall(SPACE + t.replace(" ", SPACE)) if t else []
            got = list(map(get, parts))
            if None in got:
                missing.update((p, None) for p, g in zip(parts, got, strict=True) if g is None)
                split.append((parts, got))
            else:
                split.append(b"".join(got))
        if missing:
            missing = dict(zip(missing, self.known.revived(list(missing)), strict=True))
            new = [p for p, v in missing.items() if v is None]
            found = dict(zip(new, self.match(new), strict=True))
            missing.update(found)
            self.known.add({p: v for p, v in found.items() if len(p) <= LONGEST})
        out = [x if isinstance(x, bytes) else b"".join([missing[p] if g is None else g for p, g in zip(*x, strict=True)]) for x in split]
        return [np.frombuffer(x, np.int32) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, without the dummy space; control pieces have none."""
        out: list[bytes] = [self._decoded[k] for k in ids.tolist()]
        text = b"".join(out).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    @property
    def _decoded(self) -> list[bytes]:
        if not hasattr(self, "_texts"):
            self._texts = [bytes([self.byte_of[k]]) if k in self.byte_of else b"" if k in self.control else " ⁇ ".encode() if k == self.unknown else p.replace(SPACE, " ").encode() for k, p in enumerate(self.pieces)]
        return self._texts


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Adds to the columns of ``docs``, in place of any so named: ``ids`` (of the whole text), ``n_pieces``, ``ids_crc32`` (of the ids
    as little-endian unsigned 32-bit integers) and ``round_trip`` (whether decoding them gives the text back).

    model: path of a SentencePiece model. Null and empty texts have no ids, and their round trip is true.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("ids", "n_pieces", "ids_crc32", "round_trip")

    def run(batches: Iterator[pa.RecordBatch], m: PieceModel) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            got = m.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in got])], pa.int32()), pa.array(np.concatenate([*got, np.zeros(0, np.int32)])))
            n = pa.array([len(x) for x in got], pa.int64())
            crc = pa.array([zlib.crc32(x.tobytes()) for x in got], pa.int64())
            same = pa.array([m.decode(x) == (t or "") for x, t in zip(got, texts, strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, lists, n, crc, same], names=[*b.schema.names, "ids", "n_pieces", "ids_crc32", "round_trip"])

    schema = docs.select("*", F.array(F.lit(0)).alias("ids"), F.lit(0).cast("long").alias("n_pieces"), F.lit(0).cast("long").alias("ids_crc32"), F.lit(True).alias("round_trip")).schema
    return docs.mapInArrow(worker(run, "pieces", PieceModel, model), schema)


def decode_pieces(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Adds the decoded text of an array of ids to the other columns, in place of one so named; null ids give null."""
    prepare(encoded.sparkSession)
    encoded = encoded.drop(text_col)

    def run(batches: Iterator[pa.RecordBatch], m: PieceModel) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else m.decode(np.array(x, np.int32)) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text_col])

    return encoded.mapInArrow(worker(run, "pieces", PieceModel, model), encoded.select("*", F.lit("").alias(text_col)).schema)
