"""Vectorised word hashing over Arrow text buffers.

Words are the runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``. A short word's hash is a polynomial of its bytes
modulo 2^64, taken from prefix sums over the whole buffer and then mixed, so no Python object is made per word. Such
polynomials are equal for some pairs of words of 1024 bytes or more, whatever the base, so words above ``SHORT`` bytes
are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

U = np.uint64
#: Bytes hashed at once; bounds the temporary arrays to a few tens of MB.
CHUNK = 1 << 20
#: Bytes of the longest word that is hashed by its polynomial.
SHORT = 64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = 0xD6E8FEB86659FD93

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_KEPT = np.arange(1, 257, dtype=np.uint64)
_LOWERED = _KEPT.copy()
_LOWERED[65:91] = _KEPT[97:123]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, U)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _hash_chunk(buf: np.ndarray, at_start: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of ``buf``; at_start: positions where a document begins."""
    values = _LOWERED if lower else _KEPT
    word = _IS_WORD[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    first[at_start] |= word[at_start]
    before = at_start[at_start > 0] - 1
    last[before] |= word[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum(values[buf] * _power(_BASE, len(buf)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, len(buf) + 1)[starts]
    h = mix(h + (ends - starts).astype(U))
    for k in np.flatnonzero(ends - starts > SHORT).tolist():
        h[k] = xxhash.xxh3_64_intdigest((values[buf[starts[k] : ends[k]]] - U(1)).astype(np.uint8).tobytes())
    return starts, ends, h


def word_spans(buf: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words of the documents ``buf[offsets[i]:offsets[i+1]]``, and each document's bounds in them.

    lower: A-Z count as a-z. Long buffers are cut between words, so memory follows ``CHUNK``, not the text.
    """
    found, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))], 0
    while at < len(buf):
        end = min(at + CHUNK, len(buf))
        while end < len(buf):
            gap = np.flatnonzero(~_IS_WORD[buf[end : end + CHUNK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + CHUNK, len(buf))
        lo, hi = np.searchsorted(offsets, [at, end])
        starts, ends, h = _hash_chunk(buf[at:end], np.unique(offsets[lo:hi] - at).astype(np.int64), lower)
        found.append((starts + at, ends + at, h))
        at = end
    starts, ends, h = (np.concatenate(x) for x in zip(*found, strict=True))
    return h, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each document's bounds in them (see word_spans)."""
    h, _, _, bounds = word_spans(buf, offsets, lower)
    return h, bounds


def word_codes(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer, and a code for each, equal just where words are equal byte for byte."""
    data = np.frombuffer(buf, np.uint8)
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = _IS_WORD[data]
    starts, ends = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, np.int64)
    offsets = np.stack([starts, ends], 1).ravel()  # words and the gaps between them, in turn
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(buf)])
    return starts, ends, both.dictionary_encode().indices.to_numpy()[::2].astype(np.int64)


def run_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """A code for each run of n consecutive codes, equal just where all n are equal (the last n-1 entries have none)."""
    if len(codes) < n:
        return np.zeros(0, np.int64)

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return pd.factorize(a * (int(b.max()) + 1) + b)[0]

    size = 1
    while size * 2 <= n:
        codes = paired(codes[:-size], codes[size:])
        size *= 2
    return paired(codes[: len(codes) - (n - size)], codes[n - size :]) if size < n else codes


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive entries; entry i covers i .. i+n-1 (the last n-1 are absent)."""
    if len(h) < n:
        return np.zeros(0, U)
    out, done, size, power, block = None, 0, 1, _GRAM, h
    while True:
        if n & size:
            m = len(h) - n + 1
            part = block[done : done + m]
            out = part.copy() if out is None else out + part * U(pow(_GRAM, done, 1 << 64))
            done += size
        if size * 2 > n:
            return mix(out)
        block = block[:-size] + block[size:] * U(power)
        power = power * power % (1 << 64)
        size *= 2


def whole(h: np.ndarray) -> np.uint64:
    """Hash of a whole sequence, apart from every gram hash."""
    return mix(np.array([(h * _power(_GRAM, len(h))).sum(dtype=U) ^ U(len(h) * 0x632BE59BD9B4E019 % (1 << 64))], U))[0]


def text_slices(texts: pa.Array, most: int = 4 * CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts an Arrow text array into runs of rows of at most ``most`` bytes (or one row).

    Yields first row, end row, the bytes, and the rows' offsets in them. Nulls are empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end
