"""Static range asymmetric numeral system, vectorised over interleaved lanes.

A block of ids is dealt to ``LANES`` lanes in turn; each lane is a 64-bit coder state, and all lanes step together. Blocks share a
frequency table but nothing else, so they decode independently. A block holds checkpoints (all lanes' states and the place
in the words) from which decoding can start in its middle, and a checksum of all its bytes.

Layout, little-endian: magic ``TKR1``, ids u32, lanes u32, checkpoints u32, words u32, crc32 u32 of what follows; then for each
checkpoint its first id u32, its first word u32 and a u64 for each lane; then the words, u32 each.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U = np.uint64
LANES, PRECISION = 2048, 18
#: Ids in a block, and ids from one checkpoint to the next (a multiple of LANES).
BLOCK, CHECKPOINT = 1 << 20, 1 << 18
_LOW = U(1 << 31)
_HEAD = struct.Struct("<4sIIIII")


class Table:
    """Frequencies of ids, scaled to 2^PRECISION; every id that occurs keeps at least 1."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray) -> None:
        self.symbols, self.freqs = symbols.astype(np.uint32), freqs.astype(np.uint32)

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """From counts by id."""
        symbols = np.flatnonzero(counts)
        c, room = counts[symbols].astype(np.float64), 1 << PRECISION
        if len(symbols) > room:
            raise ValueError("more distinct ids than the precision can hold")
        f = np.maximum(1, np.floor(c * room / max(c.sum(), 1)).astype(np.int64))
        order = np.argsort(-f, kind="stable")
        while len(f) and (off := room - int(f.sum())):
            if off > 0:
                f[order[0]] += off
            else:  # too much was given to rare ids; the frequent ones give it back
                able = order[f[order] > 1]
                f[able[: -off]] -= 1
        return cls(symbols, f)

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.symbols.max()) + 1 if len(self.symbols) else 1
        freq, start = np.zeros(size, U), np.zeros(size, U)
        freq[self.symbols] = self.freqs
        start[self.symbols] = np.cumsum(self.freqs) - self.freqs
        return freq, start

    def decoder(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By slot: the id, its frequency, and the slot's place within the id's slots."""
        at = np.repeat(np.arange(len(self.symbols)), self.freqs)
        start = np.cumsum(self.freqs) - self.freqs
        return self.symbols[at], self.freqs[at].astype(U), (np.arange(len(at)) - start[at]).astype(U)


def encode(ids: np.ndarray, coder: tuple[np.ndarray, np.ndarray]) -> bytes:
    """One block of the given ids (at least one), all of which the table must hold."""
    freq, start = coder
    lanes = min(LANES, len(ids))
    steps = -(-len(ids) // lanes)
    x = np.full(lanes, _LOW, U)
    limit = U(1 << (31 - PRECISION + 32))
    words: list[np.ndarray] = []
    states: list[tuple[int, np.ndarray]] = []
    f_all, c_all = freq[ids], start[ids]
    for step in range(steps - 1, -1, -1):
        a = step * lanes
        f, c = f_all[a : a + lanes], c_all[a : a + lanes]
        k = len(f)
        y = x[:k]
        over = y >= f * limit
        words.append(y[over].astype(np.uint32))
        y = np.where(over, y >> U(32), y)
        q = y // f
        x[:k] = (q << U(PRECISION)) + (y - q * f) + c
        if a % CHECKPOINT == 0:
            states.append((step, x.copy()))
    words.reverse()
    states.reverse()
    before = np.r_[0, np.cumsum([len(w) for w in words])]
    body = b"".join([struct.pack("<II", s * lanes, before[s]) + v.tobytes() for s, v in states]) + (np.concatenate(words) if words else np.zeros(0, np.uint32)).tobytes()
    return _HEAD.pack(b"TKR1", len(ids), lanes, len(states), int(before[-1]), zlib.crc32(body)) + body


def decode(block: bytes, slots: tuple[np.ndarray, np.ndarray, np.ndarray], first: int = 0) -> np.ndarray:
    """The ids of a block from its checkpoint number ``first`` on. Raises ValueError if the block is damaged.

    What lies between one checkpoint and the next is decoded at the same time, each stretch with lanes of its own.
    """
    magic, n, lanes, points, n_words, crc = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size :]
    if magic != b"TKR1" or zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    size = 8 + 8 * lanes
    marks = [struct.unpack_from("<II", body, k * size) for k in range(first, points)]
    at, word = (np.array(x, np.int64) for x in zip(*marks, strict=True))
    x = np.stack([np.frombuffer(body, U, lanes, k * size + 8) for k in range(first, points)])
    words = np.frombuffer(body, np.uint32, n_words, points * size).astype(U)
    symbol, freq, offset = slots
    ends = np.r_[at[1:], n]
    out = np.empty(n, np.uint32)
    mask = U((1 << PRECISION) - 1)
    for step in range(0, int((ends - at).max()), lanes):
        on = np.flatnonzero(at + step < ends)  # of stretches, all but the last are as long as each other
        y = x[on]
        if on[-1] == len(at) - 1 and (k := int(ends[-1] - at[-1]) - step) < lanes:
            y[-1, k:] = _LOW  # lanes beyond the block's end stand still
        slot = (y & mask).astype(np.int64)
        ids = symbol[slot]
        y = freq[slot] * (y >> U(PRECISION)) + offset[slot]
        for r, s in enumerate(on.tolist()):
            a = int(at[s]) + step
            k = min(lanes, int(ends[s]) - a)
            out[a : a + k] = ids[r, :k]
            low = np.flatnonzero(y[r, :k] < _LOW)
            y[r, low] = (y[r, low] << U(32)) | words[word[s] : word[s] + len(low)]
            word[s] += len(low)
        x[on] = y
    return out[at[0] :]
