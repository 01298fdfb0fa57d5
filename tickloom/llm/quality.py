"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each turn fits a shallow tree on one feature's bins and adds a small step to that
feature's lookup table. Then the pairs of features that explain most of what is left are boosted the same way on
coarse grids. A score is a sum of table entries, looked up by bin for a whole batch at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import prepare, worker

#: Labelled rows that the model is fitted on at most, chosen by a hash of their id.
TRAIN_ROWS = 20_000
#: Of a score from which a text counts as good.
THRESHOLD = 0.3
BINS, GRID, ROUNDS, PAIR_ROUNDS, PAIRS, STEP, RIDGE = 32, 8, 150, 60, 6, 0.1, 5.0

FEATURES = (
    "log_chars", "log_words", "word_length", "letters", "upper", "digits", "symbols", "exclamations", "variety", "top_word",
    "repeats", "longest_run", "symbol_ends", "bare_symbols", "repeated_lines", "line_words", "short_words",
)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]] = True  # the first byte of a longer character counts as a letter
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ",.;:'\"-()?"]] = True
_PUNCTUATION = frozenset(b",.;:'\"-()?")


def features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of ``FEATURES``; a null or blank text has zeros."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    by = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, size = len(words), max(1, len(data) - int(by[128:192].sum()))
    letters = int(by[_LETTER].sum())
    counts = Counter(words)
    same = list(map(eq, words, words[1:]))
    run = longest = 0
    if any(same):
        for x in same:
            run = run + 1 if x else 0
            longest = max(longest, run)
    tails = Counter(map(int, map(bytes.__getitem__, words, [-1] * n)))
    symbol_ends = sum(v for k, v in tails.items() if _SYMBOL[k])
    bare = sum(v for k, v in counts.items() if len(k) <= 3 and all(_SYMBOL[c] for c in k))
    short = sum(v for k, v in counts.items() if len(k) <= 3)
    lines = [x for x in data.split(b"\n") if x]
    return [
        float(np.log1p(size)), float(np.log1p(n)), size / n, letters / size, int(by[65:91].sum()) / max(1, letters), int(by[48:58].sum()) / size,
        int(by[_SYMBOL].sum()) / size, int(by[33]) / size, len(counts) / n, max(counts.values()) / n, sum(same) / n, float(np.log1p(longest)),
        symbol_ends / n, bare / n, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), short / n,
    ]


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values by bin of a tree with few leaves over ordered bins, grown by the gain of splits."""
    spans = [(0, len(g))]
    G, H = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    worth = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + RIDGE)
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(spans):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = worth(a, cut) + worth(cut, b) - worth(a, b)
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (gain[j], k, int(cut[j]))
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree of depth 2 over a grid: one cut on each axis."""
    G, H = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    n, m = g.shape
    i, j = np.arange(1, n)[:, None], np.arange(1, m)[None, :]
    box = lambda X, a, b, c, d: X[b, d] - X[a, d] - X[b, c] + X[a, c]
    corners = [(0 * i, i, 0 * j, j), (0 * i, i, j, 0 * j + m), (i, 0 * i + n, 0 * j, j), (i, 0 * i + n, j, 0 * j + m)]
    gain = sum(box(G, *c) ** 2 / (box(H, *c) + RIDGE) for c in corners)
    k = np.unravel_index(int(np.argmax(gain)), gain.shape)
    a, b = int(k[0]) + 1, int(k[1]) + 1
    out = np.zeros_like(g)
    for r, c in ((slice(0, a), slice(0, b)), (slice(0, a), slice(b, m)), (slice(a, n), slice(0, b)), (slice(a, n), slice(b, m))):
        out[r, c] = g[r, c].sum() / (h[r, c].sum() + RIDGE)
    return float(gain[k]), out


class AdditiveModel:
    """Lookup tables by feature and by pair of features; the score is the logistic of their sum."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        d = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(d)]
        self.grid = [np.unique(e[np.linspace(0, len(e) - 1, min(len(e), GRID - 1)).astype(int)]) if len(e) else e for e in self.edges]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        rate = (y.sum() + 1) / (len(y) + 2)  # of no rows: 0.5
        self.base = float(np.log(rate / (1 - rate)))
        if not len(x):
            return
        bins = self._bins(x, self.edges)
        z = np.full(len(x), self.base)

        def residual() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for f in range(d):
                g, h = residual()
                size = len(self.tables[f])
                step = STEP * _tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size))
                self.tables[f] += step
                z += step[bins[f]]
        coarse = self._bins(x, self.grid)
        shape = [len(e) + 1 for e in self.grid]

        def grids(a: int, b: int) -> tuple[float, np.ndarray, np.ndarray]:
            g, h = residual()
            at = coarse[a] * shape[b] + coarse[b]
            g, h = (np.bincount(at, v, shape[a] * shape[b]).reshape(shape[a], shape[b]) for v in (g, h))
            return *_quadrants(g, h), at

        able = [f for f in range(d) if shape[f] > 1]
        ranked = sorted(((grids(a, b)[0], a, b) for k, a in enumerate(able) for b in able[k + 1 :]), reverse=True)[:PAIRS]
        self.pairs = {(a, b): np.zeros((shape[a], shape[b])) for _, a, b in ranked}
        for _ in range(PAIR_ROUNDS):
            for (a, b), table in self.pairs.items():
                _, step, at = grids(a, b)
                table += STEP * step
                z += STEP * step.ravel()[at]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        z = np.full(len(x), self.base)
        for table, at in zip(self.tables, self._bins(x, self.edges), strict=True):
            z += table[at]
        coarse = self._bins(x, self.grid)
        for (a, b), table in self.pairs.items():
            z += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-z))


def held_out(id_col: str, modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fits the model on at most ``rows`` labelled ids that are not held out, and at most twice as many documents (ids may repeat). Of repeated labels the least counts."""
    prepare(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    marked = marked.groupBy("_id").agg(F.min("_y").alias("_y")).where(~held_out("_id", 5, 0))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # the bound on what is broadcast and collected
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([np.array(v).tobytes() for v in x], pa.binary()), b.column(1), b.column(2)], names=["x", "y", "i"])

    got = texts.select("_text", "_y", F.xxhash64("_id", "_text")).mapInArrow(worker(run, "quality"), "x binary, y int, i long").orderBy("i").limit(2 * rows).toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float64).reshape(-1, len(FEATURES))
    return AdditiveModel(x, got["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: AdditiveModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the score (0 to 1) of each whole text to the columns of ``docs``, in place of one so named; null and blank texts score too."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(score_col)
    sent = spark.sparkContext.broadcast(model)  # tables of a few KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(text_col).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(x))], names=[*b.schema.names, score_col])

    return docs.mapInArrow(worker(run, "quality"), T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
