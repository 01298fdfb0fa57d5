"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram binds (multiplies) its letters' vectors,
each permuted (rotated) by its place; a text bundles (adds) its n-grams' vectors, and a language bundles its texts.
A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out
from .shared import prepare, shared_folder, worker

DIM, GRAM, SEED = 512, 3, 20_011
#: Training texts for each language at most, chosen by a hash of their id.
TRAIN_TEXTS = 2_000
#: Languages whose counts are broadcast at most.
MOST_BROADCAST = 10_000
#: Characters bundled at once.
SLICE = 400_000
_letters: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def letter_vector(code: int) -> np.ndarray:
    """The vector of a letter (0: a gap between words)."""
    if code not in _vectors:
        if len(_vectors) > 20_000:
            _vectors.clear()
        _vectors[code] = np.random.default_rng([SEED, code]).integers(0, 2, DIM).astype(np.float32) * 2 - 1
    return _vectors[code]


def _bundle(texts: list[str]) -> np.ndarray:
    """The sum of n-gram vectors of each text. Runs of other characters than letters are one gap."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[joined]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (row[1:] == row[:-1])  # a gap is kept where it follows a letter
    codes, row = np.where(letter, joined, 0)[keep], row[keep]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    codes, row = np.insert(codes, starts, 0), np.insert(row, starts, row[starts])  # and one before the first letter
    out = np.zeros((len(texts), DIM), np.float32)
    if len(codes) < GRAM:
        return out
    names, small = np.unique(codes, return_inverse=True)
    k = len(names)
    gram = np.zeros(len(codes) - GRAM + 1, np.int64)
    for place in range(GRAM):
        gram = gram * k + small[place : place + len(gram)]
    inside = row[: len(gram)] == row[GRAM - 1 :]
    gram, at = gram[inside], row[: len(gram)][inside]
    if k**GRAM <= 1 << 22:
        found = np.flatnonzero(np.bincount(gram, minlength=1))
        place_of = np.zeros(k**GRAM, np.int32)
        place_of[found] = np.arange(len(found))
        gram = place_of[gram]
    else:
        found, gram = np.unique(gram, return_inverse=True)
    base = np.stack([letter_vector(int(c)) for c in names])
    for cut in range(0, len(found), 20_000):
        part = found[cut : cut + 20_000]
        vectors, rest = None, part
        for place in range(GRAM):  # the last letter is not rotated, the one before once, and so on
            v = np.roll(base, place, 1)[rest % k]
            vectors, rest = (v if vectors is None else vectors * v), rest // k
        here = (gram >= cut) & (gram < cut + len(part))
        counts = np.bincount(at[here] * len(part) + (gram[here] - cut), minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        out += counts.astype(np.float32) @ vectors
    return out


def text_vectors(texts: list[str | None]) -> np.ndarray:
    """Unit vectors of texts; zeros where there is no letter."""
    out, at = np.zeros((len(texts), DIM), np.float32), 0
    texts = [(t or "").lower() for t in texts]
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
            size += len(texts[end])
            end += 1
        pieces = [(k, texts[k][i : i + SLICE]) for k in range(at, end) for i in range(0, max(1, len(texts[k])), SLICE)]
        np.add.at(out, [k for k, _ in pieces], _bundle([p for _, p in pieces]))
        at = end
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = TRAIN_TEXTS) -> dict[str, np.ndarray]:
    """A unit prototype for each language of the rows that are not held out, from at most about ``texts`` texts each."""
    prepare(docs.sparkSession)
    shared_folder(docs.sparkSession)
    train = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")).where("_lang IS NOT NULL").where(~held_out("_id", 4, 2))
    counts = train.groupBy("_lang").agg(F.count("*").alias("c"))
    share = F.ceil(F.lit(texts) / F.col("c") * 1_000_003)
    counts = counts.withColumn("share", share).drop("c").checkpoint()
    few = counts.count() <= MOST_BROADCAST  # else the texts are shuffled
    chosen = train.join(F.broadcast(counts) if few else counts, "_lang").where(F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) < F.col("share")).select("_lang", "_text")

    def bundled(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            v = text_vectors(b.column(1).to_pylist())
            for k, lang in enumerate(b.column(0).to_pylist()):
                sums[lang] = sums.get(lang, 0) + v[k].astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["lang", "v"])

    total: dict[str, np.ndarray] = {}
    for r in chosen.repartition(16).mapInArrow(worker(bundled, "languages"), "lang string, v binary").toLocalIterator():  # 16 vectors a language at most
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["v"], np.float64)
    unit = {k: v / max(np.linalg.norm(v), 1e-9) for k, v in sorted(total.items())}
    return {k: v.astype(np.float32) for k, v in unit.items()}


def identify_languages(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the cosine, 0 to 1) to the columns of ``docs``, in place of any so named.

    ``und`` and 0.0 if the text is null or has no letter, or if no language was learned. Ties go to the first by code point.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop("lang_pred", "score")
    names = sorted(prototypes)
    sent = spark.sparkContext.broadcast(np.stack([prototypes[k] for k in names]) if names else np.zeros((0, DIM), np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = text_vectors(b.column(text_col).to_pylist())
            cos = v @ sent.value.T
            best = cos.argmax(1) if names else np.zeros(len(v), int)
            some = (np.abs(v).sum(1) > 0) & bool(names)
            pred = [names[k] if s else "und" for k, s in zip(best.tolist(), some.tolist(), strict=True)]
            score = np.where(some, np.clip(cos.max(1) if names else 0.0, 0, 1), 0.0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*b.schema.names, "lang_pred", "score"])

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(worker(run, "languages"), schema)
