"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprints import edited_fingerprints
from .jaccard import jaccard_components
from .language import fit_languages, identify_languages
from .licenses import scan_licenses
from .mixing import ORACLE as MIXING
from .mixing import mix_sources
from .neighbours import near_vectors
from .pieces import encode_pieces
from .quality import THRESHOLD, fit_quality, held_out, score_quality
from .substrings import dedup_substrings
from .token_files import new_path, read_tokens, write_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), path)
    return read_tokens(spark, path, with_ids=False)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "n_pieces", "ids_crc32", "round_trip")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("tag")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify_languages(docs.select("doc_id", "text"), fit_languages(docs))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints, op2_substring_dedup, op3_quality_classifier, op4_token_files, op5_embedding_near_dedup,
        op6_sentencepiece, op7_license_scan, op8_source_mixing, op9_language_id, op10_ngram_jaccard_join, pipeline,
    )
}

_LEADS = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER s" for k in range(1, 13))])

ORACLE_SQL: dict[str, str] = {
    "op8_source_mixing": MIXING,
    "op2_substring_dedup": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d
), g AS (
  SELECT doc_id, i, {_LEADS} AS g FROM p WINDOW s AS (PARTITION BY doc_id ORDER BY i)
), f AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS o FROM g WHERE g IS NOT NULL
), c AS (
  SELECT DISTINCT doc_id, i + k AS i FROM f, range(13) AS r(k) WHERE o < doc_id
), k AS (
  SELECT p.doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS kept FROM p ANTI JOIN c USING (doc_id, i) GROUP BY p.doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
    "op10_ngram_jaccard_join": """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d
), g AS (
  SELECT doc_id, w || ' ' || lead(w, 1) OVER s || ' ' || lead(w, 2) OVER s || ' ' || lead(w, 3) OVER s || ' ' || lead(w, 4) OVER s AS g FROM p WINDOW s AS (PARTITION BY doc_id ORDER BY i)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') AS g FROM d WHERE len(ws) BETWEEN 1 AND 4
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, g FROM g WHERE g IS NOT NULL
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
)
SELECT a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(b) AS component_id FROM r LEFT JOIN n ON n.doc_id = a GROUP BY a
""",
}
