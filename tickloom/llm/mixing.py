"""Mixing sources to target weights, in DataFrame functions only.

Documents get a random key from a hash of their id and text. Within a source they are range-sorted by key: hashes are uniform,
so equal ranges of keys hold about equally many documents, and a source of any size is spread over as many ranges as it
needs, also where ids are null or repeat. Prefix sums of sizes are taken within ranges and over the ranges' totals. A source whose target is above its
size repeats whole epochs; in the last epoch documents are taken in key order, the last one in part, until the target is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, stored

#: Documents that one range of keys holds, about, or the root of its source's number if that is more; so a source of 10^10 has 10^5 ranges.
RANGE_ROWS = 500
#: Weights by source, repeating; share of all sizes to take; times a source may be taken.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def word_count(text: Column) -> Column:
    """Number of runs of characters outside \\x20 and \\x09-\\x0D; null: 0."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", "")
    return F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Of one row (source, source_size) for each source: adds ``target``, a double.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes. A target stops at ``most``
    times its source's size, and what that leaves goes to the others by weight until none is above: every target is
    then min(most * size, level * weight), and the level follows from the sources in order of most * size / weight.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sources.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    # the first source that the level does not fill sets it for itself and all after it
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)["level"]
    df = df.withColumn("final", level)
    return df.withColumn("target", F.when(F.col("final").isNull() | (F.col("cap") < F.col("final") * F.col("w")), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("w"))).select("source", "source_size", "target")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix"
) -> DataFrame:
    """For each row: its id, ``size``, ``source_size``, ``target`` (its source's) and ``taken``, and its text's hash ``tag``.

    size: words of the text (null: 0). taken: words that the mix takes of the document, counting repeats; a source's taken
    words are its target, rounded. Keys are equal for rows equal in id and text, which are
    interchangeable. A null source is a source of its own and a null id an id like others. Sources of size 0 have target 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    said = lambda c: F.coalesce(c, F.lit("null"))
    key = F.md5(F.concat(said(F.col(id_col).cast("string")), F.lit(":"), said(F.md5(F.col(text_col).cast("binary"))), F.lit(f":{seed}")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("tag"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"))
    rows = stored(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = source_targets(sources.select("source", "source_size"), weights, share, most).withColumnsRenamed({"source": "_s", "source_size": "_z"})
    named = sources.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_z")
    named = named.withColumn("budget", F.round("target").cast("long")).withColumn("ranges", F.ceil(F.col("rows") / F.greatest(F.lit(float(RANGE_ROWS)), F.sqrt("rows"))))
    named = named.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
    named = named.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "_s")
    # left to the planner: it broadcasts this side when its measured size allows, and else splits hot sources
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    high = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("range", F.shiftright(high * F.col("ranges"), 32))
    totals = rows.groupBy("source", "range").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("_s"), F.col("range").alias("_r"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "range").orderBy("key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("earlier", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("base") - F.col("earlier")))
    return rows.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "tag")


#: The mix in the SQL of another engine, over all documents.
ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(concat(coalesce(doc_id::VARCHAR, 'null'), ':', coalesce(md5(text), 'null'), ':mix')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, 2 * source_size AS cap,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), g AS (
  SELECT *, (SELECT arg_min(level, cap / w::DOUBLE) FROM f WHERE level * w <= cap) AS final FROM f
), t AS (
  SELECT source, source_size, CASE WHEN final IS NULL OR cap < final * w THEN cap::DOUBLE ELSE final * w END AS target FROM g
), r AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - earlier)) END)::BIGINT AS taken
FROM r
"""
