"""Canonical exact fingerprints, in DataFrame functions only.

A text is made canonical (NFKC, full case folding, white space runs as one space, none at the ends) and digested to 128 bits
by two differently seeded xxhash64. Documents are grouped by digest; in groups of more than one, the canonical bytes
themselves are grouped, so a collision would be seen and told apart by a suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import n_partitions, prepare, stored

#: Ids, or fingerprints, up to this many are broadcast (16 or 32 bytes each); beyond it a shuffled join is used.
BROADCAST_IDS = 500_000


def _static(owner: str, method: str, text: Column) -> Column:
    """A static Java method (String, boolean) of the Unicode library that comes with Spark."""
    return F.reflect(F.lit(owner), F.lit(method), text, F.lit(True))


def canonical_text(text: Column) -> Column:
    """The canonical form of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    nfkc = lambda x: _static("com.ibm.icu.text.Normalizer", "compose", x)
    wide = nfkc(_static("com.ibm.icu.lang.UCharacter", "foldCase", nfkc(text)))
    plain = F.regexp_replace(F.lower(text), r"[ \t-\r]+", " ")
    ascii_only = F.length(text) == F.octet_length(text)
    return F.trim(F.when(ascii_only, plain).otherwise(F.regexp_replace(wide, r"(?U)\s+", " ")))


def wide_digest(canonical: Column) -> Column:
    """32 hex digits: two xxhash64 whose seeds differ."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canonical))), 16, "0") for seed in (1, 2)])


def _fingerprints(base: DataFrame) -> DataFrame:
    """Of (_id, _tag, _text): a stored table (_id, _tag, n, fp), fp being equal just where canonical bytes are.

    Only groups of equal digests are compared. Equal canonical texts are combined before they are shuffled, so a
    group that holds a third of all rows costs one text a task.
    """
    ids = stored(base.select("_id", "_tag", F.length("_text").cast("long").alias("n"), wide_digest(canonical_text(F.col("_text"))).alias("fp")), "digests")
    several = stored(ids.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp"), "several")
    # a written side lets the planner split a hot fingerprint where the join is shuffled
    wanted = ids.join(F.broadcast(several) if several.count() <= BROADCAST_IDS else several, "fp", "left_semi").select("_id", "_tag", "fp").distinct()
    wanted = stored(wanted, "grouped")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = _with(base, side).select("fp", canonical_text(F.col("_text")).alias("canon"))
    texts = texts.groupBy("fp", "canon").agg(F.count("*").alias("c"))
    collided = texts.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp").checkpoint()
    if not collided.take(1):
        return ids
    again = ids.join(collided, "fp", "left_semi").select("_id", "_tag", "fp").distinct()
    texts = _with(base, again).select("_id", "_tag", "fp", canonical_text(F.col("_text")).alias("canon"))
    order = Window.partitionBy("fp").orderBy("canon")  # digests that collided, a few texts each
    split = texts.select("fp", "canon").distinct().withColumn("k", F.row_number().over(order) - 1)
    suffix = texts.join(split, ["fp", "canon"]).select("_id", "_tag", F.when(F.col("k") > 0, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise("").alias("sfx"))
    fixed = _with(ids, suffix.distinct(), "left").select("_id", "_tag", "n", F.concat("fp", F.coalesce("sfx", F.lit(""))).alias("fp"))
    return stored(fixed, "digests")


def _with(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (_id, _tag), null ids being equal."""
    right = right.withColumnsRenamed({"_id": "_rid", "_tag": "_rtag"})
    return left.join(right, F.col("_id").eqNullSafe(F.col("_rid")) & F.col("_tag").eqNullSafe(F.col("_rtag")), how).drop("_rid", "_rtag")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its id, ``n_chars`` (code points) and ``fingerprint``.

    Texts whose canonical forms are equal byte for byte have equal fingerprints, and no others. A null text is empty.
    Repeated rows and rows with a null id are kept, each with its result. Other columns are ignored.
    """
    base = _base(docs, id_col, text_col)
    return _fingerprints(base).select(F.col("_id").alias(id_col), F.col("n").alias("n_chars"), F.col("fp").alias("fingerprint"))


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_tag"), text.alias("_text"))


def _neighbours(ids: DataFrame) -> DataFrame:
    """Of (_id, _tag): each key with the next and the previous key (nid, ntag, pid, ptag), in a ring.

    Keys are range-partitioned; only the first and last key of each partition meet in one task.
    """
    spark = ids.sparkSession
    dealt = ids.select("_id", "_tag").distinct().repartitionByRange(n_partitions(spark), "_id", "_tag")
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()), "order")
    own = Window.partitionBy("part").orderBy(F.col("_id").asc_nulls_first(), "_tag")
    key = F.struct("_id", "_tag")
    ends = dealt.groupBy("part").agg(F.min(F.struct(F.coalesce(F.col("_id").isNotNull(), F.lit(False)), "_id", "_tag")).alias("f"), F.max(F.struct(F.col("_id").isNotNull(), "_id", "_tag")).alias("l"))
    parts = Window.orderBy("part")  # one row for each partition
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("f").over(parts), F.first("f").over(whole)).alias("after"),
        F.coalesce(F.lag("l").over(parts), F.last("l").over(whole)).alias("before"),
    )
    inner = dealt.select("_id", "_tag", "part", F.lead(key).over(own).alias("nx"), F.lag(key).over(own).alias("pv"))
    pick = lambda got, end, c: F.when(F.col(got).isNotNull(), F.col(got)[c]).otherwise(F.col(end)[c])
    return inner.join(ends, "part").select(
        "_id", "_tag", pick("nx", "after", "_id").alias("nid"), pick("nx", "after", "_tag").alias("ntag"), pick("pv", "before", "_id").alias("pid"), pick("pv", "before", "_tag").alias("ptag")
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited form of it.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all) of the next document's, by
    ascending id (after the last: the first). Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Fingerprints are exact, so likeness is 1.0 for equal ones and else 0.0.
    Null texts are empty, null ids come first, equal ids are ordered by a hash of their text, and rows equal in
    both are one document, repeated in the result. A single document is its own next one.
    """
    base = _base(docs, id_col, text_col)
    ids = _fingerprints(base)
    repeats = bool(ids.groupBy("_id", "_tag").count().where("count > 1").take(1))
    links = _neighbours(ids)
    facts = ids.distinct()
    links = _with(links, facts.select("_id", "_tag", "fp"))
    for ours, theirs, what, name in (("nid", "ntag", "fp", "nfp"), ("pid", "ptag", "n", "pn")):
        side = facts.select(F.col("_id").alias("_oid"), F.col("_tag").alias("_otag"), F.col(what).alias(name))
        links = links.join(side, F.col(ours).eqNullSafe(F.col("_oid")) & (F.col(theirs) == F.col("_otag"))).drop("_oid", "_otag")
    links = stored(links, "links")
    n = F.length("_text")
    heads = _with(base, links.select("_id", "_tag", "pid", "ptag", "pn")).select(
        F.col("pid").alias("_id"), F.col("ptag").alias("_tag"), F.substring("_text", F.lit(1), (F.col("pn") / 4).cast("int")).alias("head")
    )
    if repeats:
        heads = heads.dropDuplicates(["_id", "_tag"])
    both = _with(_with(base, links.select("_id", "_tag", "fp", "nfp")), heads)
    edited = F.concat(F.substring("_text", F.lit(1), n - (n / 4).cast("int")), F.col("head"))
    both = both.select("_id", "_text", n.cast("long").alias("n"), "fp", "nfp", edited.alias("edited"))
    both = both.withColumn("canon", canonical_text(F.col("edited"))).withColumn("digest", wide_digest(F.col("canon")))
    same = F.substring("fp", 1, 32) == F.col("digest")
    same = F.when(same, F.col("canon") == canonical_text(F.col("_text"))).otherwise(False)  # bytes decide
    both = both.withColumn("same", same)
    return both.select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        F.when(F.col("same"), F.col("fp")).otherwise(F.col("digest")).alias("edited_fingerprint"),
        F.col("same").cast("double").alias("near_edited"),
        (F.col("fp") == F.col("nfp")).cast("double").alias("near_next"),
    )
