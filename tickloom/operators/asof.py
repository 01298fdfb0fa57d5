"""Exact, nearest and as-of joins by union and window.

Right and left rows are unioned, sorted by (by, time bucket, ts, side, ord), and each left row takes the last right row before it, or the
first after it, which is the last before it in the opposite order: one shuffle on the keys, no row multiplication, and running
aggregates only. With a tolerance, time is cut into buckets of ``SPAN`` tolerances, and right rows within a tolerance of a
bucket's ends stand in the next bucket too; so a session that holds a third of all rows is spread over as many tasks as it
has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time bucket in tolerances; a right row in so many stands in two buckets.
SPAN = 4096


def matched(left: DataFrame, right: DataFrame, by: list[str], payload: list[str], ts: str = "ts", order: str = "ord", sides: tuple[str, ...] = ("back", "strict_back", "ahead"), tolerance: int | None = None) -> DataFrame:
    """Adds to each left row those asked for of the structs ``back`` (last right row at or before ts), ``strict_back`` (before) and ``ahead`` (first at or after).

    Each holds ts, ord, the payload, and for ``strict_back`` ``prev``, the right row before it. Ties: the last written wins
    backward and the first forward. tolerance: rows farther away may be missing; what is nearer is found.
    """
    kept = [c for c in left.columns if c not in by]
    keys = list(by)
    body = F.struct(F.col(ts).alias("ts"), F.col(order).alias("ord"), *[F.col(c) for c in payload])
    r = right.where(F.col(ts).isNotNull()).select(*by, F.col(ts).alias("_ts"), F.col(order).alias("_ord"), body.alias("_row"))
    q = left.select(*by, F.col(ts).alias("_ts"), F.struct(*kept).alias("_q"))
    if tolerance is not None:
        width = F.lit(max(1, tolerance) * SPAN)
        place = lambda c: F.floor(c / width)
        reach = F.lit(tolerance)
        r = r.withColumn("_bucket", F.explode(F.sequence(place(F.col("_ts") - reach), place(F.col("_ts") + reach))))
        q = q.withColumn("_bucket", place(F.col("_ts")))
        keys.append("_bucket")
    if "strict_back" in sides:
        r = r.withColumn("_prev", F.lag("_row").over(Window.partitionBy(*keys).orderBy("_ts", "_ord")))
        r = r.withColumn("_m", F.struct(F.col("_row").alias("row"), F.col("_prev").alias("prev"))).drop("_row", "_prev")
    else:
        r = r.withColumn("_m", F.struct(F.col("_row").alias("row"))).drop("_row")
    both = q.withColumn("_m", F.lit(None).cast(r.schema["_m"].dataType)).withColumn("_ord", F.lit(None).cast(r.schema["_ord"].dataType)).unionByName(r.withColumn("_q", F.lit(None).cast(q.schema["_q"].dataType)))
    is_left = F.col("_q").isNotNull()
    late, early = F.when(is_left, 1).otherwise(0), F.when(is_left, 0).otherwise(1)
    orders = {
        "back": (F.col("_ts"), late, F.col("_ord")),
        "strict_back": (F.col("_ts"), early, F.col("_ord")),
        "ahead": (F.col("_ts").desc(), early.desc(), F.col("_ord").desc()),
    }
    for side in sides:
        w = Window.partitionBy(*keys).orderBy(*orders[side]).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn(side, F.last("_m", ignorenulls=True).over(w))
    return both.where(is_left).select(*by, *[F.col("_q")[c].alias(c) for c in kept], *sides)


def asof(left: DataFrame, right: DataFrame, by: list[str], payload: list[str], tolerance: int | None = None, direction: str = "backward", ts: str = "ts", order: str = "ord") -> DataFrame:
    """Each left row with ``m``, the right row at or before it (or at or after), null beyond the tolerance."""
    side = "back" if direction == "backward" else "ahead"
    got = matched(left, right, by, payload, ts, order, (side,), tolerance)
    m = F.col(side)["row"]
    fine = m.isNotNull() if tolerance is None else F.abs(m["ts"] - F.col(ts)) <= tolerance
    return got.select(*left.columns, F.when(fine, m).alias("m"))


def exact(left: DataFrame, right: DataFrame, by: list[str], payload: list[str], ts: str = "ts", order: str = "ord") -> DataFrame:
    """Each left row with ``m``, the first written right row of the same time."""
    lowest = right.groupBy(*by, ts).agg(F.min(F.struct(F.col(order).alias("ord"), *[F.col(c) for c in payload])).alias("m"))
    return left.join(lowest, [*by, ts], "left").select(*left.columns, "m")


def nearest(left: DataFrame, right: DataFrame, by: list[str], payload: list[str], tolerance: int, ts: str = "ts", order: str = "ord") -> DataFrame:
    """Each left row with ``m``, the right row nearest in time within the tolerance; the earlier of two equally near.

    Past the last right row, if its time is repeated, the one before it is taken.
    """
    last = right.where(F.col(ts).isNotNull()).groupBy(*by).agg(F.max(ts).alias("_last"))  # a row for each key
    got = matched(left, right, by, payload, ts, order, ("strict_back", "ahead"), tolerance).join(last, by, "left")
    b, f, t = F.col("strict_back"), F.col("ahead"), F.col(ts)
    lone = F.when((t > F.col("_last")) & b["prev"].isNotNull() & (b["prev"]["ts"] == b["row"]["ts"]), b["prev"]).otherwise(b["row"])
    m = F.when(f.isNull(), lone).when(b.isNull(), f["row"]).when(t - b["row"]["ts"] <= f["row"]["ts"] - t, b["row"]).otherwise(f["row"])
    return got.select(*left.columns, F.when(F.abs(m["ts"] - t) <= tolerance, m).alias("m"))


def modal_offset(left: DataFrame, right: DataFrame, by: list[str], tolerance: int, ts: str = "ts", order: str = "ord") -> DataFrame:
    """For each key the commonest delta to the next right row (or the last), of those within the tolerance; ties: the smallest; 0: none."""
    last = right.where(F.col(ts).isNotNull()).groupBy(*by).agg(F.max(ts).alias("_last"))  # a row for each key
    got = matched(left.select(*by, ts), right, by, [], ts, order, ("ahead",), tolerance).join(last, by, "left")
    delta = F.coalesce(F.col("ahead")["row"]["ts"], F.when(F.col(ts) > F.col("_last"), F.col("_last"))) - F.col(ts)
    got = got.select(*by, delta.alias("d")).where(F.abs("d") <= tolerance)
    counts = got.groupBy(*by, "d").count()  # pre-aggregated, so a hot key is a row for each delta
    best = counts.groupBy(*by).agg(F.max(F.struct("count", (-F.col("d")).alias("nd"))).alias("m"))
    return best.select(*by, F.when(F.col("m.nd") != 0, -F.col("m.nd")).alias("offset"))


def key_then_asof(left: DataFrame, right: DataFrame, by: list[str], key: str, payload: list[str], tolerance: int, ts: str = "ts", order: str = "ord") -> DataFrame:
    """Each left row with ``m``: the last written right row of the same key, else the causal as-of row."""
    row = F.struct(F.col(ts).alias("ts"), F.col(order).alias("ord"), *[F.col(c) for c in payload])
    last = right.where(f"{key} >= 0").groupBy(*by, key).agg(F.max(F.struct(F.col(order).alias("o"), row.alias("r")))["r"].alias("k"))
    got = asof(left, right, by, payload, tolerance, ts=ts, order=order).join(last, [*by, key], "left")
    return got.select(*left.columns, F.coalesce("k", "m").alias("m"))


def resolve_frames(wanted: DataFrame, frames: DataFrame, by: list[str], tolerance: int) -> DataFrame:
    """Frames for capture times by the first strategy that serves all of a key: exact, constant offset, else causal as-of for all.

    wanted: by, capture_us (negative: unwanted). frames: by, ts, ord. Columns: by, capture_us, frame_ord (null: none), strategy,
    offset_us, residual_us, match_rate (of wanted rows; 0.0 if none).
    """
    q = wanted.select(*by, F.col("capture_us").alias("ts"))
    asked = q.where("ts >= 0").distinct()
    offset = modal_offset(q.where("ts >= 0"), frames, by, tolerance)  # a time counts as often as it is wanted
    first = frames.groupBy(*by, "ts").agg(F.min("ord").alias("o"))
    tried = asof(asked, frames, by, [], tolerance).join(offset, by, "left")
    tried = tried.join(first.withColumnRenamed("o", "eo"), [*by, "ts"], "left")
    shifted = first.select(*by, (F.col("ts")).alias("st"), F.col("o").alias("so"))
    tried = tried.withColumn("st", F.col("ts") + F.col("offset")).join(shifted, [*by, "st"], "left")
    plan = tried.groupBy(*by).agg(F.bool_and(F.col("eo").isNotNull()).alias("all_exact"), F.bool_and(F.col("so").isNotNull()).alias("all_shifted"))
    tried = tried.join(plan, by)
    kind = F.when(F.col("all_exact"), "exact").when(F.col("all_shifted"), "constant_offset").otherwise("approximate")
    tried = tried.withColumn("strategy", kind).withColumn("frame_ord", F.when(F.col("strategy") == "exact", F.col("eo")).when(F.col("strategy") == "constant_offset", F.col("so")).otherwise(F.col("m.ord")))
    residual = F.when(F.col("strategy") == "exact", 0).when(F.col("strategy") == "constant_offset", F.col("offset")).otherwise(F.col("ts") - F.col("m.ts"))
    tried = tried.select(*by, "ts", "strategy", "frame_ord", F.when(F.col("strategy") == "constant_offset", F.col("offset")).alias("offset_us"), F.when(F.col("frame_ord").isNotNull(), residual).cast("long").alias("residual_us"))
    per = tried.groupBy(*by).agg(F.first("strategy").alias("strategy"), F.first("offset_us").alias("offset_us"))
    out = q.join(tried.drop("strategy", "offset_us"), [*by, "ts"], "left").join(per, by, "left")
    rate = q.where("ts >= 0").join(tried, [*by, "ts"]).groupBy(*by).agg(F.avg(F.col("frame_ord").isNotNull().cast("int")).alias("match_rate"))
    out = out.join(rate, by, "left")
    return out.select(*by, F.col("ts").alias("capture_us"), "frame_ord", F.coalesce("strategy", F.lit("approximate")).alias("strategy"), "offset_us", "residual_us", F.coalesce("match_rate", F.lit(0.0)).alias("match_rate"))


def none_as(c: Column, sentinel: int = -1) -> Column:
    """Nulls as the sentinel of the outer interface."""
    return F.coalesce(c, F.lit(sentinel))
