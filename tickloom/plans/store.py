"""The materialised store of sessions: cycles, camera indexes and a manifest, as Parquet partitioned by session; pairs are made on reading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof as A
from ..operators import cycles as C
from ..operators.frames import LIDAR_ROLES

#: The manifest's schema version and where its actions come from.
VERSION, ACTION_SOURCE = 1, "commanded_cycle"
#: Sizes (width, height) of stored images, the limit of matches in microseconds.
RGB_SIZE, DEPTH_SIZE, MATCH_US = (253, 190), (160, 100), 50_000
KEYS = ["session", "run_id", "cycle_id"]


def write_table(df: DataFrame, store: str, name: str) -> None:
    """Writes a table of the store; only the sessions in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(f"{store}/{name}")


def read_table(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{store}/{name}").withColumn("session", F.col("session").cast("string"))


def read_manifest(spark: SparkSession, store: str, session: str) -> dict:
    """A session's manifest by name, sorted. Raises KeyError if the store has none."""
    row = read_table(spark, store, "manifest").where(F.col("session") == session).first()
    if row is None:
        raise KeyError(session)
    return dict(sorted(row.asDict(recursive=True).items()))


def manifest_json(spark: SparkSession, store: str) -> DataFrame:
    """(session, json): each manifest as JSON text with sorted keys; ``read_json_manifest`` reads it back."""
    rows = read_table(spark, store, "manifest")
    return rows.select("session", F.to_json(F.struct(*sorted(rows.columns))).alias("json"))


def read_json_manifest(texts: DataFrame, like: DataFrame) -> DataFrame:
    """Of (json): manifests with the columns of ``like``."""
    return texts.select(F.from_json("json", like.schema).alias("m")).select("m.*")


def camera_index(kept: DataFrame, roles: DataFrame, frames: DataFrame, tolerance: int = MATCH_US) -> tuple[DataFrame, DataFrame]:
    """For each kept cycle the ``position`` of a camera's frame among those decoded (-1: none), and rates for each session.

    roles: the camera's rows; frames: session, ts, ord (unique in a session) and, if known, decoded.
    """
    seen = roles.join(kept.select(*KEYS), KEYS, "left_semi").where("present").select(*KEYS, "capture_us")
    known = frames if "decoded" in frames.columns else frames.withColumn("decoded", F.lit(True))
    got = A.resolve_frames(seen.select("session", "capture_us").distinct(), frames.select("session", "ts", "ord"), ["session"], tolerance)
    got = got.join(known.select("session", F.col("ord").alias("frame_ord"), F.col("decoded").alias("_ok")), ["session", "frame_ord"], "left")
    rates = got.groupBy("session").agg(F.first("strategy").alias("strategy"), F.first("match_rate").alias("match"), F.avg(F.when(F.col("frame_ord").isNotNull(), F.coalesce("_ok", F.lit(False)).cast("int"))).alias("decode"))
    rates = roles.select("session").distinct().join(rates, "session", "left")
    rates = rates.select("session", F.coalesce("strategy", F.lit("approximate")).alias("strategy"), F.coalesce("match", F.lit(0.0)).alias("match"), F.coalesce("decode", F.lit(1.0)).alias("decode"))
    places = C.compacted(got, ["session"], F.coalesce("_ok", F.lit(False)), "capture_us").select("session", "capture_us", "frame_ord", "position")
    index = kept.select(*KEYS).join(seen.join(places, ["session", "capture_us"]), KEYS, "left")
    return index.select(*KEYS, "frame_ord", F.coalesce("position", F.lit(-1).cast("long")).alias("position")), rates


def lidar_hits(kept: DataFrame, roles: DataFrame, scans: dict[str, DataFrame], tolerance: int = MATCH_US) -> DataFrame:
    """A row for each kept cycle and lidar role that resolved to a scan (session, ts, seq, ord): by sequence number, else causal as-of."""
    seen = roles.where("present").join(kept.select(*KEYS), KEYS, "left_semi").withColumn("ts", F.col("capture_us"))
    out = roles.sparkSession.createDataFrame([], seen.select(*KEYS, "role").schema)
    for role, rows in scans.items():
        mine = seen.where(F.col("role") == role).select(*KEYS, "role", "ts", "seq")
        out = out.unionByName(A.key_then_asof(mine, rows, ["session"], "seq", [], tolerance).where("m IS NOT NULL").select(*KEYS, "role"))
    return out


def manifest(labelled: DataFrame) -> DataFrame:
    """A row for each session: planned and kept (``n_cycles``) cycles, runs, and the map of drops, zeros included."""
    drops = [x for r in C.REASONS for x in (F.lit(r), F.count_if(F.coalesce(F.col("drop_reason") == r, F.lit(False))))]
    per = labelled.groupBy("session").agg(F.count("*").alias("n_planned"), F.count_if(F.col("drop_reason").isNull()).alias("n_cycles"), F.countDistinct("run_id").alias("n_runs"), F.create_map(*drops).alias("dropped"))
    return per.withColumns({"schema_version": F.lit(VERSION), "action_source": F.lit(ACTION_SOURCE)})


def preprocess(
    labelled: DataFrame, store: str, roles: DataFrame | None = None, cameras: dict[str, DataFrame] | None = None, lidar: dict[str, DataFrame] | None = None,
    sensor_version: str = "v4_1", rgb_size: tuple[int, int] = RGB_SIZE, depth_size: tuple[int, int] = DEPTH_SIZE, tolerance: int = MATCH_US,
) -> None:
    """Writes the kept cycles with ``lidar_valid``, each camera's index and the manifest.

    roles: unpivot_roles by session, run_id, cycle_id; cameras: frames by role (rgb_front, depth_back, ...); lidar: scans by role. A
    cycle is valid in lidar if any role resolved; without lidar none is, and no pair can be made.
    """
    S.to_robot(F.lit(0), F.lit(0), "lidar_front_left", sensor_version)  # an unknown version raises here
    cameras, lidar = cameras or {}, lidar or {}
    if roles is None and (cameras or lidar):
        raise ValueError("cameras and lidar need the roles of the frontier")
    kept = labelled.where("drop_reason IS NULL").drop("drop_reason")
    about = manifest(labelled)
    hits = lidar_hits(kept, roles, lidar, tolerance) if roles is not None else None
    valid = hits.select(*KEYS).distinct().withColumn("lidar_valid", F.lit(True)) if hits is not None else kept.select(*KEYS).limit(0).withColumn("lidar_valid", F.lit(True))
    cycles = kept.join(valid, KEYS, "left").withColumn("lidar_valid", F.coalesce("lidar_valid", F.lit(False)))
    write_table(cycles, store, "cycles")
    about = about.join(cycles.groupBy("session").agg(F.avg(F.col("lidar_valid").cast("int")).alias("lidar_valid_rate")), "session", "left").fillna(0.0, ["lidar_valid_rate"])
    empty = F.create_map().cast("map<string, double>")
    if roles is not None:
        had = roles.where(F.col("role").isin(*LIDAR_ROLES)).select("session", "role").distinct()
        counts = had.join(hits.groupBy("session", "role").agg(F.count("*").alias("n")), ["session", "role"], "left").join(about.select("session", "n_cycles"), "session")
        rate = F.when(F.col("n_cycles") > 0, F.coalesce("n", F.lit(0)) / F.col("n_cycles")).otherwise(0.0)
        maps = counts.groupBy("session").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", rate.alias("rate"))))).alias("lidar_match_rate"))
        about = about.join(maps, "session", "left").withColumn("lidar_match_rate", F.coalesce("lidar_match_rate", empty))
    else:
        about = about.withColumn("lidar_match_rate", empty)
    order = F.array(*map(F.lit, LIDAR_ROLES))
    about = about.withColumn("lidar_roles_configured", F.filter(order, lambda r: F.array_contains(F.map_keys("lidar_match_rate"), r)))
    indexes, rates = [], []
    for role, frames in cameras.items():
        index, rate = camera_index(kept, roles.where(F.col("role") == role), frames, tolerance)
        indexes.append(index.withColumn("camera", F.lit(role)))
        rates.append(rate.withColumn("camera", F.lit(role)))
    if indexes:
        write_table(reduce(DataFrame.unionByName, indexes), store, "index")
    for kind in ("rgb", "depth"):
        own = [r for r in cameras if r.startswith(f"{kind}_")]
        names = {"join_strategy": ("strategy", "string"), "match_rate": ("match", "double"), "decode_rate": ("decode", "double")}
        if own:
            entry = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("camera", c))))
            mine = reduce(DataFrame.unionByName, rates).where(F.col("camera").isin(*own))
            about = about.join(mine.groupBy("session").agg(*[entry(c).alias(f"{kind}_{n}") for n, (c, _) in names.items()]), "session", "left")
        for n, (_, t) in names.items():
            none = F.create_map().cast(f"map<string, {t}>")
            about = about.withColumn(f"{kind}_{n}", F.coalesce(f"{kind}_{n}", none) if own else none)
        about = about.withColumn(f"{kind}_cameras", F.array(*map(F.lit, own)).cast("array<string>"))
    sizes = {"rgb_size": rgb_size, "depth_size": depth_size, "bev_shape": (S.BEV_CELLS, S.BEV_CELLS)}
    about = about.withColumns({k: F.array(*map(F.lit, v)) for k, v in sizes.items()})
    write_table(about.withColumn("sensor_version", F.lit(sensor_version)), store, "manifest")


def training_set(spark: SparkSession, store: str, fraction: float = 0.15, step: int = C.STEP, period: int = C.CYCLE_US, jitter: int = C.JITTER_US, cameras: list[str] | None = None) -> DataFrame:
    """Pairs with their split: by session if there are several, else by run. Both cycles need lidar and a frame of every camera (default: its session's own)."""
    cycles = read_table(spark, store, "cycles")
    own = read_table(spark, store, "manifest").select("session", F.concat("rgb_cameras", "depth_cameras").alias("_c"))
    if cameras is not None:
        own = own.withColumn("_c", F.array(*map(F.lit, cameras)).cast("array<string>"))
    cycles = cycles.join(own, "session")
    if own.where("size(_c) > 0").take(1):
        seen = read_table(spark, store, "index").where("position >= 0").groupBy(*KEYS).agg(F.collect_set("camera").alias("_seen"))
        cycles = cycles.join(seen, KEYS, "left")
    else:
        cycles = cycles.withColumn("_seen", F.array().cast("array<string>"))
    missing = F.size(F.array_except("_c", F.coalesce("_seen", F.array().cast("array<string>"))))
    pairs = C.step_pairs(cycles, step, period, jitter, F.col("lidar_valid") & (missing == 0))
    counts = pairs.groupBy("session").agg(F.count("*").alias("n"))
    if len(counts.take(2)) > 1:
        return pairs.join(C.split_by_session(counts, fraction).drop("n"), "session")
    return C.split_by_run(pairs, fraction, step)


def batches(pairs: DataFrame, seed: int | None = None) -> DataFrame:
    """Pairs in random order by a seed, or in order of time."""
    keys = ["session", "run_id", "cycle_i"]
    return pairs.orderBy(F.xxhash64(F.lit(seed), *keys), *keys) if seed is not None else pairs.orderBy(*keys)
