"""From recorded sessions to the store: discover, label, resolve, decode, rasterise, and training samples from the store."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import vector_entry
from ..operators import asof as A
from ..operators import cycles as C
from ..operators import frames as R
from ..shipping import ship
from ..sources import topics
from . import store as P

#: Cameras whose images are stored unless others are named.
CAMERAS = ("oakd_front", "oakd_back")


def _shape(longs: str = "", doubles: str = "", texts: str = "") -> T.StructType:
    kinds = ((longs, T.LongType()), (doubles, T.DoubleType()), (texts, T.StringType()))
    return T.StructType([T.StructField(c, t) for names, t in kinds for c in names.split()])


CYCLES = _shape("timestamp_us cycle_id velocity_timestamp_us velocity_seq", "", "outcome status")
FRONTIER = _shape("timestamp_us cycle_id", "", "provenance")
COMMANDS = _shape("timestamp_us cycle_id", "desired_linear_velocity desired_angular_velocity")
EXECUTED = _shape("timestamp_us", "", "source")
VELOCITY = _shape("timestamp_us seq", "", "linear_velocity angular_velocity")


def session_name(session: str) -> str:
    return posixpath.basename(session.rstrip("/"))


def load_session(spark: SparkSession, session: str, max_age: int | dict[str, int] = C.MAX_AGE_US) -> tuple[DataFrame, DataFrame]:
    """A session's labelled cycles, with action and measured velocity, and the roles of their frontier rows by (session, run_id, cycle_id)."""
    name = F.lit(session_name(session))

    def read(topic: str, shape: T.StructType) -> DataFrame:
        return topics.read_topic(spark, session, topic, shape).withColumn("session", name).withColumnRenamed("timestamp_us", "tick")

    cycles, frontier, commands = read(topics.PLANNING, CYCLES), read(topics.FRONTIER, FRONTIER), read(topics.COMMAND, COMMANDS)
    if not topics.topic_chunks(spark, session, topics.COMMAND) or "cycle_id" not in commands.columns:
        raise ValueError(f"{session}: commands have no cycle_id: this recording lacks the instrumentation")
    commands = commands.select("session", "ord", "tick", "cycle_id", F.col("desired_linear_velocity").alias("linear"), F.col("desired_angular_velocity").alias("angular"))
    executed = read(topics.EXECUTED, EXECUTED).select("session", "ord", "tick", "source")
    velocity = read(topics.VELOCITY, VELOCITY)
    velocity = velocity.select("session", "ord", "seq", vector_entry(F.col("linear_velocity"), 0).alias("v_linear"), vector_entry(F.col("angular_velocity"), 2).alias("v_angular"))
    wanted = cycles.select("session", "ord", "tick", "cycle_id", "outcome", "status", "velocity_seq")
    labelled = C.commanded(C.with_proprio(C.label_drops(wanted, frontier, commands, executed), velocity))
    bounds = C.run_bounds(C.segment_runs(wanted))
    placed = C.assign_run(frontier.select("session", "ord", "tick", "cycle_id"), bounds).where("run_id >= 0").select("session", "ord", "run_id")
    seen = frontier.drop("tick").join(placed, ["session", "ord"])
    seen = seen.join(labelled.select(*P.KEYS, "tick"), P.KEYS)  # a capture's age counts from its cycle's tick
    return labelled, C.unpivot_roles(seen, P.KEYS, max_age)


def gathered(kept: DataFrame, roles: DataFrame, frames: DataFrame, tolerance: int = P.MATCH_US) -> DataFrame:
    """The packets that a camera's cycles refer to, once each: (session, frame_ord) by the first strategy that serves all distinct captures."""
    seen = roles.join(kept.select(*P.KEYS), P.KEYS, "left_semi").where("present").select("session", "capture_us").distinct()
    got = A.resolve_frames(seen, frames.select("session", "ts", "ord"), ["session"], tolerance)
    return got.where("frame_ord IS NOT NULL").select("session", "frame_ord").distinct()


def camera_images(spark: SparkSession, channel: str, frames: DataFrame, wanted: DataFrame, decoder: R.Decoder, finish: Callable) -> DataFrame:
    """(session, frame_ord, dtype, shape, pixels) of the wanted packets of a channel; only groups that hold one are read, each once."""
    marked = frames.join(wanted.select("session", F.col("frame_ord").alias("ord"), F.lit(True).alias("wanted")), ["session", "ord"], "left").fillna(False, ["wanted"])
    needed = marked.where("wanted").select("bin_path").distinct()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(channel).select(F.col("path").alias("bin_path"), "content")
    images = R.decode_groups(files.join(needed, "bin_path", "left_semi"), marked, ["bin_path"], decoder, info=("codec", "width", "height", "extradata", "quantisation"), finish=finish)
    return images.join(marked.select("bin_path", "frame_index", "session", F.col("ord").alias("frame_ord")), ["bin_path", "frame_index"]).drop("bin_path", "frame_index")


def _write_part(df: DataFrame, store: str, name: str, **keys: str) -> DataFrame:
    """Writes one part of a table and reads it back."""
    path = "/".join([store, name, *(f"{k}={v}" for k, v in keys.items())])
    df.drop(*keys).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def preprocess_session(
    spark: SparkSession, session: str, store: str, rgb: R.Decoder | None = None, depth: R.Decoder | None = None, sensor_version: str = "v4_1",
    rgb_cameras: tuple[str, ...] = CAMERAS, depth_cameras: tuple[str, ...] = CAMERAS, rgb_size: tuple[int, int] = P.RGB_SIZE, depth_size: tuple[int, int] = P.DEPTH_SIZE,
) -> dict:
    """Adds a session to the store: cycles, camera indexes, images, occupancy and manifest; returns the manifest.

    rgb, depth: decoders (see frames.Decoder); without one the images of that kind are neither decoded nor indexed. A camera
    whose role the frontier lacks is left out.
    """
    ship(spark)
    name = session_name(session)
    labelled, roles = load_session(spark, session)
    labelled = _write_part(labelled.drop("session"), store, "labelled", session=name).withColumn("session", F.lit(name))
    roles = _write_part(roles.drop("session"), store, "roles", session=name).withColumn("session", F.lit(name))
    kept = labelled.where("drop_reason IS NULL")
    have = {r["role"] for r in roles.select("role").distinct().collect()}  # a row for each role of one session
    cameras = {}
    plans = [(c, topics.rgb_role(c), topics.rgb_channel, R.RGB_CODEC, rgb, R.rgb_finish(*rgb_size)) for c in rgb_cameras]
    plans += [(c, topics.depth_role(c), topics.depth_channel, R.DEPTH_CODEC, depth, R.depth_finish(*depth_size)) for c in depth_cameras]
    for camera, role, place, codec, decoder, finish in plans:
        if decoder is None or role not in have:
            continue
        channel = place(spark, session, camera)
        frames = topics.index_groups(spark, channel, codec).withColumn("session", F.lit(name))
        frames = _write_part(frames, store, "packets", session=name, camera=role).withColumn("session", F.lit(name))
        wanted = gathered(kept, roles.where(F.col("role") == role), frames)
        if frames.take(1):
            images = _write_part(camera_images(spark, channel, frames, wanted, decoder, finish), store, "images", session=name, camera=role)
            decoded = images.select(F.col("frame_ord").alias("ord"), F.lit(True).alias("decoded"))
            frames = frames.join(decoded, "ord", "left").fillna(False, ["decoded"])
        else:
            frames = frames.withColumn("decoded", F.lit(False))
        cameras[role] = frames.select("session", "ts", "ord", "decoded")
    scans = {r: topics.read_lidar(spark, session, r, sensor_version).withColumn("session", F.lit(name)) for r in R.LIDAR_ROLES if r in have}
    P.preprocess(labelled, store, roles, cameras, scans, sensor_version, rgb_size, depth_size)
    hits = [lidar_matches(kept, roles, r, s) for r, s in scans.items()]
    none = kept.select(*P.KEYS).limit(0).withColumn("points", F.array().cast("array<struct<x: float, y: float>>"))
    grid = R.bev(kept, reduce(DataFrame.unionByName, hits, none), P.KEYS)
    _write_part(grid, store, "bev", session=name)
    return P.read_manifest(spark, store, name)


def lidar_matches(kept: DataFrame, roles: DataFrame, role: str, scans: DataFrame, tolerance: int = P.MATCH_US) -> DataFrame:
    """(session, run_id, cycle_id, points) of the kept cycles whose lidar role resolved to a scan, by sequence number, else causal as-of."""
    mine = roles.where((F.col("role") == role) & F.col("present")).join(kept.select(*P.KEYS), P.KEYS, "left_semi")
    got = A.key_then_asof(mine.select(*P.KEYS, F.col("capture_us").alias("ts"), "seq"), scans, ["session"], "seq", ["points"], tolerance)
    return got.where("m IS NOT NULL").select(*P.KEYS, F.col("m.points").alias("points"))


def samples(spark: SparkSession, store: str, pairs: DataFrame, rgb_roles: tuple[str, ...], depth_roles: tuple[str, ...], rgb_size: tuple[int, int] = P.RGB_SIZE, depth_size: tuple[int, int] = P.DEPTH_SIZE) -> DataFrame:
    """Training samples of pairs (session, run_id, cycle_i, cycle_j): tensors as little-endian bytes.

    rgb: float32 (2, cameras, 3, height, width); depth: (2, cameras, 2, height, width); bev: (2, 1, 120, 120); action: the first
    cycle's, normalised over the store's pairs' first cycles; proprio: (2, 2); t_us: int64 (2). With no camera of a kind there
    is one of zeros. Images meet their pair by shuffles on its key; a task holds one pair at a time.
    """
    ship(spark)
    key = ["session", "run_id", "cycle_i"]
    cycles = P.read_table(spark, store, "cycles").select(*P.KEYS, "tick", "linear", "angular", "v_linear", "v_angular")
    cycles = cycles.join(P.read_table(spark, store, "bev").select(*P.KEYS, "cells"), P.KEYS)
    pairs = pairs.select(*key, "cycle_j")
    first = pairs.select("session", "run_id", F.col("cycle_i").alias("cycle_id")).join(cycles, P.KEYS)
    stats = C.action_stats(first, ["linear", "angular"])
    ends = pairs.select(*key, F.posexplode(F.array("cycle_i", "cycle_j")).alias("step", "cycle_id"))
    rows = C.normalised(ends.join(cycles, P.KEYS), stats, ["linear", "angular"])
    order = [*rgb_roles, *depth_roles]
    if order:
        index = P.read_table(spark, store, "index").where(F.col("camera").isin(*order) & (F.col("position") >= 0)).select(*P.KEYS, "camera", "frame_ord")
        images = P.read_table(spark, store, "images").where(F.col("camera").isin(*order)).select("session", "camera", "frame_ord", "dtype", "shape", "pixels")
        seen = ends.join(index, P.KEYS).join(images, ["session", "camera", "frame_ord"])
        seen = seen.groupBy(*key).agg(F.collect_list(F.struct("step", "camera", "dtype", "shape", "pixels")).alias("images"))  # two for each camera
    both = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("step", "tick", "linear", "angular", "v_linear", "v_angular", "cells"))).alias("ends"))
    both = both.join(seen, key) if order else both.withColumn("images", F.array().cast("array<struct<step: int, camera: string, dtype: string, shape: array<int>, pixels: binary>>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                (w, h), (dw, dh) = rgb_size, depth_size
                rgb, depth = np.zeros((2, max(1, len(rgb_roles)), 3, h, w), np.float32), np.zeros((2, max(1, len(depth_roles)), 2, dh, dw), np.float32)
                for x in r["images"]:
                    image = np.frombuffer(x["pixels"], x["dtype"]).reshape(x["shape"])
                    if x["camera"] in rgb_roles:
                        rgb[x["step"], rgb_roles.index(x["camera"])] = R.rgb_channels(image)
                    else:
                        depth[x["step"], depth_roles.index(x["camera"])] = R.depth_channels(image)
                e = r["ends"]
                tensors = (rgb, depth, np.stack([R.dense_bev(x["cells"])[None] for x in e]).astype(np.float32), np.array([e[0]["linear"], e[0]["angular"]], np.float32), np.array([[x["v_linear"], x["v_angular"]] for x in e], np.float32), np.array([x["tick"] for x in e], np.int64))
                out.append([*(r[k] for k in key), *(t.tobytes() for t in tensors)])
            yield pd.DataFrame(out, columns=[*key, "rgb", "depth", "bev", "action", "proprio", "t_us"])

    return both.mapInPandas(run, "session string, run_id long, cycle_i long, rgb binary, depth binary, bev binary, action binary, proprio binary, t_us binary")


def diagnose(spark: SparkSession, channel: str, decoder: R.Decoder | None = None) -> tuple[DataFrame, DataFrame]:
    """The loss report of a channel's groups, and the undecodable packets at or after their group's first gap. Without a decoder none counts as undecodable."""
    frames = topics.index_groups(spark, channel, R.RGB_CODEC).withColumn("ord", F.col("frame_index"))
    sizes = frames.groupBy("bin_path").agg(F.first("size").alias("size"))
    if decoder is None:
        bad = frames.limit(0)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(channel).select(F.col("path").alias("bin_path"), "content")
        decoded = R.decode_groups(files, frames.withColumn("wanted", F.lit(True)), ["bin_path"], decoder, stop_at_torn=False, info=("codec", "width", "height", "extradata", "quantisation"))
        bad = R.undecodable_packets(frames, decoded, ["bin_path"])
    report = R.group_report(frames, ["bin_path"], sizes, bad)
    return report, R.cascade(bad, report, ["bin_path"])
