"""Frame groups: sidecars, losses, decoding behind a protocol, lidar points and occupancy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..shipping import ship

SIDECAR = (
    "struct<encoding: string, codec: string, width: int, height: int, extradata: string, horizon_m: double, step_mm: int, "
    "frames: array<struct<timestamp_us: long, seq: long, length: long>>>"
)

# Lidar roles, two half scans for each of four frames.
LIDAR_FRAMES = ("lidar_front_left", "lidar_front_right", "lidar_back_left", "lidar_back_right")
LIDAR_ROLES = tuple(f"lidar_{r}" for r in ("front_left_front", "front_left_left", "front_right_right", "front_right_front", "back_left_left", "back_left_back", "back_right_back", "back_right_right"))
#: Codecs of sidecars that name none, by kind of camera.
RGB_CODEC, DEPTH_CODEC = "h265", "ffv1"


def sidecar_frames(meta: DataFrame, by: list[str], default_codec: str = "") -> DataFrame:
    """A row for each packet of sidecars (by, meta: JSON text), with the group's codec and quantisation; broken sidecars are skipped."""
    g = meta.select(*by, F.from_json("meta", SIDECAR).alias("g")).where("g.frames IS NOT NULL")
    quant = F.when(F.col("g.step_mm").isNotNull(), F.struct(F.col("g.horizon_m").alias("horizon_m"), F.col("g.step_mm").alias("step_mm")))
    rows = g.select(*by, "g.width", "g.height", S.codec_name(F.coalesce("g.encoding", "g.codec", F.lit(default_codec))).alias("codec"), F.unbase64("g.extradata").alias("extradata"), quant.alias("quantisation"), F.posexplode("g.frames"))
    return rows.select(*by, "width", "height", "codec", "extradata", "quantisation", F.col("pos").cast("long").alias("frame_index"), F.col("col.timestamp_us").alias("ts"), F.coalesce("col.seq", F.lit(-1).cast("long")).alias("seq"), F.col("col.length").alias("length"))


def group_report(frames: DataFrame, by: list[str], sizes: DataFrame | None = None, undecodable: DataFrame | None = None) -> DataFrame:
    """For each group: packets declared, their bytes, gaps in seq, frames lost in them, and the first number lost in the first gap.

    sizes (by, size: bytes of the file) adds ``bytes_actual`` and ``truncated`` (the file has other bytes than declared); groups without
    a file are left out. undecodable (by, ...: a row for each packet, see undecodable_packets) adds their number.
    """
    w = Window.partitionBy(*by).orderBy("ord")
    rows = frames.withColumn("_prev", F.lag("seq").over(w)).withColumn("_gap", F.col("seq") - F.col("_prev"))
    rows = rows.withColumn("_lost", F.when(F.col("_gap") > 1, F.col("_gap") - 1).otherwise(0))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("declared"), F.sum("length").alias("bytes"), F.sum((F.col("_lost") > 0).cast("long")).alias("gaps"), F.sum("_lost").cast("long").alias("lost"),
        F.min(F.when(F.col("_lost") > 0, F.struct("ord", (F.col("_prev") + 1).alias("seq"))))["seq"].alias("first_gap"),
    )
    if sizes is not None:
        out = out.join(sizes.select(*by, F.col("size").alias("bytes_actual")), by).withColumn("truncated", F.col("bytes") != F.col("bytes_actual"))
    if undecodable is not None:
        out = out.join(undecodable.groupBy(*by).agg(F.count("*").alias("undecodable")), by, "left").fillna(0, ["undecodable"])
    return out


def undecodable_packets(frames: DataFrame, decoded: DataFrame, by: list[str]) -> DataFrame:
    """The packets of which decode_groups, with all of them wanted, gave no image."""
    return frames.join(decoded.select(*by, "frame_index").distinct(), [*by, "frame_index"], "left_anti")


def fleet_summary(report: DataFrame) -> DataFrame:
    """Over all groups (declared, gaps, lost, undecodable, truncated): counts and the net share lost, in percent."""
    lost = F.sum(F.col("lost") + F.col("undecodable"))
    base = F.sum(F.col("declared") + F.col("lost"))
    return report.agg(F.count("*").alias("groups"), F.count_if(F.col("gaps") > 0).alias("with_gaps"), F.sum("lost").alias("lost"), F.count_if("truncated").alias("truncated"), F.when(base > 0, lost / base * 100).otherwise(0.0).alias("net_percent"))


def cascade(undecodable: DataFrame, report: DataFrame, by: list[str]) -> DataFrame:
    """The undecodable packets at or after their group's first gap."""
    return undecodable.join(report.select(*by, "first_gap"), by).where(F.col("seq") >= F.col("first_gap")).drop("first_gap")


#: Decodes packets (bytes) of a group to arrays; None where a packet can't be decoded. Codecs are not part of this library.
Decoder = Callable[[list[bytes], dict], list["np.ndarray | None"]]


def decode_groups(groups: DataFrame, frames: DataFrame, by: list[str], decoder: Decoder, stop_at_torn: bool = True, info: tuple[str, ...] = (), finish: Callable[[np.ndarray, dict], np.ndarray] | None = None) -> DataFrame:
    """Decodes each group (by, content) once; frames: by, frame_index, length, wanted. Rows (by, frame_index, dtype, shape, pixels) of wanted frames decoded.

    Packets follow each other in the file; from the first that does not fit on they are torn and left out, or, if asked, cut short.
    info: columns of frames, equal in a group, that the decoder and ``finish`` get besides the keys. finish: what becomes of
    each decoded image. A task holds one group's packets and images.
    """
    ship(groups.sparkSession)
    about = [F.first(c).alias(c) for c in info]
    listed = frames.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("frame_index", "length", "wanted"))).alias("packets"), *about).where(F.exists("packets", lambda p: p["wanted"]))
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.select(*by).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                at, blobs, index, out = 0, [], [], []
                known = {k: r[k] for k in (*by, *info)}
                for p in r["packets"]:
                    if stop_at_torn and at + p["length"] > len(r["content"]):
                        break
                    blobs.append(bytes(r["content"][at : at + p["length"]]))
                    index.append(p)
                    at += p["length"]
                for p, image in zip(index, decoder(blobs, known), strict=True):
                    if p["wanted"] and image is not None:
                        image = image if finish is None else finish(image, known)
                        out.append([*(r[k] for k in by), p["frame_index"], str(image.dtype), list(image.shape), np.ascontiguousarray(image).tobytes()])
                yield pd.DataFrame(out, columns=[*by, "frame_index", "dtype", "shape", "pixels"])

    return groups.select(*by, "content").join(listed, by).mapInPandas(run, f"{keys}, frame_index long, dtype string, shape array<int>, pixels binary")


def rgb_finish(width: int, height: int) -> Callable[[np.ndarray, dict], np.ndarray]:
    """Colour images at this size."""
    return lambda image, _: resized(image, width, height, True)


def depth_finish(width: int, height: int) -> Callable[[np.ndarray, dict], np.ndarray]:
    """Depth in millimetres at this size; groups without a quantisation hold millimetres already."""

    def finish(image: np.ndarray, info: dict) -> np.ndarray:
        q = info.get("quantisation")
        return resized(image if q is None else dequantise_plane(image, int(q["step_mm"])), width, height, False)

    return finish


def dequantise_plane(units: np.ndarray, step_mm: int) -> np.ndarray:
    """Millimetres of a uint16 plane of quantised depth; another type raises TypeError."""
    if units.dtype != np.uint16:
        raise TypeError(f"expected uint16, got {units.dtype}")
    u = np.minimum(units.astype(np.int64), S.MAX_UNIT)
    return np.where(u < max(1, S.GUARD_MM // step_mm), 0, np.minimum(u * step_mm, S.MAX_MM)).astype(np.uint16)


def resized(image: np.ndarray, width: int, height: int, smooth: bool) -> np.ndarray:
    """The image at another size: bilinear (pixel centres) if smooth, else nearest; itself if the size is the same."""
    h, w = image.shape[:2]
    if (w, h) == (width, height):
        return image
    y, x = (np.arange(height) + 0.5) * h / height, (np.arange(width) + 0.5) * w / width
    if not smooth:
        return image[np.minimum(y.astype(int), h - 1)][:, np.minimum(x.astype(int), w - 1)]
    y, x = np.clip(y - 0.5, 0, h - 1), np.clip(x - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    if image.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    v = image.astype(np.float64)
    out = (v[y0][:, x0] * (1 - fx) + v[y0][:, x1] * fx) * (1 - fy) + (v[y1][:, x0] * (1 - fx) + v[y1][:, x1] * fx) * fy
    return np.rint(out).astype(image.dtype)


def lidar_points(scans: DataFrame, version: str = "v4_1") -> DataFrame:
    """Adds ``points`` in the robot's frame to scans (frame_id, x, y: comma lists). Returns at the mount (0, 0) are dropped before the transform."""
    xy = F.filter(F.arrays_zip(S.float_list(F.col("x")).alias("x"), S.float_list(F.col("y")).alias("y")), lambda p: (p["x"] != 0) | (p["y"] != 0))

    def moved(frame: str) -> Column:
        return F.transform(xy, lambda p: F.struct(*[c.alias(n) for c, n in zip(S.to_robot(p["x"], p["y"], frame, version), "xy", strict=True)]))

    S.to_robot(F.lit(0), F.lit(0), LIDAR_FRAMES[0], version)  # an unknown version raises here
    out = F.raise_error(F.concat(F.lit("unknown frame_id "), F.col("frame_id"))).cast("array<struct<x: float, y: float>>")
    for frame in LIDAR_FRAMES:
        out = F.when(F.col("frame_id") == frame, moved(frame)).otherwise(out)
    return scans.withColumn("points", out)


def occupied_cells(points: DataFrame, by: list[str]) -> DataFrame:
    """The sorted distinct grid cells (row * 120 + column) that points (by, x, y) of each key fall into; deduplicated before they are gathered."""
    row, col = S.bev_cell(F.col("x")), S.bev_cell(F.col("y"))
    inside = row.between(0, S.BEV_CELLS - 1) & col.between(0, S.BEV_CELLS - 1)
    cells = points.where(inside).select(*by, (row * S.BEV_CELLS + col).alias("cell")).distinct()
    return cells.groupBy(*by).agg(F.sort_array(F.collect_list("cell")).alias("cells"))  # 14400 at most


def bev(cycles: DataFrame, matched_scans: DataFrame, by: list[str]) -> DataFrame:
    """For each cycle its ``cells`` (empty if none) and ``valid``: whether any role resolved to a scan, even without points."""
    points = matched_scans.select(*by, F.explode("points").alias("p")).select(*by, "p.x", "p.y")
    some = matched_scans.select(*by).distinct().withColumn("valid", F.lit(True))
    out = cycles.select(*by).join(some, by, "left").join(occupied_cells(points, by), by, "left")
    return out.select(*by, F.coalesce("cells", F.array().cast("array<int>")).alias("cells"), F.coalesce("valid", F.lit(False)).alias("valid"))


def rgb_channels(image: np.ndarray) -> np.ndarray:
    """A colour image (height, width, 3) of bytes as three planes of floats from 0 to 1."""
    return image.transpose(2, 0, 1).astype(np.float32) / np.float32(255)


def depth_channels(mm: np.ndarray) -> np.ndarray:
    """A plane of millimetres as two planes of floats: the share of the range, and whether there is a reading."""
    metres = mm.astype(np.float32) / np.float32(1000)
    return np.stack([metres / np.float32(S.DEPTH_RANGE_M), (metres > 0).astype(np.float32)])


def dense_bev(cells: list[int]) -> np.ndarray:
    """The occupancy grid of a list of cells."""
    grid = np.zeros(S.BEV_CELLS * S.BEV_CELLS, np.uint8)
    grid[np.asarray(cells, np.int64)] = 1
    return grid.reshape(S.BEV_CELLS, S.BEV_CELLS)
