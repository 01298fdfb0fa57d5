"""Scalar functions as columns: depth, geometry, codecs, packed cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sensor units and guards, depth scale, grid, codecs, chunk names.
MAX_UNIT, GUARD_MM, MAX_MM, DEPTH_RANGE_M = 1023, 200, 65535, 5.0
BEV_EXTENT_M, BEV_RESOLUTION_M, BEV_CELLS = 6.0, 0.1, 120
HEVC, H264 = ("h265", "hevc"), ("h264", "avc", "avc1", "")
CHUNK_TIME = r"_(\d{20})\.csv$"

# Lidar mounts by sensor version and frame: the rotation's first two rows and columns (c: cos 45 degrees), translation.
_C = 0.5**0.5
MOUNTS = {
    "v3": {
        "lidar_front_left": (_C, -_C, -_C, -_C, 0.428, 0.250),
        "lidar_front_right": (_C, _C, _C, -_C, 0.428, -0.250),
        "lidar_back_left": (-_C, -_C, -_C, _C, -0.428, 0.250),
        "lidar_back_right": (-_C, _C, _C, _C, -0.428, -0.250),
    },
    "v4": {
        "lidar_front_left": (1, 0, 0, 1, 0.452, 0.2547),
        "lidar_front_right": (1, 0, 0, 1, 0.452, -0.2547),
        "lidar_back_left": (-1, 0, 0, -1, -0.452, 0.2547),
        "lidar_back_right": (-1, 0, 0, -1, -0.452, -0.2547),
    },
    "v4_1": {
        "lidar_front_left": (1, 0, 0, 1, 0.448, 0.251),
        "lidar_front_right": (1, 0, 0, 1, 0.448, -0.251),
        "lidar_back_left": (-1, 0, 0, -1, -0.448, 0.251),
        "lidar_back_right": (-1, 0, 0, -1, -0.448, -0.251),
    },
}


def invalid_threshold(step_mm: Column) -> Column:
    """Units below this are no reading: at least 1, and 200 mm."""
    return F.greatest(F.lit(1), F.floor(F.lit(GUARD_MM) / step_mm).cast("int"))


def dequantise_depth(units: Column, step_mm: Column) -> Column:
    """Millimetres of a quantised depth, 0 where there is no reading."""
    u = F.least(units, F.lit(MAX_UNIT))
    return F.when(u < invalid_threshold(step_mm), F.lit(0)).otherwise(F.least(u * step_mm, F.lit(MAX_MM)))


def quantise_depth(mm: Column, step_mm: Column, horizon_units: Column) -> Column:
    """Units of a depth: rounded half to even, or the far sentinel beyond the horizon."""
    far = horizon_units + F.greatest(F.lit(4), F.floor(horizon_units / 8).cast("int"))
    return F.when(mm > horizon_units * step_mm, far).otherwise(F.bround(mm / step_mm).cast("int"))


def depth_metres(mm: Column) -> Column:
    """Depth as a share of the range; the far sentinel stays above 1."""
    return (mm.cast("float") / F.lit(1000.0).cast("float")).cast("float") / F.lit(DEPTH_RANGE_M)


def codec_name(encoding: Column) -> Column:
    e = F.lower(F.coalesce(encoding, F.lit("")))
    return F.when(e.isin(*HEVC), "hevc").when(e.isin(*H264), "h264").otherwise(e)


def chunk_start(name: Column) -> Column:
    """The time in a chunk's file name, -1 if there is none."""
    return F.coalesce(F.regexp_extract(name, CHUNK_TIME, 1).try_cast("long"), F.lit(-1).cast("long"))


def float_list(cell: Column) -> Column:
    """A comma list of numbers as floats; an empty cell is an empty list."""
    return F.when(F.trim(cell) == "", F.array().cast("array<float>")).otherwise(F.transform(F.split(cell, ","), lambda v: F.trim(v).cast("float")))


def vector_entry(cell: Column, k: int) -> Column:
    """Entry k (from 0) of a packed vector, as double; missing entries raise."""
    return F.element_at(F.split(cell, ","), k + 1).cast("double")


def bev_cell(v: Column) -> Column:
    """Row or column of a coordinate on the grid, in single precision throughout; outside 0..119 is off the grid."""
    f = lambda x: F.lit(x).cast("float")
    return F.floor(((v.cast("float") + f(BEV_EXTENT_M)).cast("float") / f(BEV_RESOLUTION_M)).cast("float")).cast("int")


def to_robot(x: Column, y: Column, frame_id: str, version: str = "v4_1") -> tuple[Column, Column]:
    """A lidar point in the robot's frame (double in between, float at the end). An unknown version or frame raises."""
    if version not in MOUNTS:
        raise ValueError(f"unknown sensor version {version!r}; known: {', '.join(MOUNTS)}")
    a, b, c, d, tx, ty = map(float, MOUNTS[version][frame_id])
    x, y = x.cast("double"), y.cast("double")
    return (x * a + y * b + tx).cast("float"), (x * c + y * d + ty).cast("float")
