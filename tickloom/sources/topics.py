"""Recorded sessions: discovery, delimited topic chunks, frame group sidecars."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import chunk_start
from ..operators.frames import LIDAR_ROLES, lidar_points, sidecar_frames

# Topic names.
PLANNING, FRONTIER, COMMAND = "navigation/planning_cycle", "navigation/sensor_frontier", "navigation/command"
EXECUTED, VELOCITY = "ll_executed_command", "robot/velocity_estimate"


def topic_slug(topic: str) -> str:
    return topic.replace("/", "_")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, on any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(str(x.getPath().toString()) for x in (found or []))


def data_root(spark: SparkSession, session: str) -> str:
    """Where a session's topics are: its ``data`` folder, in older recordings itself."""
    inner = posixpath.join(session, "data")
    return inner if _exists(spark, inner) else session


def channel_dir(spark: SparkSession, session: str, topic: str) -> str:
    """A topic's folder, or the folder of its first part if that is all there is."""
    root = data_root(spark, session)
    whole = posixpath.join(root, topic)
    first = posixpath.join(root, topic.split("/")[0])
    return whole if _exists(spark, whole) or not _exists(spark, first) else first


def topic_chunks(spark: SparkSession, session: str, topic: str) -> list[str]:
    """A topic's chunk files by the time in their names, those without one first, then by name."""
    found = _listed(spark, posixpath.join(channel_dir(spark, session, topic), f"{topic_slug(topic)}_*.csv"))

    def key(path: str) -> tuple[int, str]:
        name = posixpath.basename(path)
        stamp = name.removesuffix(".csv").rpartition("_")[2]
        return (int(stamp) if len(stamp) == 20 and stamp.isdigit() else -1, name)

    return sorted(found, key=key)


def find_sessions(spark: SparkSession, root: str) -> list[str]:
    """The root itself if it has planning cycles, else its children that have."""
    if topic_chunks(spark, root, PLANNING):
        return [root]
    return [p for p in _listed(spark, posixpath.join(root, "*")) if topic_chunks(spark, p, PLANNING)]


def chunk_header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a chunk, read by the driver from its first line. Raises ValueError if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p), "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    if not line:
        raise ValueError(f"empty chunk {path}")
    return [x.strip('"') for x in line.split(";")]


def read_chunks(spark: SparkSession, paths: list[str], schema: T.StructType, validate: bool = True) -> DataFrame:
    """``;``-delimited chunks in write order, those of one header in one scan; empty cells of text stay empty text, and NA stays NA.

    Adds file_name, chunk_start and ``ord``, which rises with (chunk, row). Columns that a chunk lacks are null; those that
    ``schema`` lacks are text. validate: a query fails at a row whose number of fields is not its header's, whatever
    columns it reads.
    """
    kinds = {f.name: f.dataType for f in schema}
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        by_header.setdefault(tuple(chunk_header(spark, path)), []).append(path)
    places = spark.createDataFrame([(posixpath.basename(p), k) for k, p in enumerate(paths)], "file_name string, _chunk long")
    out = None
    for names, own in by_header.items():
        shape = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in names])
        whole = T.StructType([*shape.fields, T.StructField("_bad", T.StringType())])
        options = {"sep": ";", "header": True, "enforceSchema": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "columnPruning": not validate}
        df = spark.read.options(**options).schema(whole).csv(own)
        if validate:  # a row is also corrupt if a cell is not of its type; only the number of fields counts here
            fields = F.size(F.split("_bad", ';(?=(?:[^"]*"[^"]*")*[^"]*$)', -1))
            wrong = F.col("_bad").isNotNull() & (fields != len(names))
            first = F.coalesce(F.col(f"`{names[0]}`").cast("string"), F.lit(""))  # Spark wants another column than the corrupt record read, too
            said = F.concat(F.col("_metadata.file_name"), F.lit(f": a row does not have the {len(names)} fields of the header; it begins "), first, F.lit(": "), F.col("_bad"))
            df = df.where(F.when(wrong, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))
        # within a chunk rows are numbered from the byte that their part of the file begins at; a row is at least a byte
        row = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        texts = {f.name for f in shape if isinstance(f.dataType, T.StringType)}
        cell = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in texts else F.col(f"`{c}`")  # noqa: E731, B023
        df = df.select(*[cell(c).alias(c) for c in names], F.col("_metadata.file_name").alias("file_name"), row.alias("_row"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    out = out.withColumn("chunk_start", chunk_start(F.col("file_name"))).join(F.broadcast(places), "file_name")  # a row for each chunk that the driver has listed
    return out.withColumn("ord", F.col("_chunk") * (1 << 44) + F.col("_row")).drop("_chunk", "_row")


def read_topic(spark: SparkSession, session: str, topic: str, schema: T.StructType, validate: bool = True) -> DataFrame:
    """All chunks of a topic in write order (see read_chunks). An absent topic has no rows; missing columns are null."""
    paths = topic_chunks(spark, session, topic)
    if not paths:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("ord", T.LongType())])).withColumn("session", F.lit(session))
    return read_chunks(spark, paths, schema, validate).withColumn("session", F.lit(session))


#: Columns of a lidar topic that are read.
SCANS = T.StructType([T.StructField("timestamp_us", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("frame_id", T.StringType()), T.StructField("x", T.StringType()), T.StructField("y", T.StringType()), T.StructField("z", T.StringType())])


def lidar_topic(role: str) -> str:
    """The topic of a lidar role: lidar_front_left_front is recorded as lidar2d_front_left_front/points."""
    return f"lidar2d_{role.removeprefix('lidar_')}/points"


def lidar_frame(role: str) -> str:
    """The mount that a lidar role or channel is one half of: lidar_front_left_front is of lidar_front_left."""
    return "lidar_" + role.removeprefix("lidar2d_").removeprefix("lidar_").rpartition("_")[0]


def lidar_roles_of(frame: str) -> list[str]:
    """The two roles of a mount."""
    return [r for r in LIDAR_ROLES if lidar_frame(r) == frame]


def rgb_role(camera: str) -> str:
    """The frontier's role of a colour camera: oakd_front has rgb_front."""
    return f"rgb_{camera.removeprefix('oakd_')}"


def depth_role(camera: str) -> str:
    return f"depth_{camera.removeprefix('oakd_')}"


def rgb_channel(spark: SparkSession, session: str, camera: str) -> str:
    return channel_dir(spark, session, f"camera_{camera}_rgb/image_encoded")


def depth_channel(spark: SparkSession, session: str, camera: str) -> str:
    return channel_dir(spark, session, f"camera_{camera}_mono_l/depth_image")


def read_lidar(spark: SparkSession, session: str, role: str, version: str = "v4_1") -> DataFrame:
    """All scans of a lidar role in write order: session, ts, seq, ord and ``points`` in the robot's frame."""
    scans = read_topic(spark, session, lidar_topic(role), SCANS)
    return lidar_points(scans, version).select("session", F.col("timestamp_us").alias("ts"), "seq", "ord", "points")


def index_groups(spark: SparkSession, channel: str, default_codec: str = "") -> DataFrame:
    """A row for each packet of a channel's groups: bin_path, its size, and what the sidecar says. Broken sidecars and those without a file are skipped.

    ``ord``: the place by time among all of the channel's packets, equal times in order of files and packets.
    """
    if not _listed(spark, posixpath.join(channel, "*.meta.json")):
        empty = sidecar_frames(spark.createDataFrame([], "bin_path string, meta string, size long"), ["bin_path", "size"], default_codec)
        return empty.withColumn("ord", F.lit(0).cast("long"))
    stem = lambda c, end: F.regexp_replace(c, end, "")
    meta = spark.read.text(posixpath.join(channel, "*.meta.json"), wholetext=True).select("value", stem(F.col("_metadata.file_path"), r"\.meta\.json$").alias("stem"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(channel).select(F.col("path").alias("bin_path"), F.col("length").alias("size"))
    files = files.withColumn("stem", stem(F.col("bin_path"), r"\.bin$"))
    norm = lambda df: df.withColumn("stem", F.regexp_replace("stem", "^file:/+", "/"))
    both = norm(meta).join(norm(files), "stem").withColumnRenamed("value", "meta")
    rows = sidecar_frames(both, ["bin_path", "size"], default_codec)
    order = Window.orderBy("ts", "bin_path", "frame_index")  # packets of one channel of one session
    return rows.withColumn("ord", (F.row_number().over(order) - 1).cast("long"))
