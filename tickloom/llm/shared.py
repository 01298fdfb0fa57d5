"""The shared folder, intermediate tables, and settings that every operator here relies on."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows sent to a Python worker at once; documents are a few KB, so a batch is a few MB.
ROWS_PER_BATCH = 1024
#: Pieces of a partition that a task takes one after the other.
PIECES = 8
#: Bits for each key that ``flagged`` looks for, and its bits in all (64 MB); with more keys it only flags more rows.
KEY_BITS, MOST_BITS = 16, 1 << 29


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one of our own.

    Only a session on one machine, such as a test, may leave it out; on a cluster that raises ValueError.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="tickloom-shared-")
        spark.conf.set("spark.checkpoint.dir", given)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is deleted when the driver ends."""
    sc = spark.sparkContext
    path = f"{shared_folder(spark)}/tickloom/{sc.applicationId}"
    if getattr(sc, "_tickloom_folder", None) != path:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(p)
        files.deleteOnExit(p)
        sc._tickloom_folder = path
    return path


def prepare(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, and sets their batch size unless the session has chosen one."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read back.

    This cuts the lineage: a lost executor costs no recomputation, and several readers share one pass. The table lasts as long
    as the application.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` returned and that nothing will read again, and the shuffle files that nothing refers to any more.

    Spark deletes shuffle files when the driver's JVM finds by its garbage collection that they are of no use; while it has
    memory left that may be never.
    """
    sc = tables[0].sparkSession.sparkContext
    for t in tables:
        p = sc._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    sc._jvm.System.gc()


def flagged(df: DataFrame, keys: list[Column], wanted: DataFrame, of: list[Column], flag: str) -> DataFrame:
    """``df`` with a boolean column: true if its keys are those of a row of ``wanted``, and by chance for about a row in 70; false else.

    A sketch of the wanted keys (two bits for each) goes to all tasks, so that a large table can be cut down before it is
    joined. Keys compare by type and value; null is a key like others.
    """
    spark = df.sparkSession
    prepare(spark)
    n_bits = min(MOST_BITS, 1 << max(16, (KEY_BITS * wanted.count()).bit_length()))

    def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.view(np.uint64)
        return (h & np.uint64(n_bits - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(n_bits - 1)).astype(np.int64)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(places(b.column(0).to_numpy()))).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary())], names=["at"])

    bits = np.zeros(n_bits // 8, np.uint8)
    for row in wanted.select(F.xxhash64(*of).alias("h")).mapInArrow(worker(packed), "at binary").collect():  # 8 bytes a key
        at = np.frombuffer(row["at"], np.uint32)
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    sketch = spark.sparkContext.broadcast(bits)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sketch.value
        for b in batches:
            seen = [marks[x >> 3] >> (x & 7).astype(np.uint8) & 1 for x in places(b.column(b.num_columns - 1).to_numpy())]
            cols = [*b.columns[:-1], pa.array((seen[0] & seen[1]).astype(bool))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], flag])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.withColumn(flag, F.xxhash64(*keys)).mapInArrow(worker(look), f"{shape}, `{flag}` boolean")


def n_partitions(spark: SparkSession) -> int:
    """Into how many parts keyed work is dealt; the session sizes this to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Memo:
    """Remembers values by key; of ``most`` at most, those asked for lately. A value is never None.

    Keys are kept in two halves. When the young half is full it becomes the old one, which is let go of, and keys found in the
    old half become young again. So a worker that has seen much remembers as well as one that has seen little.
    """

    def __init__(self, most: int) -> None:
        self.half = max(1, most // 2)
        self.young: dict = {}
        self.old: dict = {}

    def revived(self, keys: list) -> list:
        """The values of keys that are not young, None where they are not known."""
        found = list(map(self.old.get, keys))
        self.add({k: v for k, v in zip(keys, found, strict=True) if v is not None})
        return found

    def add(self, values: dict) -> None:
        self.young.update(values)
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}


#: What a Python worker keeps from task to task: of one operator at a time.
_kept: dict[tuple, object] = {}


def worker(run: Callable, name: str | None = None, make: Callable | None = None, *how) -> Callable:
    """``run`` for mapInArrow, given what ``make(*how)`` makes as a second argument, if ``make`` is given.

    A worker makes it once, keeps it for its next tasks, and lets go of it when a task with another name comes. After a
    task its freed memory goes back to the system, so that workers that wait don't hold it.
    """
    key = (name, *how)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name is not None and key not in _kept:
            _kept.clear()
            gc.collect()
            if make is not None:
                _kept[key] = make(*how)
        yield from run(batches, _kept[key]) if make is not None else run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    return task


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """The rows of sorted batches, those of one key together."""
    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if r[key] != now:
                if held:
                    yield now, held
                now, held = r[key], []
            held.append(r)
    if held:
        yield now, held
