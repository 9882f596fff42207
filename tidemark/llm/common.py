"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes an Arrow batch holds when whole texts go to Python: bounds the memory of a worker and of the JVM's buffers.
TEXT_BATCH, TEXT_BYTES = 1024, 4 << 20

#: Rows of a written file where their number is known beforehand, and the fewest files of such a table.
FILE_ROWS, FEWEST_FILES = 250_000, 8

#: Rows and bytes up to which a side of a join is broadcast.
BROADCAST_ROWS = 1_000_000

#: Maps a byte to its lower-case form if it belongs to a word (0-9, A-Z, a-z, everything beyond ASCII), else to a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def once(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker makes once and keeps for all its tasks. Functions that travel by value have no module
    to keep it in, so it lives in one of its own."""
    import sys
    import types

    kept = sys.modules.setdefault("_tidemark_kept", types.ModuleType("_tidemark_kept")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def text_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, in bytes above all, for plans that send whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def release() -> None:
    """Gives memory that a worker has freed back to the system; workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases its memory at the end of a task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share. A temporary one only in local mode (tests), where
    there are no other machines; elsewhere the setting must be given."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not there:
        if not re.match(r"local(\[|$)", sc.master or ""):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(there)
    return there.rstrip("/")


#: Tables that cut() has written in this process.
_written: list[str] = []


def cut(df: DataFrame, rows: int | None = None, **options: object) -> DataFrame:
    """Writes a table to the shared folder and reads it again: the lineage ends there, and lost executors cost no
    recomputation. `rows`, if known, bounds the table's rows and so its number of files, which grows with them; `options`
    are the writer's. Results stand on these tables; tidy() deletes them when no result is needed any more."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(FEWEST_FILES, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Deletes the tables that cut() has written, through Hadoop's file systems."""
    paths = list(_written)
    _written.clear()
    _delete(spark, paths)


def mark() -> int:
    """A point in the list of written tables; see drop_since."""
    return len(_written)


def drop_since(spark: SparkSession, point: int) -> None:
    """Deletes the tables written since a mark but for the last one, which holds what was made of them."""
    last = _written.pop()
    old, _written[point:] = _written[point:], [last]
    _delete(spark, old)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for x in paths:
        path = jvm.org.apache.hadoop.fs.Path(x)  # type: ignore[union-attr]
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_key(column: str) -> Column:
    """128 bits that stand for a text where rows are judged by their texts; null for null."""
    return F.unhex(F.md5(F.col(column).cast("binary")))


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` (fixed-width) rows; else as it is, for a shuffled join."""
    rows = df.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` bytes of text each, one row at least."""
    at, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)
