"""Session helpers: cutting lineage, dense numbering and size-checked broadcasts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which an id or item table is broadcast.
BROADCAST_ROWS = 1_000_000
#: Numbers of a table of vectors that the driver writes at a time.
SLICE_NUMBERS = 1_600_000
#: Width of the key ranges that dense numbering counts in.
RANGE_BITS = 20


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir. Sets a folder of its own only in local mode (tests), where there are no other machines;
    elsewhere the setting must be given."""
    sc = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not re.match(r"local(\[|$)", sc.master or ""):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which all executors share."""
    checkpoint_dir(spark)
    return str(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: ends the lineage of iterative plans."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Lets Spark delete the shuffle files of a write when it ends, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The table as written to the shared folder, and a function that deletes it there. Its shuffles leave no files behind."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}", spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)

    def drop() -> None:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)

    return spark.read.schema(df.schema).parquet(path), drop


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint behind a check of the number of rows; larger tables are joined by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def dense_index(df: DataFrame, key: str, ties: list[str], name: str = "internal", start: int = 0) -> DataFrame:
    """Numbers rows start, start + 1, ... in order of (key, *ties), key being a non-negative long. Ranges of the key are
    numbered in parallel and shifted by the counts of the ranges before; only one row a range meets in one task."""
    block = F.shiftright(F.col(key), RANGE_BITS)
    rows = df.withColumn("__block", block)
    counts = rows.groupBy("__block").agg(F.count("*").alias("__n"))
    before = counts.select("__block", (F.sum("__n").over(Window.orderBy("__block")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__block").orderBy(key, *ties))
    return rows.withColumn("__place", place).join(F.broadcast(before), "__block").withColumn(name, (F.col("__before") + F.col("__place") + F.lit(start - 1)).cast("long")).drop("__block", "__place", "__before")


def calm_blas() -> None:
    """One thread for NumPy's bundled BLAS in this process: its threads can wait for each other forever in a process that
    has forked, as a Spark driver has, and tasks share cores anyway."""
    import ctypes
    import glob
    import os

    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)


def give_back() -> None:
    """Returns freed memory of this process to the system: a Python worker keeps what earlier tasks have used, else."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(lib := ctypes.CDLL(None), "malloc_trim"):
        lib.malloc_trim(0)


def free_driver(spark: SparkSession) -> None:
    """Has the driver collect its garbage, Python's first: broadcasts and shuffles of tables that nobody has are then deleted, and
    memory goes back to the system."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # type: ignore[union-attr]
    give_back()


def table_of(spark: SparkSession, values: object, name: str) -> DataFrame:
    """A one-column table of ids: from a DataFrame (its column of that name, or its only one) or a collection."""
    if isinstance(values, DataFrame):
        column = name if name in values.columns else values.columns[0]
        return values.select(F.col(column).alias(name))
    items = list(values)  # type: ignore[call-overload]
    kind: T.DataType = T.LongType()
    if items and isinstance(items[0], str):
        kind = T.StringType()
    return spark.createDataFrame([(x if isinstance(x, str) else int(x),) for x in items], T.StructType([T.StructField(name, kind)]))


def vectors_table(spark: SparkSession, names: list | pa.Array, vectors: np.ndarray, kind: T.DataType, biases: np.ndarray | None = None) -> DataFrame:
    """id, factors and, if given, bias, of arrays on the driver: written in slices of packed numbers, so that the driver never
    holds them as rows of Python floats."""
    from pyspark.sql.pandas.types import to_arrow_type

    width = vectors.shape[1]
    schema = T.StructType([T.StructField("id", kind), T.StructField("factors", T.ArrayType(T.DoubleType())), *[T.StructField("bias", T.DoubleType())] * (biases is not None)])
    slices, size = [], max(1, SLICE_NUMBERS // max(1, width))
    for at in range(0, max(1, len(names)), size):
        part, own = np.ascontiguousarray(vectors[at : at + size], dtype=float), names[at : at + size]
        table = {"id": own.cast(to_arrow_type(kind)) if isinstance(own, pa.Array) else pa.array(own, to_arrow_type(kind)), "factors": pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(part.ravel()))}
        if biases is not None:
            table["bias"] = pa.array(biases[at : at + size].astype(float))
        slices.append(cut(spark.createDataFrame(pa.table(table), schema)))
    out = slices[0]
    for x in slices[1:]:
        out = out.unionAll(x)
    return out


def in_order(values: DataFrame, start: int = 0) -> tuple[DataFrame, int]:
    """The distinct values of a table of one column, numbered start, start + 1, ... in ascending order in a column `i`, and how many
    they are. Partitions of a sort are counted and shifted, so neither the driver nor one task ever holds the values."""
    name = values.columns[0]
    rows, drop = store(values.distinct().orderBy(name).select(name, F.monotonically_increasing_id().alias("__m")))
    part = F.shiftright("__m", 33)
    before, n = [], 0
    for p, count in sorted(rows.groupBy(part).count().collect()):  # a row for each partition of the sort
        before.append((p, n))
        n += count
    shifts = values.sparkSession.createDataFrame(before, "__part long, __n long")
    out = cut(rows.join(F.broadcast(shifts), part == F.col("__part")).select(name, (F.col("__n") + F.col("__m") - F.shiftleft("__part", 33) + start).cast("int").alias("i")))
    drop()
    return out, n


def vectors_of(numbers: DataFrame, vectors: np.ndarray, biases: np.ndarray | None = None) -> DataFrame:
    """id, factors and, if given, bias of a table of ids and their row numbers `i`: written by tasks, to which the arrays are
    broadcast as they are, so that the driver holds no row of them."""
    spark, (name, _) = numbers.sparkSession, numbers.columns
    sent, width = spark.sparkContext.broadcast((vectors, biases)), vectors.shape[1]
    schema = T.StructType([T.StructField("id", numbers.schema[name].dataType), T.StructField("factors", T.ArrayType(T.DoubleType())), *[T.StructField("bias", T.DoubleType())] * (biases is not None)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own, own_biases = sent.value
        for batch in batches:
            i = batch.column(1).to_numpy()
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * width), pa.array(own[i].astype(float).ravel()))]
            yield pa.RecordBatch.from_arrays([*columns, *([] if own_biases is None else [pa.array(own_biases[i].astype(float))])], schema.fieldNames())

    out, _ = store(numbers.mapInArrow(run, schema))
    sent.destroy()
    return out


def md5_long(*parts: Column | str) -> Column:
    """60 bits of the MD5 of the parts' texts joined by '|': a pseudo-random long that any engine computes alike."""
    columns: Iterable[Column] = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in columns])), 1, 15), 16, 10).cast("long")
