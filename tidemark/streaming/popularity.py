"""Popularity of items over a stream of interactions, by tumbling event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.runtime import shared_folder
from tidemark.schema import Columns

#: Column that holds the number of the batch which wrote a state.
BATCH = "__batch"


def windowed_popularity(events: DataFrame, size: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """window_start, item_id, n_interactions, sum_weight. On a stream, events later than `lateness` are dropped and a window is
    final once the watermark has passed it; the same plan runs over a batch."""
    marked = events.withWatermark(Columns.Datetime, lateness) if events.isStreaming else events
    counts = marked.groupBy(F.window(Columns.Datetime, size), Columns.Item).agg(F.count("*").alias("n_interactions"), F.sum(Columns.Weight).alias("sum_weight"))
    return counts.select(F.col("window.start").alias("window_start"), Columns.Item, "n_interactions", "sum_weight")


def run_once(spark: SparkSession, path: str, name: str, size: str = "1 day") -> DataFrame:
    """Reads what is in a Parquet table of events as a stream, to its end, and returns the result table. Times without a zone
    are taken, and given back, as UTC; watermarks need times with one. The states lie in the shared folder under `name`."""
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    raw = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)
    events = raw.select(F.col("event_type").alias(Columns.Item), F.col("value").alias(Columns.Weight), F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz")).cast("timestamp").alias(Columns.Datetime))
    counts = windowed_popularity(events, size)
    folder = f"{shared_folder(spark)}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        """A batch that is run again replaces what it wrote before."""
        batch.write.mode("overwrite").parquet(f"{folder}/counts/{BATCH}={number}")

    # Windows that a batch changed are written by its tasks; the latest state of each counts. Nothing passes the driver.
    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema(T.StructType([*counts.schema.fields, T.StructField(BATCH, T.LongType())])).parquet(f"{folder}/counts")
    latest = states.groupBy("window_start", Columns.Item).agg(F.max_by(F.struct("n_interactions", "sum_weight"), BATCH).alias("s")).select("window_start", Columns.Item, "s.*")
    return latest.withColumn("window_start", F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("window_start").cast("timestamp_ntz")))
