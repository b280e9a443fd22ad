"""Restartable ingest: files or tables that arrive are condensed once, and a ledger keeps the latest state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import file_books


def ingest_files(spark: SparkSession, landing: str, out: str, checkpoint: str) -> StreamingQuery:
    """Every file of the landing folder becomes a row of the books table at ``out``, once, also after a restart."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", "*.*").load(landing)

    def batch(arrived: DataFrame, number: int) -> None:
        file_books(arrived.select("path", "content")).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a file or a folder of files, as a stream: the file source watches the folder above it."""
    folder, _, name = path.rstrip("/").rpartition("/")
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema)
    return stream.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else stream.parquet(path)


def latest_states(events: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """The last event of each key per day, as a watermarked aggregation."""
    return (
        events.withColumn(at, F.col(at).cast("timestamp"))
        .withWatermark(at, delay)
        .groupBy(F.window(at, "1 day").alias("day"), key)
        .agg(F.max_by("event_type", at).alias("event_type"), F.count("*").alias("n"))
        .select(F.col("day.start").alias("day"), key, "event_type", "n")
    )


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that is there now, through the stream, into a table in memory (for tests and reports)."""
    spark = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def work_through(chunks: DataFrame, condense: Callable[[DataFrame], DataFrame], ledger: str, number: int) -> None:
    """A foreachBatch body: outputs of a batch of chunks are written under the batch's number before anything reads them."""
    condense(chunks).write.mode("overwrite").parquet(f"{ledger}/batch={number}")
