"""Chunks and objects that arrive over time.

Regional sums are associative, so they are kept up to date as objects arrive; components across chunks are not and are
taken on the whole label table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratavox.runtime import shared_dir


def stream_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files, or one file of a folder, as a stream, with the schema of what is there."""
    now = spark.read.parquet(path)
    reader = spark.readStream.schema(now.schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    if all(f.rstrip("/").endswith(f"/{name}") for f in now.inputFiles()):  # a file: the source wants its folder
        reader, path = reader.option("pathGlobFilter", name), folder
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def region_totals(cells: DataFrame) -> DataFrame:
    """Running sums per region of a stream of objects; state is one row per region."""
    return cells.where("id is not null").groupBy("id").agg(*[F.sum(c).alias(c) for c in ("count", "volume", "sum_intensity")])


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums in tumbling windows; rows later than the watermark are left out and closed windows leave the state."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"))


def run_to_end(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Process all that is there from the start and return the result table; each call has a checkpoint of its own."""
    spark = df.sparkSession
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def append_cells(blocks: DataFrame, detect, path: str, checkpoint: str) -> StreamingQuery:
    """Objects of each arriving batch of chunks, appended to a Parquet table; a batch that is replayed replaces its own files."""

    def write(batch: DataFrame, epoch: int) -> None:
        detect(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return blocks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
