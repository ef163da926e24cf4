"""Objects of a volume whose chunks arrive over time, detected as they come.

python -m jobs.detect_arrivals --input DIR --output DIR --checkpoint DIR [--settings FILE]

Each run takes the files that are new since the last one (a file stream with a checkpoint), detects the objects of their chunks in
one pass, and brings the totals of the layers that have changed up to date:

    objects/batch=N/layer=L   one row per object of the chunks of batch N
    chunks/batch=N            one row per chunk of batch N, also of those without an object
    totals/layer=L            chunks, objects, volume and brightness of a layer

A batch that is run again after a failure replaces its own folders. A chunk that arrives again, because it was stitched anew,
takes the place of what was known of it: its last batch counts, and in one batch the newest file. Runs without new files change
nothing, and any division of the same files into runs gives the same objects and totals.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log, read_or_empty
from stratavox.operators.objects import threshold_objects
from stratavox.runtime import counted, restored, seen
from stratavox.sources.arrays import blocks_of_arrays
from stratavox.streaming.live import stream_table

OBJECTS = "cz int, cy int, cx int, label long, z long, y long, x long, count long, volume long, sum_intensity double, batch long, layer int"
CHUNKS = "cz int, cy int, cx int, batch long"
TOTALS = "upto long, chunks long, objects long, volume long, sum_intensity double, layer int"


def newest(batch: DataFrame) -> DataFrame:
    """(id, values): one row per chunk of a batch. Only chunks that came more than once are grouped: the newest file counts, then
    its name, then the values."""
    ids = batch.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if ids.isEmpty():
        return batch.select("id", "values")
    place = F.struct("time", "name", F.xxhash64("values"))
    twice = batch.join(ids, "id", "left_semi").groupBy("id").agg(F.max_by("values", place).alias("values"))
    return batch.join(ids, "id", "left_anti").select("id", "values").unionByName(twice)


def detect(batch: DataFrame, epoch: int, output: str, s: Mapping[str, Any]) -> None:
    """The objects and chunks of one batch, each in a folder of the batch alone."""
    gy, gx = s["grid"]
    read, taken = counted(batch)
    rows = newest(read.where("id is not null and values is not null"))
    found = threshold_objects(blocks_of_arrays(rows, "id", "values", s["chunk"], s["grid"], s["offset"], s["scale"]), s["foreground"], s["chunk"], (1, gy, gx))
    objects, made = counted(found.withColumn("layer", F.col("cz")), volume=F.col("volume"))
    objects.write.mode("overwrite").partitionBy("layer").parquet(f"{output}/objects/batch={epoch}")
    place = rows.select("id").selectExpr(f"cast(id div {gy * gx} as int) AS cz", f"cast(id div {gx} % {gy} as int) AS cy", f"cast(id % {gx} as int) AS cx")
    place.write.mode("overwrite").parquet(f"{output}/chunks/batch={epoch}")
    log.info("batch %s: read %s chunks, wrote %s objects of %s voxels", epoch, seen(taken, "rows"), seen(made, "rows"), seen(made, "volume"))


def current_chunks(spark: SparkSession, output: str) -> DataFrame:
    """(cz, cy, cx, batch): each chunk with its last batch."""
    return read_or_empty(spark, f"{output}/chunks", CHUNKS).groupBy("cz", "cy", "cx").agg(F.max("batch").alias("batch"))


def current_objects(spark: SparkSession, output: str, layers: DataFrame | None = None) -> DataFrame:
    """Objects of the last batch of each chunk, of some layers or of all."""
    found = read_or_empty(spark, f"{output}/objects", OBJECTS)
    if layers is not None:
        found = found.join(layers, "layer", "left_semi")
    return found.join(current_chunks(spark, output), ["cz", "cy", "cx", "batch"], "left_semi")


def update_totals(spark: SparkSession, output: str) -> int:
    """Totals of the layers with a batch that they don't include yet; their number. Each layer carries the last batch that it
    includes, so an update that failed is made up for by the next run."""
    chunks = current_chunks(spark, output)
    layers = chunks.groupBy(F.col("cz").alias("layer")).agg(F.max("batch").alias("upto"), F.count("*").alias("chunks"))
    known = read_or_empty(spark, f"{output}/totals", TOTALS).select("layer", F.col("upto").alias("had"))
    stale = layers.join(known, "layer", "left").where("had is null or had < upto").drop("had")
    sums = current_objects(spark, output, stale.select("layer")).groupBy("layer").agg(F.count("*").alias("objects"), F.sum("volume").alias("volume"), F.sum("sum_intensity").alias("sum_intensity"))
    made = stale.join(sums, "layer", "left").na.fill(0, ["objects", "volume", "sum_intensity"])
    rows, wrote = counted(made.select("upto", "chunks", "objects", "volume", "sum_intensity", "layer"))
    # read and written at once: the rows are staged before their own partitions are replaced
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer").parquet(f"{output}/totals")
    return seen(wrote, "rows")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, s: Mapping[str, Any]) -> int:
    """Take what is new, wait for its end, and bring the totals up to date; returns the number of layers that changed."""
    with restored(spark):
        arrived = stream_table(spark, f"{source.rstrip('/')}/{s['table']}", s["files_per_batch"])
        rows = arrived.select(F.col(s["id"]).alias("id"), F.col(s["values"]).alias("values"), F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_name").alias("name"))
        stream = rows.writeStream.foreachBatch(lambda batch, epoch: detect(batch, epoch, output, s)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()
        changed = update_totals(spark, output)
    log.info("%s batches with new files, %s layers brought up to date in %s", sum(p["numInputRows"] > 0 for p in stream.recentProgress), changed, output)
    return changed


def read_output(spark: SparkSession, output: str) -> DataFrame:
    """All objects as they stand, each with the totals of its layer."""
    totals = read_or_empty(spark, f"{output}/totals", TOTALS).select("layer", F.col("chunks").alias("layer_chunks"), F.col("objects").alias("layer_objects"), F.col("volume").alias("layer_volume"))
    return current_objects(spark, output).join(totals, "layer").drop("batch")


if __name__ == "__main__":
    command_line(__file__, __doc__, lambda spark, args, s: run(spark, args.input, args.output, args.checkpoint, s), "checkpoint")
