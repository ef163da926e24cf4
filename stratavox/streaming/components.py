"""Components across chunks kept up to date as labelled chunks arrive.

State is a table of labels with their component's smallest label, in one folder for each batch; a batch that runs again replaces
its own. A new batch meets the old chunks in their faces only, links are drawn between components, not labels, and only labels of
components that merge get a new row. The result doesn't depend on the order or grouping in which chunks arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratavox.operators.components import connected_components
from stratavox.operators.labels import block_face_voxels, block_label_sizes, neighbour_edges
from stratavox.runtime import path_exists, settle, settled_within

FACES, SIZES, ROOTS = "z long, y long, x long, label long, epoch long", "label long, n long, epoch long", "label long, root long, epoch long"


def _before(spark: SparkSession, path: str, schema: str, epoch: int | None) -> DataFrame:
    """A table of the state with what batches before this one have written, or with all."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(path)
    return found if epoch is None else found.where(F.col("epoch") < epoch)


def _roots(spark: SparkSession, state: str, epoch: int | None) -> DataFrame:
    """(label, root) by the last batch that wrote a row of the label; labels without a row are components of their own."""
    return _before(spark, f"{state}/roots", ROOTS, epoch).groupBy("label").agg(F.max_by("root", "epoch").alias("root"))


def merge_batch(labels: DataFrame, epoch: int, state: str, chunk: Sequence[int]) -> None:
    """Take the label blocks of one batch into the state. Chunks arrive once, with labels as label_blocks() gives them."""
    spark = labels.sparkSession
    block_label_sizes(labels).write.mode("overwrite").parquet(f"{state}/sizes/epoch={epoch}")
    block_face_voxels(labels).write.mode("overwrite").parquet(f"{state}/faces/epoch={epoch}")
    new = spark.read.schema("z long, y long, x long, label long").parquet(f"{state}/faces/epoch={epoch}")
    old = _before(spark, f"{state}/faces", FACES, epoch)
    # new faces beside new ones, and beside old ones on either side
    pairs = neighbour_edges(new, chunk)
    for left, right in ((new, old), (old, new)):
        pairs = pairs.unionByName(_between(left, right, chunk))
    pairs = settle(pairs.where("a <> b").distinct(), "links")
    known = _roots(spark, state, epoch)
    root = lambda name: known.select(F.col("label").alias(name), F.col("root").alias(f"root_{name}"))
    edges = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b").distinct()
    merged = settle(connected_components(edges, "a", "b").where("node <> root"), "merged")  # component -> the one it goes into
    members = known.join(merged.select(F.col("node").alias("root"), F.col("root").alias("into")), "root").select("label", F.col("into").alias("root"))
    own = merged.join(known.select(F.col("label").alias("node")), "node", "left_anti").select(F.col("node").alias("label"), "root")
    members.unionByName(own).write.mode("overwrite").parquet(f"{state}/roots/epoch={epoch}")


def _between(left: DataFrame, right: DataFrame, chunk: Sequence[int]) -> DataFrame:
    """(a, b) of face neighbours across chunk faces, a in the lower chunk."""
    out = None
    names = ("z", "y", "x")
    for axis, c in enumerate(names):
        low = left.where(F.col(c) % chunk[axis] == chunk[axis] - 1).select(*[(F.col(k) + int(k == c)).alias(k) for k in names], F.col("label").alias("a"))
        high = right.where(F.col(c) % chunk[axis] == 0).select(*names, F.col("label").alias("b"))
        pairs = low.join(high, list(names)).select("a", "b")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def merge_arrivals(chunks: DataFrame, label: Callable[[DataFrame], DataFrame], state: str, checkpoint: str, chunk: Sequence[int]) -> StreamingQuery:
    """Keep the components of a stream of chunks up to date; `label` makes label blocks of the rows of a batch."""

    def take(batch: DataFrame, epoch: int) -> None:
        with settled_within(batch.sparkSession):
            merge_batch(settle(label(batch), "labelled"), epoch, state, chunk)

    return chunks.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def component_table(spark: SparkSession, state: str) -> DataFrame:
    """(label, root, n, size) of all chunks so far, as labels.component_table() gives it."""
    sizes = _before(spark, f"{state}/sizes", SIZES, None).select("label", "n")
    named = sizes.join(_roots(spark, state, None), "label", "left").select("label", F.coalesce("root", "label").alias("root"), "n")
    total = named.groupBy("root").agg(F.sum("n").alias("size"))
    return named.join(total, "root").select("label", "root", "n", "size")
