"""Component labels: inside chunks by a block kernel, across chunks on the label graph."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.functions import kernels as K
from stratavox.operators.components import connected_components
from stratavox.operators.volumes import _NAMES, Kernel, align, aligned_arrays, as_array, as_row, block_rows, few_blocks, to_batches, to_columns
from stratavox.plans.schema import BLOCK, CHUNK, COORDS


def label_budget(chunk: Sequence[int]) -> int:
    """More labels than a chunk can hold: every other voxel and one."""
    return ceil(prod(chunk) / 2) + 1


def label_blocks(mask: DataFrame, chunk: Sequence[int], grid: Sequence[int], kernel: Kernel | None = None, others: Sequence[DataFrame] = ()) -> DataFrame:
    """Face-connected components inside each chunk. Labels are unique over the volume: number in the chunk plus
    the chunk's row-major place in the grid times the label budget, as 64-bit integers.

    With a kernel the mask is kernel(block, *blocks of others), made in the same pass: a pass of its own would be one more
    Python process a task.
    """
    budget, (_, gy, gx) = label_budget(chunk), grid
    count = 1 + len(others)

    def label(row: dict) -> dict:
        arrays = aligned_arrays(row, count)
        lab = K.label6(kernel(*arrays) if kernel else arrays[0])
        lab[lab > 0] += ((row["cz"] * gy + row["cy"]) * gx + row["cx"]) * budget
        return as_row(row, lab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_batches(map(label, block_rows(batches)))

    return few_blocks(align(mask, *others)).mapInArrow(run, BLOCK)


def face_voxels(labels: DataFrame, chunk: Sequence[int]) -> DataFrame:
    """Labelled voxels on chunk faces: all that can touch another chunk."""
    edge = F.lit(False)
    for c, n in zip(COORDS, chunk, strict=True):
        edge = edge | (F.col(c) % n == 0) | (F.col(c) % n == n - 1)
    return labels.where(edge & (F.col("label") > 0))


def neighbour_edges(voxels: DataFrame, chunk: Sequence[int] | None = None, value: str = "label") -> DataFrame:
    """(a, b) values of face neighbours. With a chunk shape only pairs across chunk faces.

    Three shifted equi-joins, one per axis; a distance condition would be a nested-loop join.
    """
    out = None
    right = voxels.select(*[F.col(c).alias("_" + c) for c in COORDS], F.col(value).alias("b"))
    for axis, c in enumerate(COORDS):
        left = voxels.where(F.col(c) % chunk[axis] == chunk[axis] - 1) if chunk else voxels
        other = right.where(F.col("_" + c) % chunk[axis] == 0) if chunk else right
        shifted = left.select(*[(F.col(k) + (1 if k == c else 0)).alias("_" + k) for k in COORDS], F.col(value).alias("a"))
        pairs = shifted.join(other, ["_" + k for k in COORDS]).select("a", "b")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def boundary_pairs(labels: DataFrame, chunk: Sequence[int]) -> DataFrame:
    """Distinct (lo, hi) labels that touch through a chunk face."""
    pairs = neighbour_edges(face_voxels(labels, chunk), chunk)
    return pairs.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()


def label_sizes(labels: DataFrame) -> DataFrame:
    return labels.where("label > 0").groupBy("label").agg(F.count("*").alias("n"))


def component_table(labels: DataFrame, chunk: Sequence[int]) -> DataFrame:
    """(label, root, n, size): each label's component across chunks and the component's voxels.

    The graph has a node per label that touches a face, not per voxel, and stays distributed.
    """
    return _with_roots(label_sizes(labels), connected_components(boundary_pairs(labels, chunk), "lo", "hi"))


def _with_roots(sizes: DataFrame, roots: DataFrame) -> DataFrame:
    named = sizes.join(roots, F.col("label") == F.col("node"), "left").select("label", F.coalesce("root", "label").alias("root"), "n")
    total = named.groupBy("root").agg(F.sum("n").alias("size"))
    return named.join(total, "root").select("label", "root", "n", "size")


def block_label_sizes(labels: DataFrame) -> DataFrame:
    """(label, n) of a label block table, counted inside each block. A label belongs to one chunk, so nothing is shuffled."""

    def count(row: dict) -> list[np.ndarray]:
        ids, n = np.unique(as_array(row), return_counts=True)
        return [ids[ids > 0].astype(np.int64), n[ids > 0].astype(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_columns(map(count, block_rows(batches)), ["label", "n"])

    return few_blocks(labels.select(*_NAMES)).mapInArrow(run, "label long, n long")


def block_face_voxels(labels: DataFrame) -> DataFrame:
    """(z, y, x, label) of the labelled voxels on the faces of a label block table: inner voxels stay in their block."""

    def faces(row: dict) -> list[np.ndarray]:
        a = as_array(row)
        edge = np.zeros(a.shape, bool)
        for axis in range(3):
            for side in (0, -1):
                edge[(slice(None),) * axis + (side,)] = True
        at = np.flatnonzero(edge & (a > 0))
        return [k + row[o] for k, o in zip(np.unravel_index(at, a.shape), ("z0", "y0", "x0"), strict=True)] + [a.ravel()[at].astype(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_columns(map(faces, block_rows(batches)), [*COORDS, "label"])

    return few_blocks(labels.select(*_NAMES)).mapInArrow(run, "z long, y long, x long, label long")


def block_component_table(labels: DataFrame, chunk: Sequence[int]) -> DataFrame:
    """component_table() of a label block table: counts and faces are taken inside the blocks, so of the volume only voxels
    on chunk faces are shuffled."""
    pairs = neighbour_edges(block_face_voxels(labels), chunk).where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    return _with_roots(block_label_sizes(labels), connected_components(pairs, "lo", "hi"))


def map_values(labels: DataFrame, table: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """labels with a value looked up for each label; background and unknown labels get 0."""
    found = table.select(F.col(key).alias("label"), F.col(value).alias(out))
    return labels.join(found, "label", "left").withColumn(out, F.coalesce(out, F.lit(0)))


def component_volumes(labels: DataFrame, chunk: Sequence[int]) -> DataFrame:
    """Voxels with the size of their whole component, across chunks, as `size`."""
    return map_values(labels, component_table(labels, chunk), "label", "size", "size")


def filter_sizes(volumes: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Sparse size filter: voxels of components within the bounds, both included."""
    kept = volumes.where(F.col("size") >= (low or 0))
    return kept if high is None else kept.where(F.col("size") <= high)


def block_volumes(labels: DataFrame) -> DataFrame:
    """The size of each voxel's label inside its chunk."""
    sizes = labels.where("label > 0").groupBy(*CHUNK, "label").agg(F.count("*").alias("size"))
    return labels.join(sizes, [*CHUNK, "label"], "left").withColumn("size", F.coalesce("size", F.lit(0)))


def labelled_voxels(labels: DataFrame) -> DataFrame:
    """(cz, cy, cx, z, y, x, label) of the labelled voxels of a label block table."""
    from stratavox.operators.volumes import blocks_to_voxels

    return blocks_to_voxels(labels, sparse=True).withColumnRenamed("v", "label")


def scatter_volumes(labels: DataFrame, table: DataFrame, key: str = "label", value: str = "size", kernel: Kernel | None = None) -> DataFrame:
    """A label block table with every label replaced by its value, as blocks; with a kernel, the kernel of such a block.

    A block meets only the values of its own labels: the table is joined to the distinct labels of blocks and
    grouped by chunk, so nothing that grows with the volume is broadcast.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_columns(map(own_labels, block_rows(batches)), [*CHUNK, "label"])

    def own_labels(row: dict) -> list[np.ndarray]:
        ids = np.unique(as_array(row))
        ids = ids[ids > 0].astype(np.int64)
        return [np.full(len(ids), row[c], np.int32) for c in CHUNK] + [ids]

    own = few_blocks(labels.select(*_NAMES)).mapInArrow(seen, "cz int, cy int, cx int, label long")
    pairs = own.join(table.select(F.col(key).alias("label"), F.col(value).cast("long").alias("value")), "label")
    by_chunk = pairs.groupBy(*CHUNK).agg(F.sort_array(F.collect_list(F.struct("label", "value"))).alias("pairs"))
    joined = labels.select(*_NAMES).join(by_chunk, list(CHUNK), "left")

    def value_of(row: dict) -> dict:
        a, found = as_array(row), row["pairs"] or []
        out = np.zeros(a.shape, np.int64)
        if found:
            k, v = np.array([p["label"] for p in found]), np.array([p["value"] for p in found])
            at = np.minimum(np.searchsorted(k, a), len(k) - 1)
            out = np.where(k[at] == a, v[at], 0)
        return as_row(row, kernel(out) if kernel else out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_batches(map(value_of, block_rows(batches)))

    return few_blocks(joined).mapInArrow(run, BLOCK)
