"""Objects: one row per labelled maximum, with the size and brightness of its watershed region."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.functions import kernels as K
from stratavox.operators.labels import label_budget
from stratavox.operators.volumes import _NAMES, align, aligned_arrays, as_array, block_rows, few_blocks, to_columns
from stratavox.plans.schema import CHUNK, COORDS


def extract_cells(raw: DataFrame, maxima: DataFrame, regions: DataFrame, merge_cells: bool = False) -> DataFrame:
    """(label, z, y, x, count, volume, sum_intensity).

    raw: voxels (z, y, x, v). maxima: labelled maxima voxels. regions: voxels (z, y, x, label, size) of watershed
    labels that passed the size filter. A maximum's place is its first voxel in z, y, x order inside its chunk; its
    volume is the size there; maxima outside every region are left out. The intensity is the sum of raw over the
    voxels of the region with the same label. Voxels meet by one equi-join on the coordinates.

    merge_cells: regions that were merged across chunks (column root) give one row, at the first of their maxima,
    with the summed intensity, instead of one row each with the merged volume.
    """
    first = maxima.where("label > 0").groupBy(*CHUNK, "label").agg(F.min(F.struct(*COORDS)).alias("at")).select("label", "at.*")
    inside = regions.where("size > 0")
    placed = first.join(inside.select(*COORDS, F.col("size").alias("volume"), *(["root"] if merge_cells else [])), list(COORDS))
    light = inside.join(raw.select(*COORDS, "v"), list(COORDS)).groupBy("label").agg(F.sum(F.col("v").cast("double")).alias("sum_intensity"))
    cells = placed.join(light, "label", "left").withColumn("sum_intensity", F.coalesce("sum_intensity", F.lit(0.0)))
    if merge_cells:
        cells = cells.groupBy("root").agg(F.min("label").alias("label"), F.min(F.struct(*COORDS)).alias("at"), F.max("volume").alias("volume"), F.sum("sum_intensity").alias("sum_intensity")).select("label", "at.*", "volume", "sum_intensity")
    return cells.select("label", *COORDS, F.lit(1).cast("long").alias("count"), F.col("volume").cast("long").alias("volume"), "sum_intensity")


CELLS = "label long, z long, y long, x long, count long, volume long, sum_intensity double"
_COLUMNS = [c.split()[0] for c in CELLS.split(", ")]


def _first_voxels(lab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of a block and the place of the first voxel of each, in z, y, x order."""
    ids, first = np.unique(lab.ravel(), return_index=True)
    return ids[ids > 0], first[ids > 0]


def _rows(row: dict, ids: np.ndarray, first: np.ndarray, shape: Sequence[int], volume: np.ndarray, total: np.ndarray) -> list[np.ndarray]:
    place = [k + row[o] for k, o in zip(np.unravel_index(first, shape), ("z0", "y0", "x0"), strict=True)]
    return [ids.astype(np.int64), *place, np.ones(len(ids), np.int64), volume.astype(np.int64), total.astype(np.float64)]


def extract_from_blocks(raw: DataFrame, maxima: DataFrame, regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """extract_cells() of block tables, without merging: the blocks of the four volumes meet by chunk, and places and sums are
    taken inside each, as a label belongs to one chunk. Only objects leave a block.

    maxima: labels of maxima; regions: watershed labels; sizes: at each voxel the size of its region, 0 where it was
    filtered out.
    """

    def cells(row: dict) -> list[np.ndarray]:
        light, top, lab, size = aligned_arrays(row, 4)
        ids, first = _first_voxels(top)
        volume = size.ravel()[first]
        ids, first, volume = ids[volume > 0], first[volume > 0], volume[volume > 0]
        inside = np.flatnonzero((size.ravel() > 0) & (lab.ravel() > 0))
        of = np.searchsorted(ids, lab.ravel()[inside])
        of[of == len(ids)] = 0
        mine = ids[of] == lab.ravel()[inside] if len(ids) else np.zeros(len(inside), bool)
        total = np.bincount(of[mine], light.ravel()[inside[mine]].astype(np.float64), len(ids)) if len(ids) else np.zeros(0)
        return _rows(row, ids, first, top.shape, volume, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_columns(map(cells, block_rows(batches)), _COLUMNS)

    return few_blocks(align(raw, maxima, regions, sizes)).mapInArrow(run, CELLS)


def threshold_objects(blocks: DataFrame, value: float, chunk: Sequence[int], grid: Sequence[int]) -> DataFrame:
    """(cz, cy, cx, label, z, y, x, count, volume, sum_intensity): the face-connected components of each block from a value on,
    with labels as label_blocks() gives them. Threshold, labels and sums are one pass over the blocks, without a shuffle; a
    block without an object has no row."""
    budget, (_, gy, gx) = label_budget(chunk), grid

    def found(row: dict) -> list[np.ndarray]:
        a = as_array(row)
        lab = K.label6(K.threshold(a, value))
        ids, first = _first_voxels(lab)
        volume = np.bincount(lab.ravel(), minlength=len(ids) + 1)[1:]
        total = np.bincount(lab.ravel(), a.ravel().astype(np.float64), len(ids) + 1)[1:]
        own = ids + ((row["cz"] * gy + row["cy"]) * gx + row["cx"]) * budget
        return [np.full(len(ids), row[c], np.int32) for c in CHUNK] + _rows(row, own, first, a.shape, volume, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_columns(map(found, block_rows(batches)), [*CHUNK, *_COLUMNS])

    return few_blocks(blocks.select(*_NAMES)).mapInArrow(run, f"cz int, cy int, cx int, {CELLS}")


def shift(cells: DataFrame, start: tuple[int, int, int]) -> DataFrame:
    """Coordinates of a crop put back into the whole volume."""
    return cells.withColumns({c: F.col(c) + s for c, s in zip(COORDS, start, strict=True)})
