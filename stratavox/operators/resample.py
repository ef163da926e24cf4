"""Cubic-spline resampling of whole volumes, one axis after another, in slabs with a halo of bounded width."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.functions import kernels as K
from stratavox.operators.volumes import _NAMES, as_array, as_row, block_rows, few_blocks, to_batch, to_batches
from stratavox.plans.schema import BLOCK, CHUNK

#: Samples on either side of what a slab reads. The spline's coefficients depend on the samples around them, by a factor of
#: 0.27 less for each step away: 1e-18 at this distance.
HALO = 32
#: Voxels of a block along each axis unless it is said otherwise: 16 MB as doubles.
SLAB = (128, 128, 128)
_ORIGIN = ("z0", "y0", "x0")


def zoomed(n: int, factor: float) -> int:
    return max(1, round(n * factor))


def _windows(blocks: DataFrame, axis: int, low: np.ndarray, high: np.ndarray, make, gaps: bool = False) -> DataFrame:
    """Blocks of another cut along one axis: number t is made of the samples from low[t] to high[t], which may overlap those of its
    neighbours. make(window, t) gives the origin along the axis and the voxels, with the axis first in both arrays. Each block
    sends each window the samples that it reads; a volume with missing blocks is an error, unless `gaps` says that their voxels
    are 0. A window without any block has no row."""

    def pieces(row: dict) -> Iterator[dict]:
        a, lo = as_array(row), row[_ORIGIN[axis]]
        for t in range(int(np.searchsorted(high, lo, side="right")), len(low)):
            if low[t] >= lo + a.shape[axis]:
                break
            start, stop = max(lo, int(low[t])), min(lo + a.shape[axis], int(high[t]))
            part = a[tuple(slice(start - lo, stop - lo) if k == axis else slice(None) for k in range(3))]
            yield as_row(row | {CHUNK[axis]: t, _ORIGIN[axis]: start}, part)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_batches(p for row in block_rows(batches) for p in pieces(row))

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r[_ORIGIN[axis]])
        t, ends = rows[0][CHUNK[axis]], [r[_ORIGIN[axis]] + as_array(r).shape[axis] for r in rows]
        whole = rows[0][_ORIGIN[axis]] == low[t] and ends[-1] == high[t] and all(e == r[_ORIGIN[axis]] for e, r in zip(ends, rows[1:], strict=False))
        if not whole and not gaps:
            raise ValueError("the volume has missing blocks")
        size = list(as_array(rows[0]).shape)
        size[axis] = int(high[t] - low[t])
        window = np.zeros(size)
        for r, end in zip(rows, ends, strict=True):
            window[tuple(slice(r[_ORIGIN[axis]] - low[t], end - low[t]) if k == axis else slice(None) for k in range(3))] = as_array(r)
        origin, done = make(np.moveaxis(window, axis, 0), t)
        return pa.Table.from_batches([to_batch([as_row(rows[0] | {_ORIGIN[axis]: int(origin)}, np.moveaxis(done, 0, axis))])])

    return few_blocks(blocks.select(*_NAMES)).mapInArrow(cut, BLOCK).groupBy(*CHUNK).applyInArrow(build, BLOCK)


def resample_axis(blocks: DataFrame, axis: int, n: int, m: int, length: int, gaps: bool = False) -> DataFrame:
    """m samples instead of n along one axis, both ends aligned, in blocks of `length` along it; double precision.

    Each block sends each slab of the result the samples it reads, so a voxel moves once, and those near the border of two slabs
    twice. Where the volume ends the spline is mirrored. A volume with missing blocks is an error, unless `gaps` says that they are 0.
    """
    first = np.arange(0, m, length)
    last = np.minimum(first + length, m)
    at = K.sample_places(n, m)
    low = np.maximum(np.floor(at[first]).astype(np.int64) - 1 - HALO, 0)
    high = np.minimum(np.floor(at[last - 1]).astype(np.int64) + 3 + HALO, n)

    return _windows(blocks, axis, low, high, lambda window, t: (first[t], K.resample_window(window, int(low[t]), n, at[first[t] : last[t]])), gaps)


def zoom(blocks: DataFrame, shape: Sequence[int], factors: Sequence[float], chunk: Sequence[int] = SLAB, gaps: bool = False) -> DataFrame:
    """A volume of `shape` resampled by a factor along each axis, as the one-block kernel does it: axes that keep their number of
    samples stay as they are, the one that shrinks most comes first. Blocks of the result have `chunk` voxels along the axes
    that were resampled, and those of the source along the others. Missing blocks are an error, or with `gaps` zeros; then a
    block of the result that no block of the source reaches is missing too."""
    out = blocks
    for axis in sorted(range(3), key=lambda a: factors[a]):
        m = zoomed(shape[axis], factors[axis])
        if m != shape[axis]:
            out = resample_axis(out, axis, shape[axis], m, chunk[axis], gaps)
    return out


#: Samples on either side of a sampled place that the SQL version reads: four meet there, each a sum over 40 on either side.
REACH_SQL = 42


def reached_layers(layers: DataFrame, n: int, m: int) -> DataFrame:
    """(z): those of m layers, resampled from n, whose spline reads one of the layers (first, last) of a table."""
    step = (n - 1) / (m - 1) if m > 1 else 0.0
    # the bounds are a sample wider than what is read; the places themselves decide
    low = F.greatest(F.floor((F.col("first") - REACH_SQL - 1) / step), F.lit(0)) if step else F.lit(0)
    high = F.least(F.ceil((F.col("last") + REACH_SQL + 1) / step), F.lit(m - 1)) if step else F.lit(0)
    near = layers.distinct().select("first", "last", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("z"))
    place = F.col("z") * F.lit(step)
    floor = F.floor(place)
    above = F.when(place == floor, REACH_SQL - 1).otherwise(REACH_SQL)
    return near.where((F.col("last") >= floor - (REACH_SQL - 1)) & (F.col("first") <= floor + above)).select("z").distinct()


#: Coefficients that a block holds beyond its own on either side: a sample reads four along each axis, mirrored at the ends.
REACH = 4


def coefficients(blocks: DataFrame, shape: Sequence[int], chunk: Sequence[int] = SLAB) -> DataFrame:
    """The coefficients of the cubic spline through a volume, in blocks of `chunk` voxels and REACH more on every side that has
    more; chunk numbers are those of the voxels, origins those of the wider blocks."""
    out = blocks
    for axis in range(3):
        n, length = shape[axis], chunk[axis]
        first = np.arange(0, n, length)
        last = np.minimum(first + length, n)
        start, stop = np.maximum(first - REACH, 0), np.minimum(last + REACH, n)
        low, high = np.maximum(start - HALO, 0), np.minimum(stop + HALO, n)

        def make(window: np.ndarray, t: int, low=low, start=start, stop=stop) -> tuple[int, np.ndarray]:
            return start[t], K.spline_coefficients(window)[start[t] - low[t] : stop[t] - low[t]].astype(np.float64)

        out = _windows(out, axis, low, high, make)
    return out


def transform_volume(moving: DataFrame, moving_shape: Sequence[int], shape: Sequence[int], transforms: Sequence, chunk: Sequence[int] = SLAB, missing: float = 0.0) -> DataFrame:
    """Image transform by cubic splines: each voxel of a volume of `shape` takes the value of `moving` where the transforms send it, or
    `missing` where that is more than half a voxel outside. Blocks of doubles with `chunk` voxels.

    Each block of the result works out where its voxels are sent and sends them, as one array, to each block of the moving
    volume that holds some; they are read there and sent back. Blocks of both volumes meet by an equi-join on the chunk, never
    voxel by voxel.
    """
    spark = moving.sparkSession
    grid = [-(-n // c) for n, c in zip(shape, chunk, strict=True)]
    shared = spark.sparkContext.broadcast(list(transforms))  # control grids: bounded by the atlas
    extent = np.array(moving_shape)

    def places(i: int) -> tuple[list[int], list[int], np.ndarray]:
        c = [int(k) for k in np.unravel_index(i, grid)]
        lo = [k * n for k, n in zip(c, chunk, strict=True)]
        size = [min(n, s - o) for n, s, o in zip(chunk, shape, lo, strict=True)]
        zyx = np.indices(size).reshape(3, -1).T + np.array(lo)
        xyz = zyx[:, ::-1].astype(np.float64)
        for t in shared.value:
            xyz = t(xyz)
        return c, size, xyz[:, ::-1]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                c, _, to = places(i)
                inside = np.flatnonzero(((to >= -0.5) & (to < extent - 0.5)).all(axis=1))
                if not len(inside):
                    continue
                home = np.clip(np.floor(to[inside]).astype(np.int64), 0, extent - 1) // np.array(chunk)
                key, group = np.unique(home, axis=0, return_inverse=True)
                order = np.argsort(group.ravel(), kind="stable")
                for k, part in zip(key.tolist(), np.split(order, np.cumsum(np.bincount(group.ravel(), minlength=len(key)))[:-1]), strict=True):
                    at = inside[part]
                    cols = [*k, *c, at.astype("<i4").tobytes(), to[at].astype("<f8").tobytes()]
                    kinds = [pa.int32()] * 6 + [pa.binary()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cols, kinds, strict=True)], [*CHUNK, "tz", "ty", "tx", "at", "places"])

    def read(row: dict) -> np.ndarray:
        a, lo = as_array(row), np.array([row[o] for o in _ORIGIN])
        p = np.frombuffer(row["places"], "<f8").reshape(-1, 3)
        first = np.floor(p).astype(np.int64)
        i, w = [], []
        for axis in range(3):
            n = extent[axis]
            k = first[:, axis, None] + np.arange(-1, 3)
            w.append(K.bspline3(p[:, axis, None] - k) if n > 1 else np.eye(1, 4)[[0] * len(p)])
            k = np.where(k < 0, -k, k)
            k = np.clip(np.where(k > n - 1, 2 * (n - 1) - k, k), 0, n - 1)
            i.append(np.clip(k - lo[axis], 0, a.shape[axis] - 1))
        near = a[i[0][:, :, None, None], i[1][:, None, :, None], i[2][:, None, None, :]]
        return np.einsum("nzyx,nz,ny,nx->n", near, *w)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            cols = [row["tz"], row["ty"], row["tx"], row["at"], read(row).astype("<f8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cols, [pa.int32()] * 3 + [pa.binary()] * 2, strict=True)], ["tz", "ty", "tx", "at", "found"])

    def build(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        c = [rows[0][k] for k in ("tz", "ty", "tx")]
        lo = [k * n for k, n in zip(c, chunk, strict=True)]
        size = [min(n, s - o) for n, s, o in zip(chunk, shape, lo, strict=True)]
        out = np.full(int(np.prod(size)), missing, np.float64)
        for r in rows:
            if r["at"] is not None:
                out[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["found"], "<f8")
        return pa.Table.from_batches([to_batch([as_row(dict(zip((*CHUNK, *_ORIGIN), c + lo, strict=True)), out.reshape(size))])])

    every = spark.range(int(np.prod(grid)))
    sent = few_blocks(every).mapInArrow(send, "cz int, cy int, cx int, tz int, ty int, tx int, at binary, places binary")
    met = few_blocks(sent.join(coefficients(moving, moving_shape, chunk), list(CHUNK)))
    found = met.mapInArrow(look, "tz int, ty int, tx int, at binary, found binary")
    gy, gx = grid[1], grid[2]
    empty = every.selectExpr(f"cast(id div {gy * gx} as int) tz", f"cast(id div {gx} % {gy} as int) ty", f"cast(id % {gx} as int) tx", "cast(null as binary) at", "cast(null as binary) found")
    return found.unionByName(empty).groupBy("tz", "ty", "tx").applyInArrow(build, BLOCK)
