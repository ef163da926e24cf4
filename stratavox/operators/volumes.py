"""Volumes as block tables (one row per chunk) and as voxel tables (one row per voxel), and plans on both.

A block plan runs numpy kernels inside one mapInArrow: no shuffle, one chunk in memory at a time. A voxel plan
is ordinary SQL; it suits sparse data, that is, everything after the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions.kernels import orient_axes
from stratavox.plans.schema import BLOCK, CHUNK, COORDS
from stratavox.runtime import arrow_batches

_NAMES = [c.split()[0] for c in BLOCK.split(", ")]
_KINDS = {"cz": pa.int32(), "cy": pa.int32(), "cx": pa.int32(), "z0": pa.int64(), "y0": pa.int64(), "x0": pa.int64(), "nz": pa.int32(), "ny": pa.int32(), "nx": pa.int32(), "dtype": pa.string(), "data": pa.binary()}
Kernel = Callable[..., np.ndarray]


def few_blocks(df: DataFrame) -> DataFrame:
    """Blocks may have many MB: a batch has one of them, or as many as stay within the bytes of a batch."""
    arrow_batches(df.sparkSession)
    return df


def as_array(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], row["dtype"]).reshape(row["nz"], row["ny"], row["nx"])


def as_row(row: dict, block: np.ndarray) -> dict:
    block = np.ascontiguousarray(block)
    nz, ny, nx = block.shape
    return {k: row[k] for k in ("cz", "cy", "cx", "z0", "y0", "x0")} | {"nz": nz, "ny": ny, "nx": nx, "dtype": block.dtype.str, "data": block.tobytes()}


def to_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KINDS[n]) for n in _NAMES], _NAMES)


#: Bytes of blocks, and voxels, that go back to the JVM together: small blocks share a batch, so that what a batch costs is
#: shared too, and both sides have work meanwhile.
BACK_BYTES, BACK_VOXELS = 1 << 18, 1 << 16


def to_batches(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    """Block rows in batches of BACK_BYTES, or of one larger block."""
    held: list[dict] = []
    size = 0
    for r in rows:
        if held and size + len(r["data"]) > BACK_BYTES:
            yield to_batch(held)
            held, size = [], 0
        held.append(r)
        size += len(r["data"]) + 200  # the other columns
    if held:
        yield to_batch(held)


def to_columns(parts: Iterable[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns of several blocks in batches of about BACK_VOXELS rows."""
    held: list[list[np.ndarray]] = []
    size = 0
    for p in parts:
        held.append(p)
        size += len(p[0])
        if size >= BACK_VOXELS:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)


#: Rows of small blocks that are Python objects at once: a batch can hold some ten thousand.
ROWS_AT_ONCE = 256


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ROWS_AT_ONCE at a time, without a copy."""
    return (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE))


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return (row for b in slices(batches) for row in b.to_pylist())


def map_blocks(blocks: DataFrame, fn: Kernel) -> DataFrame:
    """fn over each block alone, without its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_batches(as_row(row, fn(as_array(row))) for row in block_rows(batches))

    return few_blocks(blocks.select(*_NAMES)).mapInArrow(run, BLOCK)


def align(*volumes: DataFrame) -> DataFrame:
    """One row per chunk with the blocks of several volumes on one chunk grid: an equi-join on the chunk."""
    joined = volumes[0].select(*_NAMES)
    for i, other in enumerate(volumes[1:], 1):
        joined = joined.join(other.select(*CHUNK, F.struct("nz", "ny", "nx", "dtype", "data").alias(f"other{i}")), list(CHUNK))
    return joined


def map_aligned(fn: Kernel, *volumes: DataFrame) -> DataFrame:
    """fn over the blocks of several volumes on one chunk grid: an equi-join on the chunk, then one pass."""
    joined, count = align(*volumes), len(volumes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_batches(as_row(row, fn(*aligned_arrays(row, count))) for row in block_rows(batches))

    return few_blocks(joined).mapInArrow(run, BLOCK)


def aligned_arrays(row: dict, count: int) -> list[np.ndarray]:
    """The blocks of a row of align()."""
    arrays = [as_array(row)] + [as_array(row[f"other{i}"]) for i in range(1, count)]
    if len({a.shape for a in arrays}) > 1:
        raise ValueError("the volumes have different chunk grids")
    return arrays


def map_overlap(blocks: DataFrame, fn: Kernel, depth: int) -> DataFrame:
    """fn over each block with `depth` voxels of its neighbours around it; the result is cut back to the block.

    Each block sends its 26 neighbours the part they need, so the shuffle carries surfaces. Where a volume
    ends, the block ends too, so kernels apply their own edge rule there. Blocks are at least `depth` wide.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            a = as_array(row)
            if min(a.shape) < depth:
                raise ValueError("blocks are smaller than the overlap")
            out = []
            for step in np.ndindex(3, 3, 3):
                d = [s - 1 for s in step]
                part = a[tuple(slice(None) if s == 0 else slice(n - depth, n) if s > 0 else slice(0, depth) for s, n in zip(d, a.shape, strict=True))]
                out.append(as_row(row, part) | {"tz": row["cz"] + d[0], "ty": row["cy"] + d[1], "tx": row["cx"] + d[2]})
            batch = to_batch(out)
            for t in ("tz", "ty", "tx"):
                batch = batch.append_column(t, pa.array([o[t] for o in out], pa.int32()))
            yield batch

    def build(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        mine = [r for r in rows if (r["cz"], r["cy"], r["cx"]) == (r["tz"], r["ty"], r["tx"])]
        if not mine:
            return pa.Table.from_batches([to_batch([])])  # beyond the volume
        own = as_array(mine[0])
        by = {(r["cz"] - r["tz"], r["cy"] - r["ty"], r["cx"] - r["tx"]): as_array(r) for r in rows}
        has = [[depth if tuple((s if i == axis else 0) for i in range(3)) in by else 0 for s in (-1, 1)] for axis in range(3)]
        wide = np.zeros([n + h[0] + h[1] for n, h in zip(own.shape, has, strict=True)], own.dtype)
        for d, part in by.items():
            at = []
            for s, n, h in zip(d, own.shape, has, strict=True):
                at.append(slice(h[0], h[0] + n) if s == 0 else slice(0, h[0]) if s < 0 else slice(h[0] + n, h[0] + n + h[1]))
            if all(x.stop > x.start for x in at):
                wide[tuple(at)] = part
        done = fn(wide)[tuple(slice(h[0], h[0] + n) for n, h in zip(own.shape, has, strict=True))]
        return pa.Table.from_batches([to_batch([as_row(mine[0], done)])])

    sent = few_blocks(blocks.select(*_NAMES)).mapInArrow(send, BLOCK + ", tz int, ty int, tx int")
    return sent.groupBy("tz", "ty", "tx").applyInArrow(build, BLOCK)


def blocks_to_voxels(blocks: DataFrame, sparse: bool = False) -> DataFrame:
    """(cz, cy, cx, z, y, x, v); sparse leaves out zeros."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for row in block_rows(batches):
            a = as_array(row)
            flat = np.flatnonzero(a) if sparse else np.arange(a.size)
            for at in range(0, len(flat), BACK_VOXELS):
                i = flat[at : at + BACK_VOXELS]
                zyx = np.unravel_index(i, a.shape)
                yield [np.full(len(i), row[c], np.int32) for c in CHUNK] + [k + row[o] for k, o in zip(zyx, ("z0", "y0", "x0"), strict=True)] + [a.ravel()[i].astype(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_columns(parts(batches), [*CHUNK, *COORDS, "v"])

    return few_blocks(blocks.select(*_NAMES)).mapInArrow(run, "cz int, cy int, cx int, z long, y long, x long, v long")


def voxels_to_blocks(voxels: DataFrame, chunk: Sequence[int], shape: Sequence[int], dtype: str = "uint16", value: str = "v") -> DataFrame:
    """Blocks of a chunk grid from voxels (z, y, x, value); missing voxels are 0 and chunks without voxels are absent."""
    key = [F.floor(F.col(c) / F.lit(n)).cast("int").alias(k) for c, n, k in zip(COORDS, chunk, CHUNK, strict=True)]

    def build(table: pa.Table) -> pa.Table:
        c = [table.column(k)[0].as_py() for k in CHUNK]
        lo = [i * n for i, n in zip(c, chunk, strict=True)]
        size = [min(n, s - a) for n, s, a in zip(chunk, shape, lo, strict=True)]
        a = np.zeros(size, dtype)
        a[tuple(np.asarray(table.column(k)) - o for k, o in zip(COORDS, lo, strict=True))] = np.asarray(table.column("v")).astype(dtype)
        return pa.Table.from_batches([to_batch([as_row(dict(zip((*CHUNK, "z0", "y0", "x0"), c + lo, strict=True)), a)])])

    inside = voxels
    for c, n in zip(COORDS, shape, strict=True):
        inside = inside.where((F.col(c) >= 0) & (F.col(c) < n))
    return inside.select(*key, *COORDS, F.col(value).cast("long").alias("v")).groupBy(*CHUNK).applyInArrow(build, BLOCK)


def fill_blocks(blocks: DataFrame, chunk: Sequence[int], shape: Sequence[int], reach: int) -> DataFrame:
    """The same volume with blocks of zeros where chunks are absent, in every layer of chunks that has a block within `reach`
    voxels along z; layers farther from all blocks stay absent, so a wide gap costs nothing."""
    grid = [-(-n // c) for n, c in zip(shape, chunk, strict=True)]
    far, dtype = -(-reach // chunk[0]), "<f8"
    layers = blocks.select(F.explode(F.sequence(F.greatest(F.col("cz") - far, F.lit(0)), F.least(F.col("cz") + far, F.lit(grid[0] - 1)))).alias("cz")).distinct()
    every = layers.select("cz", F.explode(F.sequence(F.lit(0), F.lit(grid[1] - 1))).alias("cy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(grid[2] - 1))).alias("cx"))
    absent = every.join(blocks.select(*CHUNK), list(CHUNK), "left_anti")

    def zeros(row: dict) -> dict:
        lo = [row[k] * n for k, n in zip(CHUNK, chunk, strict=True)]
        size = [min(n, s - a) for n, s, a in zip(chunk, shape, lo, strict=True)]
        return as_row(row | dict(zip(("z0", "y0", "x0"), lo, strict=True)), np.zeros(size, dtype))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_batches(map(zeros, block_rows(batches)))

    return blocks.select(*_NAMES).unionByName(few_blocks(absent).mapInArrow(run, BLOCK))


def rechunk(blocks: DataFrame, chunk: Sequence[int]) -> DataFrame:
    """The same volume on another chunk grid. Blocks are cut where the new grid cuts them, so pieces, not voxels, move."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_batches(pieces(batches))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in block_rows(batches):
            a, lo = as_array(row), [row["z0"], row["y0"], row["x0"]]
            first = [o // n for o, n in zip(lo, chunk, strict=True)]
            last = [(o + s - 1) // n for o, s, n in zip(lo, a.shape, chunk, strict=True)]
            for d in np.ndindex(*[z - f + 1 for f, z in zip(first, last, strict=True)]):
                c = [f + i for f, i in zip(first, d, strict=True)]
                at = [slice(max(k * n, o) - o, min((k + 1) * n, o + s) - o) for k, n, o, s in zip(c, chunk, lo, a.shape, strict=True)]
                start = [o + x.start for o, x in zip(lo, at, strict=True)]
                yield as_row(dict(zip((*CHUNK, "z0", "y0", "x0"), c + start, strict=True)), a[tuple(at)])

    def join(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lo = [min(r[k] for r in rows) for k in ("z0", "y0", "x0")]
        hi = [max(r[k] + r[n] for r in rows) for k, n in (("z0", "nz"), ("y0", "ny"), ("x0", "nx"))]
        a = np.zeros([h - o for o, h in zip(lo, hi, strict=True)], rows[0]["dtype"])
        for r in rows:
            a[tuple(slice(r[k] - o, r[k] - o + r[n]) for k, n, o in zip(("z0", "y0", "x0"), ("nz", "ny", "nx"), lo, strict=True))] = as_array(r)
        return pa.Table.from_batches([to_batch([as_row(dict(zip((*CHUNK, "z0", "y0", "x0"), [rows[0][k] for k in CHUNK] + lo, strict=True)), a)])])

    return few_blocks(blocks.select(*_NAMES)).mapInArrow(cut, BLOCK).groupBy(*CHUNK).applyInArrow(join, BLOCK)


def prune_blocks(blocks: DataFrame, start: Sequence[int], stop: Sequence[int], chunk: Sequence[int] | None = None) -> DataFrame:
    """Only blocks that meet a box; the comparison of stored origins reaches the scan. If the largest chunk is known, so does
    the lower bound, as a comparison of its own."""
    for i, (o, n, a, z) in enumerate(zip(("z0", "y0", "x0"), ("nz", "ny", "nx"), start, stop, strict=True)):
        if chunk is not None:
            blocks = blocks.where(F.col(o) > a - chunk[i])
        blocks = blocks.where((F.col(o) < z) & (F.col(o) + F.col(n) > a))
    return blocks


# ---- voxel plans: projections and filters ---------------------------------------------------------------------------


def threshold(value: int | float, v: str = "v") -> Column:
    """1 from the value on, else 0."""
    return (F.col(v) >= value).cast("int")


def clamp(low: float | None = None, high: float | None = None, v: str = "v") -> Column:
    c = F.col(v)
    c = F.greatest(c, F.lit(low)) if low is not None else c
    return F.least(c, F.lit(high)) if high is not None else c


def map_bounds(low: int, low_to: int, high: int, high_to: int, v: str = "v") -> Column:
    """Below low becomes low_to, above high becomes high_to."""
    return F.when(F.col(v) < low, low_to).when(F.col(v) > high, high_to).otherwise(F.col(v))


def size_between(low: int | None, high: int | None, v: str = "v") -> Column:
    """The value if it lies within the bounds, both included, else 0; a missing bound doesn't bind."""
    return F.when((F.col(v) >= (low or 0)) & (F.lit(True) if high is None else F.col(v) <= high), F.col(v)).otherwise(0)


def relu(c: Column) -> Column:
    return F.greatest(c, F.lit(0))


def wrap(c: Column, bits: int) -> Column:
    """What an unsigned integer of so many bits holds."""
    return F.pmod(c, F.lit(1 << bits))


def mean_threshold(voxels: DataFrame, offset_sd: float = 0.0) -> DataFrame:
    """1 above mean + offset_sd * population deviation of the chunk's non-zero voxels; one aggregate per chunk joined back."""
    seen = F.when(F.col("v") > 0, F.col("v").cast("double"))
    stats = voxels.groupBy(*CHUNK).agg((F.avg(seen) + offset_sd * F.stddev_pop(seen)).alias("cut"))
    return voxels.join(stats, list(CHUNK)).select(*COORDS, F.coalesce(F.col("v") > F.col("cut"), F.lit(False)).cast("int").alias("m"))


def crop(voxels: DataFrame, slices: Sequence[slice], shape: Sequence[int]) -> DataFrame:
    """Python slices along z, y, x with the origin moved to the first voxel kept; negative bounds count from the end."""
    out, moved = voxels, {}
    for c, s, n in zip(COORDS, slices, shape, strict=True):
        a, z, step = s.indices(n)
        if step < 0:
            raise ValueError("slices run forward")
        out = out.where((F.col(c) >= a) & (F.col(c) < z))
        if step > 1:
            out = out.where((F.col(c) - a) % step == 0)
        moved[c] = F.floor((F.col(c) - a) / step).cast("long")
    return out.withColumns(moved)


def stride(voxels: DataFrame, steps: Sequence[int]) -> DataFrame:
    """Every n-th voxel along each axis."""
    out = voxels
    for c, n in zip(COORDS, steps, strict=True):
        out = out.where(F.col(c) % n == 0)
    return out.withColumns({c: F.expr(f"{c} div {n}") for c, n in zip(COORDS, steps, strict=True)})


def stride_blocks(blocks: DataFrame, steps: Sequence[int]) -> DataFrame:
    """stride() of a block table: the voxels are picked inside each block, so only they leave it. Blocks keep their places in
    the chunk grid; origins and sizes are those of the new volume, and a block in which no voxel is picked is left out."""

    def picked(row: dict) -> Iterator[dict]:
        a, lo = as_array(row), [row[o] for o in ("z0", "y0", "x0")]
        first = [-o % n for o, n in zip(lo, steps, strict=True)]
        if all(f < s for f, s in zip(first, a.shape, strict=True)):
            new = {o: (v + f) // n for o, v, f, n in zip(("z0", "y0", "x0"), lo, first, steps, strict=True)}
            yield as_row(row | new, a[tuple(slice(f, None, n) for f, n in zip(first, steps, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_batches(r for row in block_rows(batches) for r in picked(row))

    return few_blocks(blocks.select(*_NAMES)).mapInArrow(run, BLOCK)


def reorient(voxels: DataFrame, orientation: tuple[int, int, int], shape: Sequence[int]) -> DataFrame:
    """Flip the axes with a negative number and permute: a projection of coordinates."""
    axes, flips = orient_axes(orientation)
    new = [(F.lit(shape[a] - 1) - F.col(COORDS[a]) if f else F.col(COORDS[a])).cast("long") for a, f in zip(axes, flips, strict=True)]
    return voxels.withColumns(dict(zip(COORDS, new, strict=True)))


def masked(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels where the mask table has a row: a semi join on the coordinates."""
    return voxels.join(mask.select(*COORDS), list(COORDS), "left_semi")


def stack_channels(*channels: DataFrame) -> DataFrame:
    """(z, y, x, channels): values rounded half to even and clipped to 0..65535, one array element per volume.

    One union and one grouping instead of a chain of joins; a voxel that a volume lacks is 0 there.
    """
    tagged = None
    for i, ch in enumerate(channels):
        t = ch.select(*COORDS, F.lit(i).alias("i"), F.least(F.greatest(F.rint(F.col("v").cast("double")), F.lit(0.0)), F.lit(65535.0)).cast("int").alias("v"))
        tagged = t if tagged is None else tagged.unionByName(t)
    cols = [F.coalesce(F.max(F.when(F.col("i") == i, F.col("v"))), F.lit(0)) for i in range(len(channels))]
    return tagged.groupBy(*COORDS).agg(F.array(*cols).alias("channels"))
