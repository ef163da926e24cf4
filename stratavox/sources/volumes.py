"""Block tables from and to files. Files are read through Spark's binary source, so they may lie in any store it reads."""

from __future__ import annotations

import json
import operator as op
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from stratavox.operators.mapping import natural_key
from stratavox.operators.volumes import _NAMES, as_array, as_row, block_rows, few_blocks, prune_blocks, rechunk, to_batch, to_batches
from stratavox.plans.schema import BLOCK, CHUNK
from stratavox.runtime import read_text, ship
from stratavox.sources import nifti, tiff, zarr


def _row(c: Sequence[int], lo: Sequence[int], block: np.ndarray) -> dict:
    return as_row(dict(zip((*CHUNK, "z0", "y0", "x0"), [*c, *lo], strict=True)), block)


def _cut(a: np.ndarray, z0: int, chunk: Sequence[int]) -> Iterator[dict]:
    """Blocks of the pages of a stack from page z0 on: cut along y and x here, joined along z later."""
    for y in range(0, a.shape[1], chunk[1]):
        for x in range(0, a.shape[2], chunk[2]):
            yield _row([z0 // chunk[0], y // chunk[1], x // chunk[2]], [z0, y, x], a[:, y : y + chunk[1], x : x + chunk[2]])


def read_tiff_stack(spark: SparkSession, folder: str, chunk: Sequence[int], multipage: bool = False) -> DataFrame:
    """A volume from the *.tif files of a folder in natural order of their names.

    Only names reach the driver. Every file is decoded in its own task and cut to chunk columns; the slabs
    of a chunk meet in one shuffle, in which each voxel moves once. With `multipage` files may hold any number of pages: these are
    counted in a pass of its own, and a file starts after the pages of those before it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folder)
    names = sorted((r["path"] for r in files.select("path").collect()), key=lambda p: natural_key(os.path.basename(p)))
    if not names:
        raise ValueError(f"no .tif file in {folder}")
    starts = dict(enumerate(range(len(names))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [c.as_buffer() for c in b.column(1)]
            n = [sum(1 for _ in tiff.pages(lambda at, size, d=d: d.slice(at, max(0, min(size, d.size - at))).to_pybytes())) for d in data]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["path", "n"])

    if multipage:
        pages = {r["path"]: r["n"] for r in few_blocks(files.select("path", "content")).mapInArrow(count, "path string, n long").collect()}
        starts = dict(enumerate(np.r_[0, np.cumsum([pages[p] for p in names])].tolist()[:-1]))
    order = spark.createDataFrame([(p, starts[i]) for i, p in enumerate(names)], "path string, i long")

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for r in b.to_pylist():
                a, z = tiff.from_bytes(r["content"], squeeze=False), r["i"]
                if a.shape[0] > 1 and not multipage:
                    raise ValueError("files of a stack hold one image each; read others with multipage=True")
                while len(a):
                    n = min(len(a), chunk[0] - z % chunk[0])  # up to the next layer of chunks
                    yield from _cut(a[:n], z, chunk)
                    a, z = a[n:], z + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_batches(slabs(batches))

    return rechunk(few_blocks(files.join(order, "path").select("i", "content")).mapInArrow(run, BLOCK), chunk)


def open_file(path: str):
    """A file for reading at any place: on a path that all executors see, or a url of a store that Arrow reads."""
    if "://" in path and not path.startswith("file://"):
        store, inner = pa_fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return open(path.removeprefix("file://"), "rb")


class TiffPages(DataSource):
    """Pages of one large TIFF file as blocks; each partition reads its own byte ranges.

    Options: path, cz, cy, cx (chunk shape). One partition holds the pages of one layer of chunks. Comparisons of z0, y0 and x0
    with numbers are taken over from Spark: layers outside them are no partitions, and of the pages only strips or tiles of
    blocks inside them are read. `opened`, if given, is a folder where each partition notes the segments it has read.

    Rows of blocks can be written to it as well, with the options path, shape ("z,y,x") and dtype: a big TIFF file of
    uncompressed pages, whose places follow from the shape. Tasks write their blocks to their places in a file beside the
    target on a path that all executors see; a task that runs again writes the same bytes again. The file gets its name
    when all have ended, and goes if one fails. Missing blocks stay 0.
    """

    @classmethod
    def name(cls) -> str:
        return "tiff_pages"

    def schema(self) -> str:
        return BLOCK

    def reader(self, schema) -> DataSourceReader:
        return _TiffReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _TiffWriter(self.options, overwrite)


class _Layer(InputPartition):
    def __init__(self, z0: int, pages: list):
        self.z0, self.pages = z0, pages


class _TiffReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.opened = options["path"], options.get("opened")
        self.chunk = [int(options[k]) for k in CHUNK]
        self.bounds: list[tuple[str, str, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        kinds = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "="}
        for f in filters:
            if type(f) in kinds and f.attribute in (("z0",), ("y0",), ("x0",)) and isinstance(f.value, (int, float)):
                self.bounds.append((f.attribute[0], kinds[type(f)], f.value))
            else:
                yield f

    def _wanted(self, name: str, place: int) -> bool:
        test = {">": op.gt, ">=": op.ge, "<": op.lt, "<=": op.le, "=": op.eq}
        return all(test[kind](place, value) for at, kind, value in self.bounds if at == name)

    def partitions(self) -> list[_Layer]:
        with open_file(self.path) as f:

            def read(at: int, n: int) -> bytes:
                f.seek(at)
                return f.read(n)

            found = list(tiff.pages(read))
        return [_Layer(z, found[z : z + self.chunk[0]]) for z in range(0, len(found), self.chunk[0]) if self._wanted("z0", z)]

    def read(self, partition: _Layer):
        seen = 0
        with open_file(self.path) as f:

            def read(at: int, n: int) -> bytes:
                nonlocal seen
                seen += 1
                f.seek(at)
                return f.read(n)

            h, w = partition.pages[0].shape if partition.pages else (0, 0)
            for y in [y for y in range(0, h, self.chunk[1]) if self._wanted("y0", y)]:
                xs = [x for x in range(0, w, self.chunk[2]) if self._wanted("x0", x)]
                if not xs:
                    continue
                left, right = xs[0], min(w, xs[-1] + self.chunk[2])
                band = np.stack([p.decode(read, slice(y, y + self.chunk[1]), slice(left, right)) for p in partition.pages])
                place = [partition.z0 // self.chunk[0], y // self.chunk[1]]
                yield from to_batches(_row([*place, x // self.chunk[2]], [partition.z0, y, x], band[:, :, x - left : x - left + self.chunk[2]]) for x in xs)
        if self.opened:
            with open(f"{self.opened}/{partition.z0}", "w") as note:
                note.write(str(seen))


@dataclass
class _Written(WriterCommitMessage):
    blocks: int


class _TiffWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.shape, self.dtype = tuple(int(n) for n in options["shape"].split(",")), np.dtype(options["dtype"]).newbyteorder("<")
        if "://" in self.path:
            raise ValueError("one file is written by many tasks: give a path that all executors mount")
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.aside = f"{self.path}.{uuid.uuid4().hex}"
        nz, ny, nx = self.shape
        page = ny * nx * self.dtype.itemsize
        one = len(tiff.directory((ny, nx), self.dtype, 1, 1, None, ny, [0], [0], 0, 0, True))
        self.start = 16 + nz * one  # all descriptions, then all pages
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(self.aside, "wb") as f:
            f.write(tiff.head(16, True))
            for z in range(nz):
                at = 16 + z * one
                f.write(tiff.directory((ny, nx), self.dtype, 1, 1, None, ny, [self.start + z * page], [page], at, at + one if z + 1 < nz else 0, True))
            f.truncate(self.start + nz * page)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        into, n = np.memmap(self.aside, self.dtype, "r+", self.start, self.shape), 0
        for row in block_rows(batches):
            a = as_array(row)
            at = tuple(slice(row[o], row[o] + k) for o, k in zip(("z0", "y0", "x0"), a.shape, strict=True))
            if any(x.start < 0 or x.stop > k for x, k in zip(at, self.shape, strict=True)):
                raise ValueError("a block lies outside the shape")
            into[at] = a
            n += 1
        into.flush()
        return _Written(n)

    def commit(self, messages: list) -> None:
        os.replace(self.aside, self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.aside):
            os.remove(self.aside)


def read_big_tiff(spark: SparkSession, path: str, chunk: Sequence[int], box: tuple[Sequence[int], Sequence[int]] | None = None, opened: str | None = None) -> DataFrame:
    """Blocks of one large TIFF file, in strips or tiles; with a box (start, stop) only those that meet it, and only the parts of
    the file that these need are opened."""
    ship(spark)
    spark.dataSource.register(TiffPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("tiff_pages").option("path", path)
    if opened:
        reader = reader.option("opened", opened)
    for k, n in zip(CHUNK, chunk, strict=True):
        reader = reader.option(k, str(n))
    blocks = reader.load()
    return blocks if box is None else prune_blocks(blocks, *box, chunk)


def write_big_tiff(blocks: DataFrame, path: str, shape: Sequence[int], dtype: str, overwrite: bool = False) -> None:
    """A volume of any size as one big TIFF file: each task writes the blocks it has, none of them passes the driver."""
    ship(blocks.sparkSession)
    blocks.sparkSession.dataSource.register(TiffPages)
    writer = few_blocks(blocks.select(*_NAMES)).write.format("tiff_pages").mode("overwrite" if overwrite else "append")
    writer.option("path", path).option("shape", ",".join(map(str, shape))).option("dtype", dtype).save()


def read_volume(spark: SparkSession, path: str, chunk: Sequence[int]) -> DataFrame:
    """By the kind of path: a .zarr folder, a folder of .tif files, one .tif file, or .nii / .nii.gz; else ValueError."""
    if path.rstrip("/").endswith(".zarr"):
        return read_zarr(spark, path)
    if re.search(r"\.nii(\.gz)?$", path):
        return read_single(spark, path, chunk, nifti.from_bytes)
    if path.endswith(".tif"):
        return read_big_tiff(spark, path, chunk)
    if re.search(r"\.\w+$", os.path.basename(path.rstrip("/"))):
        raise ValueError(f"no reader for {path}")
    return read_tiff_stack(spark, path, chunk)


def read_single(spark: SparkSession, path: str, chunk: Sequence[int], decode=tiff.from_bytes) -> DataFrame:
    """A small volume in one file, cut to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                a = decode(r["content"])
                a = a[None] if a.ndim == 2 else a
                for z in range(0, a.shape[0], chunk[0]):
                    for row in _cut(a[z : z + chunk[0]], z, chunk):
                        yield to_batch([row])

    return few_blocks(spark.read.format("binaryFile").load(path).select("content")).mapInArrow(run, BLOCK)


def read_zarr(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of a Zarr version 2 array of three axes: one row per stored chunk."""
    meta = json.loads(read_text(spark, folder.rstrip("/") + "/.zarray"))
    sep = meta.get("dimension_separator", ".")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    index = F.regexp_extract("path", rf"(\d+){re.escape(sep)}(\d+){re.escape(sep)}(\d+)$", 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                c = [int(v) for v in r["i"].split(sep)]
                yield to_batch([_row(c, [k * n for k, n in zip(c, meta["chunks"], strict=True)], zarr.decode(r["content"], meta, c))])

    return few_blocks(files.select(index.alias("i"), "content").where("i <> ''")).mapInArrow(run, BLOCK)


def write_zarr(blocks: DataFrame, folder: str, shape: Sequence[int], chunk: Sequence[int], dtype: str) -> None:
    """A Zarr version 2 array on a path that the executors share. Each task writes its own chunk files; a repeated task
    writes the same bytes again, and the metadata comes last, so a partial array is never read."""
    root = folder.removeprefix("file://").rstrip("/")
    os.makedirs(root, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                name = f"{root}/{zarr.chunk_name([r[k] for k in CHUNK])}"
                with open(f"{name}.{os.getpid()}", "wb") as f:
                    f.write(zarr.encode(as_array(r).astype(dtype), chunk))
                os.replace(f"{name}.{os.getpid()}", name)
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], ["n"])

    few_blocks(blocks).mapInArrow(run, "n int").agg(F.sum("n")).collect()
    with open(f"{root}/.zarray", "w") as f:
        f.write(zarr.metadata(shape, chunk, dtype))


def collect_volume(blocks: DataFrame, shape: Sequence[int], dtype: str, most: int = 1 << 30) -> np.ndarray:
    """A small volume as one array on the driver; refuses more than `most` bytes."""
    if int(np.prod(shape)) * np.dtype(dtype).itemsize > most:
        raise ValueError("the volume is too large for the driver; write blocks instead")
    a = np.zeros(shape, dtype)
    for r in blocks.toLocalIterator():
        a[tuple(slice(r[k], r[k] + r[n]) for k, n in (("z0", "nz"), ("y0", "ny"), ("x0", "nx")))] = as_array(r.asDict())
    return a


def write_single(blocks: DataFrame, path: str, shape: Sequence[int], dtype: str, most: int = 1 << 28) -> None:
    """A volume as one TIFF or NIfTI file, by the suffix. Up to `most` bytes are put together on the driver; a larger TIFF file is
    written by the tasks, a larger NIfTI file is refused."""
    nifti_file = bool(re.search(r"\.nii(\.gz)?$", path))
    if not nifti_file and int(np.prod(shape)) * np.dtype(dtype).itemsize > most:
        write_big_tiff(blocks, path, shape, dtype, overwrite=True)
        return
    a = collect_volume(blocks, shape, dtype, max(most, 1 << 30) if nifti_file else most)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "wb") as f:
        f.write(nifti.to_bytes(a, path.endswith(".gz")) if nifti_file else tiff.to_bytes(a))
