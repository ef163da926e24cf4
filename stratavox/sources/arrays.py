"""Block tables from tables with one array of values per chunk."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratavox.operators.volumes import as_row, few_blocks, slices, to_batches
from stratavox.plans.schema import BLOCK, CHUNK


def blocks_of_arrays(table: DataFrame, id_col: str, values_col: str, chunk: Sequence[int], grid: Sequence[int], offset: float = 0, scale: float = 1) -> DataFrame:
    """Blocks of 32-bit integers floor((value + offset) * scale) from rows (id, values): ids count the chunks in row-major order on
    a grid of so many chunks along y and x, values the voxels of a chunk. Rows whose id or values are null, or hold another
    number of values, are errors."""
    gy, gx = grid

    def block(i: int, values: list) -> dict:
        if i is None or values is None or len(values) != prod(chunk):
            raise ValueError(f"chunk {i} does not hold {prod(chunk)} values")
        c = [i // (gy * gx), i // gx % gy, i % gx]
        v = np.floor((np.array(values, np.float64) + offset) * scale).astype(np.int32).reshape(chunk)
        return as_row(dict(zip((*CHUNK, "z0", "y0", "x0"), [*c, *(n * k for n, k in zip(chunk, c, strict=True))], strict=True)), v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_batches(block(i, e) for b in slices(batches) for i, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

    return few_blocks(table.select(id_col, values_col)).mapInArrow(run, BLOCK)
