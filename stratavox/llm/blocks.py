"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.runtime import ARROW_BYTES, arrow_batches


def pick(docs: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under new names: other columns may hold any name without a clash."""
    return docs.select(*[docs[old].alias(new) for new, old in cols.items()])


#: What this Python worker keeps from task to task, by name.
_kept: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object that the tasks of one operator share in a worker."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def evict(keeps: str | None) -> None:
    """Free all but one object. A function of its own, since only those act on the worker's module and not on a copy."""
    for name in [n for n in _kept if n != keeps]:
        del _kept[name]


@lru_cache(1)
def _trim() -> Callable[[], None]:
    """Hand what this worker has freed back to the system, as idle workers stay for a while: the C library's, where it has that,
    and Arrow's."""
    try:
        freed = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return pa.default_memory_pool().release_unused

    def both() -> None:
        pa.default_memory_pool().release_unused()
        freed(0)

    return both


#: Rows of texts that are worked on together.
ROWS = 1000


def resized(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` rows; shorter ones are joined as long as they stay within it and within
    runtime.ARROW_BYTES. Empty batches pass."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for b in batches:
        if held and (n + b.num_rows > rows or size + b.nbytes > ARROW_BYTES):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, size = [], 0, 0
        if b.num_rows >= rows or not b.num_rows:
            for at in range(0, max(1, b.num_rows), rows):
                yield b.slice(at, rows)
        else:
            held.append(b)
            n, size = n + b.num_rows, size + b.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: str | None = None, rows: int = ROWS) -> DataFrame:
    """mapInArrow with batches of at most `rows` rows and runtime.ARROW_BYTES. A task of one operator frees what another
    operator has kept in its worker."""
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evict(keeps)
        yield from fn(resized(batches, rows))
        _trim()()

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, text_col: str, keep: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Rows whose text passes, all columns as they are: one pass, no join and no shuffle. A null text counts as empty."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(strings(b.column(at))), pa.bool_()))

    return map_batches(df, run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes))


def raw_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def one_text(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, y, text): one row for each of so few ids (id, y) that they can be broadcast, combined before the shuffle, however often
    an id is repeated."""
    found = pick(docs, id=id_col, text=text_col).join(F.broadcast(ids), "id")
    return found.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def crc_bucket(key: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(key).cast("string").cast("binary") if isinstance(key, str) else key) % F.lit(n)


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its local component: linear in nodes, not in pairs."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[i], root[j])
        nxt = root.copy()
        np.minimum.at(nxt, root[i], low)
        np.minimum.at(nxt, root[j], low)
        nxt = nxt[nxt]
        while not np.array_equal(nxt, nxt[nxt]):
            nxt = nxt[nxt]
        if np.array_equal(nxt, root):
            break
        root = nxt
    far = root != np.arange(len(ids))
    return ids[far], ids[root[far]]


class WordMemo(dict):
    """A memo of a function of a word, bounded by bytes. Words of natural text are Zipfian, so two generations
    keep the frequent ones: when the young one is full it becomes the old one. Long words are not kept. Results never
    depend on it."""

    #: Bytes of a dictionary entry beside its key and value.
    ENTRY = 120

    def __init__(self, fn: Callable, size: int = 32 << 20, longest: int = 200):
        super().__init__()
        self.fn, self.size, self.longest, self.held, self.old = fn, size, longest, 0, {}

    def __missing__(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.fn(word)
        self.keep(word, found)
        return found

    def keep(self, word, found) -> None:
        """Take a result that is known from elsewhere."""
        if len(word) > self.longest:
            return
        if self.held >= self.size:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += getsizeof(word) + getsizeof(found) + self.ENTRY
        self[word] = found
