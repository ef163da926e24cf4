"""Best-fit packing of documents into token sequences (operator 7)."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavox.llm.blocks import map_batches, pick, strings
from stratavox.llm.tokens import chunk_tokenizer
from stratavox.runtime import settle, ship

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Ranges of sizes that documents and gaps are dealt over in the first round; each round has half as many.
RANGES = 16
#: Columns of runs of equal documents and gaps, and of placements; see rounds().
RUNS = "kind int, size long, first long, n long, seq long, at long"
_DOC, _GAP, _PLACED = 0, 1, 2


class SortedSizes:
    """Sizes in ascending order with successor search; used for at most as many sizes as the capacity."""

    def __init__(self) -> None:
        self.sizes: list[int] = []

    def add(self, size: int) -> None:
        at = bisect_right(self.sizes, size)
        if not at or self.sizes[at - 1] != size:
            self.sizes.insert(at, size)

    def drop(self, size: int) -> None:
        self.sizes.pop(bisect_right(self.sizes, size) - 1)

    def successor(self, size: int) -> int | None:
        at = bisect_right(self.sizes, size - 1)
        return self.sizes[at] if at < len(self.sizes) else None


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int, ids: bool) -> DataFrame:
    """Tokenised pieces of at most `capacity` ids, one or more for each document.

    part and r number the pieces of one length inside their task: with the counts of each task
    that gives a rank without sorting the pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = chunk_tokenizer(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), tok.encode(strings(b.column(1))), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    piece = raw[at : at + 4 * capacity]
                    n = len(piece) // 4
                    r = seen.get(n, 0)
                    seen[n] = r + 1
                    rows.append((doc, k, k * capacity, n, zlib.crc32(piece), r) + ((np.frombuffer(piece, "<u4").astype(np.int32),) if ids else ()))
            cols = list(zip(*rows, strict=True)) or [()] * (6 + ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * ids
            made = [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)] + [pa.array([part] * len(rows), pa.int32())]
            yield pa.RecordBatch.from_arrays(made, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "r"] + ["ids"] * ids + ["part"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, r long" + ", ids array<int>" * ids + ", part int"
    return map_batches(pick(docs, doc_id=id_col, text=text_col), run, schema, keeps=tokenizer)


def sweep(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int, opens: int | None) -> tuple[list, list, list]:
    """Best fit of runs of documents (length, first rank, how many) into runs of gaps (size, first sequence, how many).

    The longest run is taken first. Its documents go to their successor, the smallest gap that holds them: the document of
    rank i gets the gap of rank i, those beyond the last gap lose and look again among the updated gaps. If no gap holds
    them they are left over, or, with `opens`, open as many sequences as they need, numbered from there.

    Returns placements (length, first rank, how many, first sequence, offset), documents left over, and gaps left.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    order, placed, left_over = SortedSizes(), [], []

    def put(size: int, first: int, n: int) -> None:
        if size:
            if size not in free:
                free[size] = []
                order.add(size)
            free[size].append((first, n))

    for size, first, n in sorted(gaps):
        put(size, first, n)
    for length, rank, left in sorted(docs, key=lambda d: (-d[0], d[1])):
        while left:
            size = order.successor(length)
            if size is None and opens is None:
                left_over.append((length, rank, left))
                break
            if size is None:
                size, n = capacity, -(-left // (capacity // length))
                spans, opens = [(opens, n)], opens + n
            else:
                spans = free.pop(size)
                order.drop(size)
            for first, n in spans:
                take = min(n, left)
                if take:
                    placed.append((length, rank, take, first, capacity - size))
                    put(size - length, first, take)
                if take < n:
                    put(size, first + take, n - take)
                rank, left = rank + take, left - take
    return placed, left_over, [(size, first, n) for size, spans in free.items() for first, n in spans]


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit, longest first, of so many documents of each length in one sweep; rows (length, rank, how many, sequence, offset)."""
    return np.array(sweep([(x, 0, n) for x, n in counts.items()], [], capacity, 0)[0], np.int64).reshape(-1, 5)


def _sweep_range(capacity: int, opens: int | None):
    def run(table: pa.Table) -> pa.Table:
        rows = [tuple(r.values()) for r in table.select(["kind", "size", "first", "n"]).to_pylist()]
        placed, docs, free = sweep([r[1:] for r in rows if r[0] == _DOC], [r[1:] for r in rows if r[0] == _GAP], capacity, opens)
        out = [(_PLACED, *p) for p in placed] + [(_DOC, *d, 0, 0) for d in docs] + [(_GAP, *g, 0, 0) for g in free]
        cols = list(zip(*out, strict=True)) or [()] * 6
        return pa.table([pa.array(list(c), pa.int64() if i else pa.int32()) for i, c in enumerate(cols)], ["kind", "size", "first", "n", "seq", "at"])

    return run


def rounds(classes: DataFrame, capacity: int) -> DataFrame:
    """Bulk-synchronous best fit of documents in classes (length, n); rows (length, rank, n, sequence, offset).

    Documents of more than half the capacity can't share a sequence, so each opens its own. Then rounds follow: documents left
    and gaps are dealt over ranges of sizes and sorted, each range sweeps its documents, longest first, to their successors
    among its gaps, rank deciding who gets which, and the updated gaps and the documents without a gap go on to the next round
    with ranges twice as wide. A gap serves documents of about its own size first, so what narrow ranges place fits
    tightly; the last round has one range, and what fits nowhere there opens sequences.

    Lengths are whole numbers up to the capacity, so rows are runs of equal documents or gaps, and what a range holds
    follows the capacity, whatever the number of documents.
    """
    ship(classes.sparkSession)
    far = F.col("length") > capacity // 2
    seq, zero = F.col("length") * F.lit(1 << 40), F.lit(0).cast("long")  # numbers of their own for each length

    def row(kind: int, size, first, n, at_seq, at) -> list:
        return [F.lit(kind).alias("kind"), *(c.cast("long").alias(x) for c, x in zip((size, first, n, at_seq, at), ("size", "first", "n", "seq", "at"), strict=True))]

    length, n = F.col("length"), F.col("n")
    opened = classes.where(far).select(*row(_PLACED, length, zero, n, seq, zero))
    gaps = classes.where(far & (length < capacity)).select(*row(_GAP, F.lit(capacity) - length, seq, n, zero, zero))
    state = settle(classes.where(~far).select(*row(_DOC, length, zero, n, zero, zero)).unionByName(gaps), "runs")
    done = [opened]
    for k in range((RANGES - 1).bit_length(), -1, -1):
        width = -(-(capacity + 1) >> k) + 1
        dealt = state.where(F.col("kind") != _PLACED).groupBy(F.floor(F.col("size") / width))
        state = settle(dealt.applyInArrow(_sweep_range(capacity, None if k else 1 << 60), RUNS), "runs")
        done.append(state.where(F.col("kind") == _PLACED))
    return reduce(DataFrame.unionByName, done).select(F.col("size").alias("length"), F.col("first").alias("rank"), "n", F.col("seq").alias("sequence"), F.col("at").alias("offset"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the token ids if asked for.

    A null text counts as empty and gives the end id alone; repeated rows are packed each; a null id is
    kept; other columns don't matter. Ties of length go by rank, so sequence numbers may differ between clusters, the number of
    sequences does not. No rows: no rows. Only the placements of runs reach the driver.
    """
    tokenizer = tokenizer or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    cut = settle(pieces(docs, id_col, text_col, tokenizer, capacity, end_id, ids), "pieces")
    held = settle(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "held")
    placements = rounds(held.groupBy("length").agg(F.sum("n").alias("n")), capacity).orderBy("length", "rank").toPandas()
    plan = placements.to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(plan)  # its size follows the capacity, not the documents
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base.hint("shuffle_hash"), ["part", "length"])  # a row for each task and length: too many to broadcast
    extra = ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        starts = rows[:, 0] << 44 | rows[:, 1]
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "rank"))
            at = np.searchsorted(starts, length << 44 | rank, side="right") - 1
            seq, off = rows[at, 3] + rank - rows[at, 1], rows[at, 4]
            same = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", *extra)]
            yield pa.RecordBatch.from_arrays([*same[:5], pa.array(seq), pa.array(off), *same[5:]], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *extra])

    wanted = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("r")).alias("rank"), *extra)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * ids
    return map_batches(wanted, run, schema)
