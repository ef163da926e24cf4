"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.llm.blocks import map_batches, pick, raw_bytes, star_edges
from stratavox.llm.golay import codewords
from stratavox.operators.components import connected_components
from stratavox.runtime import settle

#: Fingerprints that share a key before the key is dealt out over several cells.
HOT = 2048
#: Words of a text that are hashed at a time; bounds memory on very long texts.
BLOCK_WORDS = 1 << 17
#: Fingerprints whose keys are made at a time.
KEYED = 4096
#: Bits of the three segments of a fingerprint, from the lowest.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint_bytes(text: bytes, shingle: int = 3) -> int:
    """SimHash of one UTF-8 text: XXH64 (seed 42) of its word shingles, majority of each bit; no word gives 0."""
    words = text.lower().split()  # bytes.lower() touches A-Z only, bytes.split() cuts at [\x20\x09-\x0D]
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    ones, n = np.zeros(64, np.int64), len(words) - shingle + 1
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK_WORDS):
        part = words[at : at + BLOCK_WORDS + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        h = np.fromiter((hashed(g, 42) for g in grams), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint_bytes(t, shingle) for t in raw_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_batches(pick(docs, doc_id=id_col, text=text_col), run, "doc_id long, fp long")


def _mix(kind: int, *parts: np.ndarray) -> np.ndarray:
    """A 64-bit key of a kind and up to 56 bits of parts (value, bits); injective, so no key is shared by accident."""
    key = np.zeros(parts[0][0].shape, np.int64)
    for value, bits in parts:
        key = key << bits | value
    return key | kind << 56


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, role, position in fp) of each fingerprint; role 0 is looked up by role 1.

    Three bits at most may differ. Over three segments either one segment is equal and another differs
    in at most one bit, or each differs in exactly one. In the first case the pair meets in (equal
    segment i, Golay index of segment j); in the second in (Golay index of the first segment, one equal
    half of each other one). On the looked-up side a segment gives the index of its nearest codeword,
    on the asking side those of all codewords within distance 4.
    """
    u = fp.view(np.uint64)
    seg = [(u >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [codewords(s) for s in seg]
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    pos = np.arange(len(fp))

    def add(kind: int, golay: np.ndarray, *exact: tuple[np.ndarray, int]) -> None:
        out.append((_mix(kind, (golay[:, 0], 12), *exact), 0, pos))
        for c in range(golay.shape[1]):
            has = golay[:, c] >= 0
            if has.any():
                out.append((_mix(kind, (golay[has, c], 12), *((v[has], n) for v, n in exact)), 1, pos[has]))

    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                add(kind, near[j], (seg[i], SEGMENTS[i][1]))
                kind += 1
    halves = [((seg[i] & 0x3FF, 10), (seg[i] >> 10, 11)) for i in (1, 2)]
    for x in halves[0]:
        for y in halves[1]:
            add(kind, near[0], x, y)
            kind += 1
    return np.concatenate([k for k, _, _ in out]), np.repeat(np.array([r for _, r, _ in out], np.int8), [len(k) for k, _, _ in out]), np.concatenate([p for _, _, p in out])


def _key_rows(roles: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = np.asarray(b.column(0))
            for at in range(0, len(every), KEYED):
                fp = every[at : at + KEYED]
                k, r, p = keys(fp)
                if roles != (0, 1):
                    k, r, p = k[r == 0], r[r == 0], p[r == 0]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(r), pa.array(fp[p])], ["k", "r", "fp"])

    return run


def _pairs(index: np.ndarray, ask: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one cell within so many bits, compared block by block."""
    a, b = [], []
    for at in range(0, len(index), 1024):
        x = index[at : at + 1024]
        i, j = np.nonzero(np.bitwise_count(x[:, None] ^ ask[None, :]) <= bits)
        keep = x[i] != ask[j]
        a.append(x[i][keep])
        b.append(ask[j][keep])
    return np.concatenate(a), np.concatenate(b)


def _runs_to_edges(bits: int):
    """Rows sorted by cell become star edges. One cell holds at most about HOT rows of each role, so it fits in memory."""

    def of(cell: np.ndarray, r: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero(np.any(cell[1:] != cell[:-1], axis=1)) + 1
        start, end = np.r_[0, cut], np.r_[cut, len(fp)]
        asks = np.add.reduceat(r.astype(np.int64), start)
        has = (asks > 0) & (asks < end - start) & ~((end - start == 2) & (fp[start] == fp[end - 1]))
        start, end, asks = start[has], end[has], asks[has]
        a, b = [], []
        # rows of a cell are ordered by role: first those that are looked up
        held = end - start - asks
        small = held * asks <= 4096
        s, h, q = start[small], held[small], asks[small]
        n = h * q
        if n.sum():
            which = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x, y = fp[s[which] + k // q[which]], fp[s[which] + h[which] + k % q[which]]
            ok = (x != y) & (np.bitwise_count(x ^ y) <= bits)
            a.append(x[ok])
            b.append(y[ok])
        for s, e, h in zip(start[~small], end[~small], held[~small], strict=True):
            x, y = _pairs(fp[s : s + h], fp[s + h : e], bits)
            x, y = star_edges(x.view(np.int64), y.view(np.int64))
            a.append(x.view(np.uint64))
            b.append(y.view(np.uint64))
        if not a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return star_edges(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [np.column_stack([np.asarray(b.column(i)) for i in (0, 1)]), np.asarray(b.column(2)), np.asarray(b.column(3)).view(np.uint64)]
            if left is not None:
                now = [np.concatenate(x) for x in zip(left, now, strict=True)]
            last = np.flatnonzero(np.any(now[0] != now[0][-1], axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                x, y = of(*(v[:cut] for v in now))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
            left = [v[cut:] for v in now]
        if left is not None:
            x, y = of(*left)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return run


def link_edges(distinct: DataFrame, bits: int = 3, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all pairs within the given bits.

    Rows of a key are compared where they meet; a key that more than `hot` fingerprints are looked up by is
    dealt over a grid of cells, each pairing one part of either side, so no task holds the whole key and
    no pair is lost. A cell gives star edges only: linear in its rows.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the Golay keys find fingerprints within 0 to 3 bits")
    rows = map_batches(distinct.select("fp"), _key_rows((0, 1)), "k long, r byte, fp long")
    held = map_batches(distinct.select("fp"), _key_rows((0,)), "k long, r byte, fp long")
    many = settle(held.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("k", F.ceil(F.col("n") / hot).cast("int").alias("cells")), "hot")
    if many.isEmpty():
        rows = rows.withColumn("cell", F.lit(0).cast("long"))
    else:
        part = F.pmod(F.xxhash64("fp"), F.col("cells").cast("long"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells").cast("long") - 1))
        warm = rows.join(many, "k").select("*", part.alias("own"), other.alias("over"))
        warm = warm.select("k", "r", "fp", F.when(F.col("r") == 0, F.col("own") * F.col("cells") + F.col("over")).otherwise(F.col("over") * F.col("cells") + F.col("own")).alias("cell"))
        rows = rows.join(many, "k", "left_anti").withColumn("cell", F.lit(0).cast("long")).unionByName(warm)
    dealt = rows.select("k", "cell", "r", "fp").repartition("k", "cell").sortWithinPartitions("k", "cell", "r")
    return map_batches(dealt, _runs_to_edges(bits), "a long, b long", rows=100_000)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3, shingle: int = 3) -> DataFrame:
    """One row per input row: doc_id, fp long, component_id, the smallest doc_id reachable by links of at most
    `bits` differing bits.

    Null or empty text: fingerprint zero, linked like any other. Repeated rows: each gets its own output row.
    Null ids: a row of its own, never a component's id unless no other id is there (then null). No rows: no rows.
    """
    fps = settle(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    # exact copies meet here, before any join: the groups are summed up on the map side
    distinct = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(link_edges(distinct, bits))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = settle(named.join(least, "root").select("fp", "component_id"), "labels")
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: str = "fp"):
    """16 lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def brute_force(rows: list[tuple[int, str]], bits: int = 3) -> dict[int, int]:
    """component_id of each id by comparing all pairs; for tests."""
    fp = {i: fingerprint_bytes((t or "").encode()) for i, t in rows}
    root = {i: i for i in fp}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(fp), 2):
        if (fp[i] ^ fp[j]).bit_count() <= bits:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return {i: top(i) for i in fp}
