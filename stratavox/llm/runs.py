"""Periodic runs of words (operator 11): stretches that repeat one phrase at least four times."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stratavox.llm.blocks import map_batches, pick, raw_bytes

#: A run has at least this many words, and this many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of texts that share one suffix array, unless a single text has more; grid pairs that are looked at together.
GROUP_WORDS, GRID_PAIRS = 1 << 17, 1 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words of one text have one number, counted from 0."""
    known: dict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def grid_pairs(s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The harmonic grid: (i, p) for each period p and multiple i of p, in parts. A run of four periods covers four multiples
    of its period, so only pairs are given where the words at i, i + p, i + 2p and i + 3p are equal."""
    n = len(s)
    periods = np.arange(1, n // LEAST_PERIODS + 1)
    counts = (n - 1) // periods - (LEAST_PERIODS - 2)
    periods, counts = periods[counts > 0], counts[counts > 0]
    ends = np.cumsum(counts)
    first = 0
    while first < len(periods):
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + GRID_PAIRS, side="right")))
        p = np.repeat(periods[first:last], counts[first:last])
        i = (np.arange(done, int(ends[last - 1])) - np.repeat(ends[first:last] - counts[first:last], counts[first:last])) * p
        for k in range(1, LEAST_PERIODS):
            same = np.flatnonzero(s[i] == s[i + k * p])
            i, p = i[same], p[same]
        if len(i):
            yield i, p
        first = last


class Extensions:
    """Longest common extensions of positions of a sequence: a suffix array by doubling, the common prefixes of neighbours in
    it, and a sparse table of their range minima. About 200 bytes a word while it is built."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        rank = np.unique(s, return_inverse=True)[1].astype(np.int32)
        levels = [rank]
        width = 1
        while width < n and int(levels[-1].max()) < n - 1:
            after = np.zeros(n, np.int64)
            after[:-width] = rank[width:].astype(np.int64) + 1
            key = rank.astype(np.int64) * (n + 1) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int32)
            rank[order] = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
            levels.append(rank)
            width *= 2
        self.rank = rank
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(max(0, n - 1), np.int32)
        for k in range(len(levels) - 1, -1, -1):  # the longest power of two first
            level = np.r_[levels[k], -1]
            same = (a < n) & (b < n)
            same[same] = level[a[same]] == level[b[same]]
            step = same.astype(np.int64) << k
            common += step.astype(np.int32)
            a, b = np.minimum(a + step, n), np.minimum(b + step, n)
        self.least = [common]
        half = 1
        while 2 * half <= len(common):
            prev = self.least[-1]
            self.least.append(np.minimum(prev[:-half], prev[half:]))
            half *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on; i and j differ."""
        x, y = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            table = self.least[level]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << level)])
        return out


def find_runs(texts: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Runs (start, length, period) of each text, by start and period, from the grid pairs of each.

    The texts stand in one sequence, each with numbers of its own and a separator of its own, so nothing extends from one into
    another. A pair (i, i + p) extends backward and forward to a stretch of period p; among equal stretches the smallest
    period counts, as larger ones are its multiples.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.r_[0, np.cumsum(sizes)]
    base = np.r_[0, np.cumsum([int(t.max()) + 2 if len(t) else 1 for t in texts])]
    whole = np.concatenate([np.r_[t.astype(np.int64) + b, nxt - 1] for t, b, nxt in zip(texts, base[:-1], base[1:], strict=True)])
    n = len(whole)
    ahead, back = Extensions(whole), Extensions(whole[::-1])
    out = []
    for (i, p), lo, size in zip(pairs, starts, sizes - 1, strict=False):
        found = np.zeros((0, 3), np.int64)
        for at in range(0, len(i), GRID_PAIRS):
            a, q = i[at : at + GRID_PAIRS] + lo, p[at : at + GRID_PAIRS].astype(np.int64)
            forward = ahead(a, a + q)
            behind = np.zeros(len(a), np.int64)
            inner = np.flatnonzero(a > lo)
            behind[inner] = back(n - a[inner], n - a[inner] - q[inner])  # the words before both places
            length = behind + q + forward
            good = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
            new = np.stack([(a - behind - lo)[good], length[good], q[good]], axis=1)
            both = np.concatenate([found, new])
            both = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))]
            first = np.ones(len(both), bool)
            first[1:] = (both[1:, :2] != both[:-1, :2]).any(axis=1)
            found = both[first]
        out.append(found[np.lexsort((found[:, 2], found[:, 0]))])
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """False for the words that a run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def strongest(runs: np.ndarray) -> dict | None:
    """The run with the greatest length / period, compared in whole numbers; ties go to the smallest start, then period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return None if best is None else dict(zip(("start", "length", "period"), best, strict=True))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, top, collapsed): the periodic runs of the words of whole texts.

    Words are what stands between ASCII white space. A run is a stretch with a smallest period q, that is, words q apart are
    identical, of max(6, 4q) words or more, which no neighbouring word extends. `runs` holds (start, length, period) by start and
    period, `top` the one with the greatest length / period (null without runs), and `collapsed` the words that no run contains
    after its first period, joined by blanks.

    Runs are found on the harmonic grid: for each period p the longest common extensions forward and backward of jp and (j + 1)p,
    from suffix arrays of the text and of its reverse. Texts without four equal words on a grid have no run and no suffix array.

    A null or empty text has no words and collapses to an empty one; repeated rows and null ids are kept; other columns don't
    matter; no rows: no rows. A text of any length is one group of its own, with memory in proportion to its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = raw_bytes(b.column(1))
            size, runs, collapsed = [0] * len(raw), [np.zeros((0, 3), np.int64)] * len(raw), [b""] * len(raw)
            held: list[tuple[int, list[bytes], np.ndarray, tuple[np.ndarray, np.ndarray]]] = []

            def finish(held=held, runs=runs, collapsed=collapsed) -> None:
                for (k, words, _, _), found in zip(held, find_runs([h[2] for h in held], [h[3] for h in held]) if held else [], strict=True):
                    runs[k] = found
                    collapsed[k] = b" ".join(compress(words, kept_words(len(words), found)) if len(found) else words)
                held.clear()

            waiting = 0
            for k, text in enumerate(raw):
                words = text.split()
                size[k] = len(words)
                s = word_numbers(words)
                parts = list(grid_pairs(s))
                if not parts:
                    collapsed[k] = b" ".join(words)
                    continue
                held.append((k, words, s, tuple(np.concatenate(x) for x in zip(*parts, strict=True))))
                waiting += len(words)
                if waiting >= GROUP_WORDS:
                    finish()
                    waiting = 0
            finish()
            flat = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
            ends = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), lists, pa.array([strongest(r) for r in runs], _RUN), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "top", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(pick(docs, doc_id=id_col, text=text_col), run, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, top {RUN}, collapsed string", rows=200)


def plant_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with runs planted in a tenth of the texts, chosen by h = crc32 of the id in decimal: if h % 10 is 0, each of
    the n words from a = g % n on becomes the word a + (i - a) % p, where g is h // 10 and p is 1 + (n - a) // (3 + g % 8). Such
    texts have single blanks between words; all others, null texts and rows with a null id stay as they are."""

    def planted(doc: int, text: bytes) -> bytes:
        words, g = text.split(), zlib.crc32(str(doc).encode()) // 10
        n = len(words)
        if not n:
            return text
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text = b.column(0).to_pylist(), b.column(1)
            chosen = pa.array([d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d in ids], pa.bool_())
            chosen = pc.and_(chosen, text.is_valid())
            at = np.flatnonzero(np.asarray(chosen)).tolist()
            new = [planted(ids[i], t) for i, t in zip(at, raw_bytes(text.take(pa.array(at, pa.int64()))), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pc.replace_with_mask(text, chosen, pa.array(new, pa.binary()).cast(text.type))], ["doc_id", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(pick(docs, doc_id=id_col, text=text_col), run, f"doc_id {kind}, text string")
