"""Quality classifier: a generalised additive model with pairwise interactions (operator 1)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.llm.blocks import crc_bucket, map_batches, one_text, pick, raw_bytes

#: Labelled rows that the model is fitted on, those with the smallest hash of the id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "upper", "lower", "digit", "space", "wide", "stop", "comma", "exclaim", "question",
    "pipe", "symbol", "bracket", "unique_words", "top_word", "repeat_next", "marked_words", "bytes_per_line", "unique_lines", "ended_lines",
)
_GROUPS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t\n\r\x0b\x0c", "wide": range(128, 256), "stop": b".", "comma": b",", "exclaim": b"!", "question": b"?", "pipe": b"|", "symbol": b"*%$&#@^~=+\\/_<>", "bracket": b"()[]{}"}
_SHARES = np.zeros((256, len(_GROUPS)))
for _j, _g in enumerate(_GROUPS.values()):
    _SHARES[list(_g), _j] = 1
_WORD_END = tuple(bytes([c]) for c in b"*%$&#@!^~=+")


def features(text: bytes) -> np.ndarray:
    """FEATURES of one whole UTF-8 text; all zero for an empty one."""
    out = np.zeros(len(FEATURES))
    n = len(text)
    if not n:
        return out
    words, lines = text.split(), text.split(b"\n")
    w = max(1, len(words))
    out[3:15] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _SHARES / n
    out[:3] = np.log1p(n), np.log1p(len(words)), n / w
    if words:
        times = Counter(words)
        out[15:19] = len(times) / w, max(times.values()) / w, sum(map(eq, words, words[1:])) / w, sum(k * x.endswith(_WORD_END) for x, k in times.items()) / w
    out[19:22] = n / len(lines), len(set(lines)) / len(lines), sum(x.endswith((b".", b"!", b"?")) for x in lines) / len(lines)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g / (h + l2)


def _gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


@dataclass
class AdditiveModel:
    """logit = intercept + sum of one-dimensional tables + sum of two-dimensional tables over binned features."""

    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]) if len(self.cuts) else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[b[:, i], b[:, j]]
        return _sigmoid(z)

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, max_bins: int = 48, rounds: int = 150, rate: float = 0.1, n_pairs: int = 8, pair_rounds: int = 60, l2: float = 2.0) -> AdditiveModel:
        """Cyclic boosting: each round gives every feature in turn one shallow tree (two splits) of its bins, then
        every chosen pair one tree that splits the first feature and each side by the second."""
        m = AdditiveModel()
        if not len(y) or y.min() == y.max():
            m.intercept = 0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
            return m
        for j in range(x.shape[1]):
            m.cuts.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])))
        b = m.bins(x)
        sizes = [len(c) + 1 for c in m.cuts]
        m.tables = [np.zeros(s) for s in sizes]
        m.intercept = float(np.log(y.sum() / (len(y) - y.sum())))
        z = np.full(len(y), m.intercept)
        for _ in range(rounds):
            for j, s in enumerate(sizes):
                if s < 2:
                    continue
                p = _sigmoid(z)
                step = rate * _tree(np.bincount(b[:, j], y - p, s), np.bincount(b[:, j], p * (1 - p), s), l2)
                m.tables[j] += step
                z += step[b[:, j]]
        p = _sigmoid(z)
        g, h = y - p, p * (1 - p)
        ranked = sorted(((_pair_gain(*_grid(b, i, j, sizes, g, h), l2), i, j) for i, j in combinations(range(len(sizes)), 2) if min(sizes[i], sizes[j]) > 1), reverse=True)
        m.pairs = [(i, j) for _, i, j in ranked[:n_pairs]]
        m.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in m.pairs]
        for _ in range(pair_rounds):
            for k, (i, j) in enumerate(m.pairs):
                p = _sigmoid(z)
                step = rate * _pair_tree(*_grid(b, i, j, sizes, y - p, p * (1 - p)), l2)
                m.pair_tables[k] += step
                z += step[b[:, i], b[:, j]]
        return m


def _split(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Best gain and cut of a row of bins; a cut k puts bins below k to the left."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(cg):
        return 0.0, 0
    gains = _gain(cg, ch, l2) + _gain(g.sum() - cg, h.sum() - ch, l2) - _gain(g.sum(), h.sum(), l2)
    k = int(gains.argmax())
    return float(gains[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """Leaf values per bin of a tree with two splits."""
    _, k = _split(g, h, l2)
    left, right = _split(g[:k], h[:k], l2), _split(g[k:], h[k:], l2)
    edges = sorted({0, k, len(g)} | ({left[1]} if left[0] > right[0] else {k + right[1]} if right[0] > 0 else set()))
    out = np.zeros(len(g))
    for a, z in zip(edges, edges[1:], strict=False):
        out[a:z] = _leaf(g[a:z].sum(), h[a:z].sum(), l2)
    return out


def _grid(b: np.ndarray, i: int, j: int, sizes: list[int], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat, shape = b[:, i] * sizes[j] + b[:, j], (sizes[i], sizes[j])
    return np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape)


def _quadrants(g: np.ndarray) -> list[np.ndarray]:
    c = np.cumsum(np.cumsum(g, 0), 1)
    a, row, col, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
    return [a, row - a, col - a, all_ - row - col + a]


def _pair_gain(g: np.ndarray, h: np.ndarray, l2: float) -> float:
    return float(sum(_gain(x, y, l2) for x, y in zip(_quadrants(g), _quadrants(h), strict=True)).max())


def _pair_tree(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    _, k = _split(g.sum(1), h.sum(1), l2)
    out = np.zeros(g.shape)
    for rows in (slice(0, k), slice(k, len(g))):
        gr, hr = g[rows].sum(0), h[rows].sum(0)
        _, c = _split(gr, hr, l2)
        out[rows, :c], out[rows, c:] = _leaf(gr[:c].sum(), hr[:c].sum(), l2), _leaf(gr[c:].sum(), hr[c:].sum(), l2)
    return out


def extract(docs: DataFrame, keep: tuple[str, ...], text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in raw_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    rows = docs.select(*keep, F.col(text_col).alias("text"))
    return map_batches(rows, run, ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "text") + ", x array<double>")


def label_sample(labels: DataFrame, id_col: str, label_col: str, use: Column | None, rows: int) -> DataFrame:
    """(id, y): one row per labelled id, those with the smallest hash of the id, so the sample has no order of its own."""
    found = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull())
    if use is not None:
        found = found.where(use)
    each = found.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    return each.orderBy(F.xxhash64("id"), "id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", use: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on at most `sample_rows` labelled documents that `use` admits; only their features reach the driver.

    Of documents that share an id one text is learned from, that with the smallest hash; of several labels of an id the mean
    decides, half counting as 1. Null texts count as empty, ids that are null or have no document add nothing, other columns
    don't matter; without rows the model gives all texts one score.
    """
    ids = label_sample(labels, id_col, label_col, use, sample_rows)
    chosen = one_text(docs, ids, id_col, text_col).select("y", "text")
    got = extract(chosen, ("y",), "text").toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    return AdditiveModel.fit(x, got["y"].to_numpy(float))


def classify(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row's whole text; a null text counts as empty, repeated rows and null ids get a row each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of at most 48 x 48 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in raw_bytes(b.column(1))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return map_batches(pick(docs, doc_id=id_col, text=text_col), run, "doc_id long, score double")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(crc_bucket(key, 5) == 0, F.lit(False))


def learnable(key: str = "doc_id") -> Column:
    return crc_bucket(key, 5) != 0
