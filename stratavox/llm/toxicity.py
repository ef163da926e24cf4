"""Toxic spans and documents by a linear-chain conditional random field (operator 2)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.llm.blocks import WordMemo, crc_bucket, map_batches, one_text, pick, strings

#: Labelled documents of each class that the model is fitted on, those with the smallest hash of the id.
SAMPLE_ROWS = 1000
#: Characters of the longest text that is learned from.
MOST_CHARS = 200_000
#: Hashed weights of the emission features.
TABLE = 1 << 18
#: Tokens of one segment of the parallel forward-backward pass.
SEGMENT = 128
#: Tokens of documents that go through the pass together.
GROUP = 200_000
THRESHOLD = 0.5
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_TOKEN = re.compile(r"\S+")


def core(token: str) -> str:
    """A token in lower case without the marks around it."""
    return _EDGE.sub("", token.lower())


def word_features(token: str) -> list[str]:
    """Features of one token: its word, its beginnings and its end."""
    w = core(token)
    if not w:
        return ["mark"]
    return ["w:" + w] + [f"p{n}:" + w[:n] for n in (3, 4, 5, 6) if len(w) > n] + (["s3:" + w[-3:]] if len(w) > 3 else [])


def slot(feature: str) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) % TABLE


def _near_copy_key(text: str) -> int:
    """Smallest hash of four-word shingles: near copies nearly always share it, other texts hardly ever."""
    w = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 3))), default=0)


def token_labels(texts: list[str], toxic: list[int], min_odds: float = 3.0, min_share: float = 0.01, min_surprise: float = 6.0) -> set[str]:
    """Words and word beginnings that mark toxic tokens, found from labels of whole documents.

    A feature marks a token if at least `min_share` of the toxic documents (three at least) have it, its
    log-odds against the other documents is `min_odds` or more, and it is no accident: the Chernoff bound on so many
    of its documents being toxic is below exp(-min_surprise). Near copies count once, else any word of a text with
    many copies would look typical of its label.
    """
    seen: set[int] = set()
    has: tuple[Counter, Counter] = Counter(), Counter()
    size = [0, 0]
    for text, y in zip(texts, toxic, strict=True):
        key = _near_copy_key(text)
        if key in seen:
            continue
        seen.add(key)
        size[y] += 1
        own: set[str] = set()
        for token in set(text.split()):
            own.update(f for f in word_features(token) if f[0] in "wp")
        has[y].update(own)
    least = max(3, min_share * size[1])
    odds = lambda f: math.log((has[1][f] + 0.5) / (size[1] + 1)) - math.log((has[0][f] + 0.5) / (size[0] + 1))
    share = (size[1] + 1) / (sum(size) + 2)

    def surprise(f: str) -> float:
        a, b = has[1][f], has[0][f]
        return a * math.log(a / (a + b) / share) + (b * math.log(b / (a + b) / (1 - share)) if b else 0.0)

    return {f for f, n in has[1].items() if n >= least and odds(f) >= min_odds and surprise(f) >= min_surprise}


@dataclass
class TagModel:
    """Weights for label 1 against label 0 of a token, label transitions, and the document calibration."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray  # (2, 2) log potentials
    calibration: np.ndarray  # over doc_features
    memo: WordMemo | None = None

    def __getstate__(self):
        return self.__dict__ | {"memo": None}

    def emission(self, token: str) -> float:
        return self.bias + float(sum(self.weights[slot(f)] for f in word_features(token)))

    def emissions(self, tokens: list[str]) -> np.ndarray:
        if self.memo is None:
            self.memo = WordMemo(self.emission)
        return np.fromiter(map(self.memo.__getitem__, tokens), np.float64, len(tokens))


def marginals(e: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(label 1) of every token of a batch of chains laid end to end."""
    alpha, beta = messages(e, sizes, trans)
    both = alpha * beta
    return both[:, 1] / both.sum(1)


def messages(e: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of every token, each scaled to a maximum of 1, by exact forward-backward.

    Chains are cut into segments. The product of a segment's transfer matrices, taken for all segments at
    once, carries messages from segment to segment; then all segments run forward and backward from
    their own starting messages. Python steps follow the segment length, not the chain length.
    """
    if len(sizes) > 1 and sizes.sum() > GROUP:  # a bounded number of tokens at a time
        half = max(1, min(len(sizes) - 1, int(np.searchsorted(np.cumsum(sizes), sizes.sum() / 2))))
        at = int(sizes[:half].sum())
        each = [messages(e[:at], sizes[:half], trans), messages(e[at:], sizes[half:], trans)]
        return tuple(np.concatenate(x) for x in zip(*each, strict=True))
    a = np.exp(trans - trans.max())
    n_seg = -(-sizes // SEGMENT)
    total = int(n_seg.sum())
    if not total:
        return np.ones((0, 2)), np.ones((0, 2))
    chain = np.repeat(np.arange(len(sizes)), n_seg)
    rank = np.arange(total) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
    begin = (np.cumsum(sizes) - sizes)[chain] + rank * SEGMENT
    length = np.minimum(sizes[chain] - rank * SEGMENT, SEGMENT)
    col = np.arange(SEGMENT)
    real = col[None, :] < length[:, None]
    at = np.where(real, begin[:, None] + col[None, :], 0)
    odds = np.exp(np.clip(e, -40, 40))[at]
    # forward transfer: row vector (alpha0, alpha1) times A times diag(1, odds)
    m = np.broadcast_to(np.eye(2), (total, 2, 2)).copy()
    for t in range(SEGMENT):
        step = m @ a
        step[:, :, 1] *= odds[:, t, None]
        step /= step.max(axis=(1, 2), keepdims=True)
        m = np.where(real[:, t, None, None], step, m)
    start = np.empty((total, 2))
    end = np.ones((total, 2))
    # the first token has no transition before it: the stationary start is uniform
    inv = np.linalg.solve(a.T, np.ones(2)) if abs(np.linalg.det(a)) > 1e-12 else np.ones(2)
    first = np.cumsum(n_seg) - n_seg
    alpha = np.broadcast_to(inv, (len(sizes), 2)).copy()
    for k in range(int(n_seg.max())):
        on = np.flatnonzero(n_seg > k)
        s = first[on] + k
        start[s] = alpha[on]
        nxt = np.einsum("ni,nij->nj", alpha[on], m[s])
        alpha[on] = nxt / np.abs(nxt).max(axis=1, keepdims=True)
    beta = np.ones((len(sizes), 2))
    for k in range(int(n_seg.max()) - 1, -1, -1):
        on = np.flatnonzero(n_seg > k)
        s = first[on] + k
        end[s] = beta[on]
        prev = np.einsum("nij,nj->ni", m[s], beta[on])
        beta[on] = prev / np.abs(prev).max(axis=1, keepdims=True)
    fwd = np.empty((SEGMENT, total, 2))
    x = start
    for t in range(SEGMENT):
        y = x @ a
        y[:, 1] *= odds[:, t]
        y /= np.abs(y).max(axis=1, keepdims=True)
        x = np.where(real[:, t, None], y, x)
        fwd[t] = x
    bwd = np.empty((SEGMENT, total, 2))
    x = end
    for t in range(SEGMENT - 1, -1, -1):
        bwd[t] = x
        y = x.copy()
        y[:, 1] *= odds[:, t]
        y = y @ a.T
        y /= np.abs(y).max(axis=1, keepdims=True)
        x = np.where(real[:, t, None], y, x)
    return fwd.transpose(1, 0, 2)[real], bwd.transpose(1, 0, 2)[real]


def doc_features(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """From the marginals of a document: expected toxic tokens, the two most certain ones, and their share."""
    out = np.zeros((len(sizes), 5))
    out[:, 0] = 1
    at = np.cumsum(sizes) - sizes
    has = sizes > 0
    if has.any():
        s = np.add.reduceat(p, at[has])
        out[has, 1], out[has, 4] = np.log1p(s), s / (s + 1)
        out[has, 2] = np.maximum.reduceat(p, at[has])
        warm = np.flatnonzero(out[:, 2] > 0.05)
        for i in warm:
            own = p[at[i] : at[i] + sizes[i]]
            out[i, 3] = np.partition(own, -2)[-2] if len(own) > 1 else 0.0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[str], toxic: list[int], weight: list[float], steps: int = 80, l2: float = 0.1) -> TagModel:
    """Train the field on token labels derived from document labels, then calibrate documents on their own labels.

    Adam on the mean token log-likelihood; features that fewer than three sampled texts have stay at zero.
    """
    model = TagModel(np.zeros(TABLE), 0.0, np.zeros((2, 2)), np.zeros(5))
    if not texts:
        return model
    marks = token_labels(texts, toxic)
    split = [t.split() for t in texts]
    index: dict[str, int] = {}
    word = np.array([index.setdefault(x, len(index)) for s in split for x in s], np.int64)
    sizes = np.array([len(s) for s in split], np.int64)
    if not len(word):
        model.calibration[0] = math.log((sum(toxic) + 1) / (len(toxic) - sum(toxic) + 1))
        return model
    feats = [word_features(x) for x in index]
    marked = np.array([any(f in marks for f in fs) for fs in feats])
    label = (marked[word] & np.repeat(np.array(toxic, bool), sizes)).astype(float)
    in_docs = Counter()
    for s in split:
        in_docs.update({f for x in set(s) for f in feats[index[x]]})
    rows = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    cols = np.array([slot(f) if in_docs[f] >= 3 else -1 for fs in feats for f in fs], np.int64)
    rows, cols = rows[cols >= 0], cols[cols >= 0]
    used, cols = np.unique(cols, return_inverse=True)
    share = label.mean()
    theta = np.zeros(len(used) + 5)
    theta[0] = math.log((share + 1e-6) / (1 - share + 1e-6))
    first = np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]
    inner = np.setdiff1d(np.arange(len(word)), first)
    seen = np.array([[np.mean((label[inner - 1] == i) & (label[inner] == j)) if len(inner) else 0 for j in (0, 1)] for i in (0, 1)])
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        trans = theta[1:5].reshape(2, 2)
        e_word = theta[0] + np.bincount(rows, theta[5:][cols], len(feats))
        e = e_word[word]
        alpha, beta = messages(e, sizes, trans)
        both = alpha * beta
        p = both[:, 1] / both.sum(1)
        by_word = np.bincount(word, (label - p) / len(word), len(feats))
        grad = np.zeros_like(theta)
        grad[0] = by_word.sum()
        grad[5:] = np.bincount(cols, by_word[rows], len(used)) - l2 / len(word) * theta[5:]
        if len(inner):
            right = beta[inner] * np.column_stack([np.ones(len(inner)), np.exp(np.clip(e[inner], -40, 40))])
            pair = alpha[inner - 1][:, :, None] * np.exp(trans - trans.max()) * right[:, None, :]
            grad[1:5] = (seen - (pair / pair.sum(axis=(1, 2), keepdims=True)).mean(0)).ravel()
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad * grad
        theta += 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-9)
    model.bias, model.trans = float(theta[0]), theta[1:5].reshape(2, 2)
    model.weights[used] = theta[5:]
    p = marginals(model.emissions([x for s in split for x in s]), sizes, model.trans)
    x, y, w = doc_features(p, sizes), np.array(toxic, float), np.array(weight, float)
    beta = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps of a weighted, lightly damped logistic regression
        q = _sigmoid(x @ beta)
        hess = (x * (w * q * (1 - q) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        move = np.linalg.solve(hess, x.T @ (w * (y - q)) - 0.05 * beta)
        beta += move
        if np.abs(move).max() < 1e-6:
            break
    model.calibration, model.memo = beta, None
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", use: Column | None = None, sample_rows: int = SAMPLE_ROWS, most_chars: int = MOST_CHARS) -> TagModel:
    """Fit on at most `sample_rows` labelled documents of each class that `use` admits, by their whole texts; those of more than
    `most_chars` characters are not learned from, so what reaches the driver has a bound.

    Of documents that share an id one text is learned from, that with the smallest hash; of several labels of an id the mean
    decides, half counting as 1. Null texts and ids that are null or have no document add nothing, other columns don't matter;
    without rows every text gets the same score.
    """
    found = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull())
    if use is not None:
        found = found.where(use)
    each = found.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    total = {int(r["y"]): int(r["n"]) for r in each.groupBy("y").agg(F.count("*").alias("n")).collect()}
    few = None
    for y in sorted(total):
        part = each.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
        few = part if few is None else few.unionByName(part)
    if few is None:
        return fit([], [], [])
    # two times sample_rows ids at most: a proven bound for the broadcast
    some = docs.where(docs[text_col].isNotNull() & (F.length(docs[text_col]) <= most_chars))
    rows = one_text(some, few, id_col, text_col).select("y", "text").collect()
    n = Counter(int(r["y"]) for r in rows)
    return fit([r["text"] for r in rows], [int(r["y"]) for r in rows], [total[int(r["y"])] / n[int(r["y"])] / sum(total.values()) * len(rows) for r in rows])


def tag(docs: DataFrame, model: TagModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, toxic_tokens, spans) of every row's whole text.

    toxic_tokens is the expected number of toxic tokens, spans the character offsets [start, end) of maximal
    runs of tokens whose marginal is 0.5 or more. Null text: empty, hence no span and the calibrated
    score of a text without tokens. Repeated rows and null ids get a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: the hashed weights

    def spans(text: str, p: np.ndarray) -> list[dict]:
        out: list[dict] = []
        before = False
        for m, hot in zip(_TOKEN.finditer(text), p >= 0.5, strict=True):
            if hot and before:
                out[-1]["end"] = m.end()
            elif hot:
                out.append({"start": m.start(), "end": m.end()})
            before = hot
        return out

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = strings(b.column(1))
            split = [t.split() for t in texts]
            sizes = np.array([len(s) for s in split], np.int64)
            p = marginals(m.emissions([x for s in split for x in s]), sizes, m.trans)
            x = doc_features(p, sizes)
            at = np.cumsum(sizes) - sizes
            found = [spans(t, p[a : a + n]) if top >= 0.5 else [] for t, a, n, top in zip(texts, at, sizes, x[:, 2], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_sigmoid(x @ m.calibration)), pa.array(np.expm1(x[:, 1])), pa.array(found, kind)], ["doc_id", "score", "toxic_tokens", "spans"])

    return map_batches(pick(docs, doc_id=id_col, text=text_col), run, "doc_id long, score double, toxic_tokens double, spans array<struct<start:int,end:int>>")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(crc_bucket(key, 5) == 0, F.lit(False))


def learnable(key: str = "doc_id") -> Column:
    return crc_bucket(key, 5) != 0
