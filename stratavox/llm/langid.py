"""Language identification by interpolated Kneser-Ney character models (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavox.llm.blocks import crc_bucket, filter_rows, map_batches, pick, strings
from stratavox.runtime import settle

#: Characters of an n-gram; each takes 16 bits, so a 4-gram is a 64-bit key.
ORDER = 4
#: Bits of a character inside a key.
WIDTH = 16
#: Rows of a language beyond which its quantiles are looked for among the values above the approximate TAIL quantile only.
FEW_ROWS, TAIL = 1000, 0.99
#: n-grams of a language that a task gathers before it counts them.
GATHER = 1_000_000
#: Share of the texts of a language that may lie over the calibrated quantile; bits a symbol by which the limit stands above it,
#: so that clean texts that weren't learned from stay (random letters take some two bits more); bits that short texts may
#: be over the limit at least.
REJECTED, MARGIN, LEAST_SLACK = 0.001, 0.4, 4.0
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def symbols(text: str) -> tuple[np.ndarray, int]:
    """Lower-case letters with single blanks for all else, ORDER - 1 blanks before and one after; and the letters in it. A
    letter above U+FFFF is its two UTF-16 units, which stand for nothing else, so no two letters have one code."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _letters()[a]
    n = int(is_letter.sum())
    a = np.where(is_letter, a, 32)
    if len(a):
        follows = np.r_[False, is_letter[:-1]]
        a = a[is_letter | follows]
        if len(a) and a.max() >= 1 << WIDTH:
            a = np.frombuffer(a.astype("<u4").tobytes().decode("utf-32-le").encode("utf-16-le"), "<u2")
    end = [] if len(a) and a[-1] == 32 else [32]
    return np.r_[[32] * (ORDER - 1), a, end].astype(np.uint16), n


def grams(seq: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Packed n-grams of a symbol sequence."""
    n = len(seq) - order + 1
    out = np.zeros(n, np.uint64)
    for i in range(order):
        out = out << np.uint64(WIDTH) | seq[i : i + n].astype(np.uint64)
    return out


def _fold(held: dict, lang: str, parts: list[np.ndarray]) -> None:
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    if lang in held:
        old, n = held[lang]
        both, inv = np.unique(np.concatenate([old, keys]), return_inverse=True)
        counts = np.bincount(inv, np.concatenate([n, counts]).astype(float), len(both)).astype(np.int64)
        keys = both
    held[lang] = keys, counts


def count_grams(train: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, gram, n) over all training rows: counted inside each task first, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        wait: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                seq, n = symbols(text)
                if n:
                    wait.setdefault(lang, []).append(grams(seq))
                    size[lang] = size.get(lang, 0) + len(seq)
                    if size[lang] >= GATHER:
                        _fold(held, lang, wait.pop(lang))
                        size[lang] = 0
        for lang, parts in wait.items():
            _fold(held, lang, parts)
        for lang, (keys, counts) in held.items():
            for at in range(0, len(keys), 50_000):
                k = keys[at : at + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(counts[at : at + 50_000])], ["lang", "gram", "n"])

    found = map_batches(pick(train, lang=lang_col, text=text_col), run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class KneserNey:
    """Log2 probabilities of all languages side by side, in sorted key arrays of each order.

    grams[m], logp[m]: m-grams seen in any language and their fully interpolated probabilities.
    contexts[m], back[m]: their (m-1)-gram histories and back-off weights, used for unseen m-grams.
    """

    langs: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    back: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None
    #: by language: bits a symbol by which text of its own that was learned from looks more likely than other text
    optimism: np.ndarray | None = None
    #: by language: cross-entropy above limit + slack / sqrt(n-grams) is rejected
    limit: np.ndarray | None = None
    slack: np.ndarray | None = None

    @staticmethod
    def fit(lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> KneserNey:
        """From counts of ORDER-grams: lower orders use continuation counts, the number of distinct left neighbours."""
        names = sorted(set(lang.tolist()))
        model = KneserNey(names)
        shift = np.uint64(WIDTH)
        per: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for x in names:
            own = lang == x
            k, c = gram[own].view(np.uint64), n[own].astype(float)
            at = np.argsort(k)
            orders = [(k[at], c[at])]
            for m in range(ORDER - 1, 0, -1):
                low, c = np.unique(orders[0][0] & np.uint64((1 << WIDTH * m) - 1), return_counts=True)
                orders.insert(0, (low, c.astype(float)))
            per.append(orders)
        seen = sum(np.unique(np.concatenate([o[0][0] for o in per])).size for _ in [0]) if names else 1
        model.floor = np.full(len(names), np.log2(1.0 / (seen + 1)))
        # distinct n-grams to n-grams, as in the penalty for fitted parameters
        model.optimism = np.array([2 * sum(len(k) for k, _ in o) / max(1.0, o[-1][1].sum()) * np.log2(np.e) for o in per])
        for m in range(ORDER):
            keys = np.unique(np.concatenate([o[m][0] for o in per])) if names else np.zeros(0, np.uint64)
            hist = keys >> shift
            ctx = np.unique(hist)
            prob, back = np.zeros((len(keys), len(names)), np.float64), np.zeros((len(ctx), len(names)), np.float64)
            for j, o in enumerate(per):
                k, c = o[m]
                n1, n2 = (c == 1).sum(), (c == 2).sum()
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                h = np.searchsorted(ctx, k >> shift)
                total, types = np.bincount(h, c, len(ctx)), np.bincount(h, minlength=len(ctx))
                weight = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
                back[:, j] = np.log2(weight)
                prob[np.searchsorted(keys, k), j] = (c - d) / total[h]
                lower = model._score(keys & np.uint64((1 << WIDTH * m) - 1), m)[:, j] if m else np.full(len(keys), model.floor[j])
                prob[:, j] += weight[np.searchsorted(ctx, hist)] * np.exp2(lower)
            model.grams.append(keys)
            model.logp.append(np.log2(prob).astype(np.float32))
            model.contexts.append(ctx)
            model.back.append(back.astype(np.float32))
        return model

    def _score(self, keys: np.ndarray, m: int) -> np.ndarray:
        """Log2 probability of each m-gram in each language."""
        if m == 0:
            return np.broadcast_to(self.floor, (len(keys), len(self.langs)))
        have = self.grams[m - 1]
        at = np.searchsorted(have, keys)
        at[at == len(have)] = 0
        out = self.logp[m - 1][at]
        miss = np.flatnonzero(have[at] != keys)
        if len(miss):
            k = keys[miss]
            low = self._score(k & np.uint64((1 << WIDTH * (m - 1)) - 1), m - 1)
            ctx, h = self.contexts[m - 1], k >> np.uint64(WIDTH)
            i = np.searchsorted(ctx, h)
            i[i == len(ctx)] = 0
            out[miss] = low + np.where((ctx[i] == h)[:, None], self.back[m - 1][i], 0)
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per symbol of each text in each language, its n-grams, and its letters (0: nothing to judge)."""
        ce, size, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        group: list[np.ndarray] = []
        first = 0

        def score(last: int) -> None:
            if group:
                starts = np.r_[0, np.cumsum(size[first : last - 1])]
                found = self._score(np.concatenate(group), ORDER)
                ce[first:last] = -np.add.reduceat(found, starts, axis=0, dtype=np.float64) / size[first:last, None]

        for i, t in enumerate(texts):
            seq, letters[i] = symbols(t)
            group.append(grams(seq))
            size[i] = len(group[-1])
            if size[first : i + 1].sum() > 200_000:  # texts are scored some at a time, whatever the batch holds
                score(i + 1)
                group, first = [], i + 1
        score(len(texts))
        return ce, size, letters

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether it is rejected, of each text."""
        if not self.langs:
            n = len(texts)
            return [UNKNOWN] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        ce, size, letters = self.cross_entropy(texts)
        best = ce.argmin(1)
        low = ce[np.arange(len(ce)), best]
        # the odds of the best language grow with the evidence, less than in proportion as symbols depend on each other
        score = 1 / np.exp2(-(ce - low[:, None]) * np.sqrt(np.maximum(size, 1))[:, None]).sum(1)
        blank = letters == 0
        over = low > self.limit[best] + self.slack[best] / np.sqrt(np.maximum(size, 1)) if self.limit is not None else np.zeros(len(ce), bool)
        return [UNKNOWN if e else self.langs[i] for i, e in zip(best, blank, strict=True)], np.where(blank, 0.0, score), np.where(blank, np.nan, low), blank | over


def upper_quantiles(values: DataFrame, q: float) -> dict[int, float]:
    """The quantile q, at least 0.999, of the values (j, v) of each group, over all rows, as numpy gives it.

    An approximate quantile far below q bounds the values that are sorted to a hundredth; of them only the two around the place
    of the quantile reach the driver.
    """
    if q < 0.999:
        raise ValueError("only quantiles near the end")
    group = values.groupBy("j").agg(F.count("*").alias("n"), F.percentile_approx("v", TAIL, F.lit(10_000)).alias("tail"))
    bounds = settle(group.select("j", "n", F.when(F.col("n") > FEW_ROWS, F.col("tail")).alias("tail")), "bounds")
    above = values.join(F.broadcast(bounds), "j").where("tail IS NULL OR v >= tail")  # a row a language
    placed = above.select("j", "v", "n", F.row_number().over(Window.partitionBy("j").orderBy(F.desc("v"))).alias("from_top"))
    place = (F.col("n") - 1) * F.lit(q)
    found = placed.where((F.col("n") - F.col("from_top") == F.floor(place)) | (F.col("n") - F.col("from_top") == F.ceil(place)))
    out: dict[int, float] = {}
    for j, rows in found.toPandas().groupby("j"):
        low, high, at = rows["v"].min(), rows["v"].max(), (rows["n"].iloc[0] - 1) * q
        out[int(j)] = float(low + (high - low) * (at - np.floor(at)))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", use: Column | None = None) -> KneserNey:
    """Fit on all rows with a language that `use` admits, then calibrate the rejection threshold on all of them.

    It rejects at most REJECTED of the texts of a language: `limit` stands MARGIN above that quantile of the cross-entropy of long
    texts in their own language, `slack` is that quantile of what texts are above it, times the root of their n-grams. Both
    are raised by what learning from the same texts has gained, which goes with more text.

    Repeated rows and ids count each; null or empty texts add nothing; other columns don't matter; without rows there is
    no language, and every text is rejected.
    """
    rows = docs.where(docs[lang_col].isNotNull())
    if use is not None:
        rows = rows.where(use)
    got = count_grams(rows, lang_col, text_col).toPandas()
    model = KneserNey.fit(got["lang"].to_numpy(), got["gram"].to_numpy(np.int64), got["n"].to_numpy())
    if not model.langs:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        own = {x: i for i, x in enumerate(m.langs)}
        for b in batches:
            # a text without a letter is nothing to judge, and its language may have no other
            j, texts = np.array([own.get(x, 0) for x in b.column(0).to_pylist()], np.int64), strings(b.column(1))
            ce, size, letters = m.cross_entropy(texts)
            ok = letters > 0
            yield pa.RecordBatch.from_arrays([pa.array(j[ok]), pa.array(ce[np.arange(len(j)), j][ok] if len(j) else np.zeros(0)), pa.array(size[ok])], ["j", "ce", "size"])

    seen = settle(map_batches(pick(rows, lang=lang_col, text=text_col), run, "j long, ce double, size long"), "cross-entropy")
    quantile = 1 - REJECTED
    long = upper_quantiles(seen.where("size >= 200").select("j", F.col("ce").alias("v")), quantile)
    names = range(len(model.langs))
    model.limit = np.array([long.get(j, -model.floor[j]) + model.optimism[j] + MARGIN for j in names])
    beyond = docs.sparkSession.createDataFrame([(j, float(model.limit[j] - model.optimism[j])) for j in names], "j long, least double")
    over = upper_quantiles(seen.join(F.broadcast(beyond), "j").select("j", ((F.col("ce") - F.col("least")) * F.sqrt("size")).alias("v")), quantile)
    model.slack = np.array([max(LEAST_SLACK, over.get(j, LEAST_SLACK)) for j in names])
    shared.unpersist()
    return model


def identify(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of each row.

    Null texts and texts without a letter: `und`, score 0, rejected. Repeated rows and null ids: a row each.
    The model's size follows the distinct character n-grams of the languages, so it grows ever more slowly with the documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, ce, gone = shared.value.judge(strings(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(ce, from_pandas=True), pa.array(gone)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return map_batches(pick(docs, doc_id=id_col, text=text_col), run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_known(docs: DataFrame, model: KneserNey, text_col: str = "text") -> DataFrame:
    """Filter: rows that the model doesn't reject, judged in one pass; null texts and texts without a letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_rows(docs, text_col, lambda texts: ~shared.value.judge(texts)[3])


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(crc_bucket(key, 3) == 1, F.lit(False))


def learnable(key: str = "doc_id") -> Column:
    """Rows whose id may be learned from; a null id is in neither part."""
    return crc_bucket(key, 3) != 1
