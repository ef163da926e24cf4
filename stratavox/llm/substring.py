"""Repeated passages: sliding spans of sentences (operator 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.llm.blocks import map_batches, pick, strings
from stratavox.runtime import settle

#: Sentences and words of a span at least: a span goes on until it has both.
RUN = 3
MIN_WORDS = 10
#: Words that make a span of fewer sentences.
ENOUGH = 20
#: A sentence of more words than this is cut, before one word in CUT by the hash of the two words around the cut.
LONG = 24
CUT = 8
_CUT = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
_WORD = re.compile(r"\S+")
#: Scripts that are written without blanks: Thai, Lao, Myanmar, Khmer, Kana, Han. There each character counts as a word.
_CLOSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_CLOSE = re.compile(f"[{_CLOSE}]")
_CLOSE_WORD = re.compile(f"[{_CLOSE}]|[^\\s{_CLOSE}]+")
_CLOSE_CUT = re.compile(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f\uff61])\s*(?=\S)|\s*\n\s*")


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, words in lower case, space-joined) of the sentences of a text, in order; blank ones are left out.

    A sentence ends after . ! or ? before white space, after the full stops of East Asian scripts, and at a line end. Very
    long ones are cut where the words around the cut say so, so one passage gives the same parts wherever it stands, and
    after LONG words at the latest. A character of a script without blanks counts as a word.
    """
    out = []
    at = 0
    close = not text.isascii() and _HAS_CLOSE.search(text) is not None
    cut, word = (_CLOSE_CUT, _CLOSE_WORD) if close else (_CUT, _WORD)
    for start, end in [(m.start(), m.end()) for m in cut.finditer(text)] + [(len(text), len(text))]:
        words = word.findall(text[at:start].lower()) if close else text[at:start].lower().split()
        if len(words) > LONG:
            spots = [(m.start() + at, m.end() + at) for m in word.finditer(text[at:start])]
            k = 0
            for e in range(1, len(words) + 1):
                if e == len(words) or e - k == LONG or xxhash.xxh3_64_intdigest(f"{words[e - 1]} {words[e]}".encode("utf-8", "surrogatepass")) % CUT == 0:
                    out.append((spots[k][0], spots[e - 1][1], " ".join(words[k:e])))
                    k = e
        elif words:
            out.append((at, start, " ".join(words)))
        at = end
    return out


def run_ends(units: list[tuple[int, int, str]], run: int = RUN, min_words: int = MIN_WORDS) -> np.ndarray:
    """For each sentence that a span starts at, the sentence after the span: at least `min_words` words on, and at least
    `run` sentences or ENOUGH words on. Sentences too near the end of the text start no span."""
    words = np.cumsum([0] + [s.count(" ") + 1 for _, _, s in units])
    ends = np.minimum(np.arange(len(units)) + run, np.searchsorted(words, words[:-1] + ENOUGH))
    ends = np.maximum(ends, np.searchsorted(words, words[:-1] + min_words))
    return ends[ends <= len(units)]  # all terms grow with the start, so those that fit come first


#: Odd multipliers of the two polynomial hashes, and their inverses modulo 2^64.
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_Q = np.array([pow(int(p), -1, 1 << 64) for p in _P], np.uint64)


def span_hashes(units: list[tuple[int, int, str]], run: int = RUN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, further 32 bits, first sentence) of every span of consecutive sentences.

    Sums of sentence hashes times powers, so a span of any length costs the same and starts anywhere alike. 96 bits
    keep accidental equality unlikely for some 10^13 spans.
    """
    ends = run_ends(units, run, min_words) if units else np.zeros(0, np.int64)
    n = len(ends)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")) for _, _, s in units]), np.uint64).reshape(-1, 2)
    one = np.ones((1, 2), np.uint64)
    up = np.cumprod(np.concatenate([one, np.broadcast_to(_P, (len(units), 2))]), axis=0, dtype=np.uint64)
    down = np.cumprod(np.concatenate([one, np.broadcast_to(_Q, (len(units), 2))]), axis=0, dtype=np.uint64)
    total = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(h * up[:-1], axis=0, dtype=np.uint64)])
    got = (total[ends] - total[:n]) * down[:n] + (ends - np.arange(n)).astype(np.uint64)[:, None]
    return got[:, 0].view(np.int64).copy(), (got[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.arange(n, dtype=np.int32)


def spans(docs: DataFrame, run: int, min_words: int) -> DataFrame:
    """(h, h2, doc, row, pos, again) of rows (doc, text, row): the spans of each text; `again` marks those that an earlier span
    of the same text equals. `row` tells texts that share an id apart."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [span_hashes(sentences(t), run, min_words) for t in strings(b.column(1))]
            again = []
            for h, _, _ in got:
                later = np.ones(len(h), bool)
                later[np.unique(h, return_index=True)[1]] = False
                again.append(later)
            size = [len(x[0]) for x in got]
            ids, rows = np.repeat(np.asarray(b.column(0)), size), np.repeat(np.asarray(b.column(2)), size)
            cols = [np.concatenate([x[i] for x in got]) if got else np.zeros(0, (np.int64, np.int32, np.int32)[i]) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(ids, pa.int64()), pa.array(rows, pa.int32()), pa.array(cols[2]), pa.array(np.concatenate([*again, np.zeros(0, bool)]))], ["h", "h2", "doc", "row", "pos", "again"])

    return map_batches(docs.where("doc is not null"), fn, "h long, h2 int, doc long, row int, pos int, again boolean")


def row_key(text: Column) -> Column:
    """What tells rows apart that share an id: a 32-bit hash of the text."""
    return F.hash(text)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, row, spots): for each text with a repeated span that isn't the first, the first sentences of those spans.

    The first occurrence of a span is in the document with the smallest id. Repeats inside a text never are, so they
    need no look at other texts, and a text brings each span to the join once. Smallest ids and counts are hashed
    together on the map side and written, so that both sides of the join are plain shuffles, which AQE splits where a
    passage stands in very many documents.
    """
    source = pick(docs, doc=id_col, text=text_col).withColumn("row", row_key(F.col("text")))
    found = settle(spans(source, run, min_words), "spans")
    heads = found.where("not again").select("h", "h2", "doc", "row", "pos")
    firsts = settle(heads.groupBy("h", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "h2", "first"), "firsts")
    later = heads.join(firsts, ["h", "h2"]).where("doc <> first").select("doc", "row", "pos")
    return later.unionByName(found.where("again").select("doc", "row", "pos")).groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("spots"))


def cut_spans(text: str, spots: list[int], run: int = RUN, min_words: int = MIN_WORDS) -> tuple[str, list[dict]]:
    """The text without the sentences covered by spans from `spots`, and the character ranges taken out."""
    units = sentences(text)
    ends = run_ends(units, run, min_words)
    gone = np.zeros(len(units), bool)
    for s in spots:
        if s < len(ends):  # else of another text with the same id and row key
            gone[s : ends[s]] = True
    ranges: list[dict] = []
    for i in np.flatnonzero(gone):
        end = units[i + 1][0] if i + 1 < len(units) else len(text)
        if ranges and ranges[-1]["end"] >= units[i][0]:
            ranges[-1]["end"] = end
        else:
            ranges.append({"start": int(units[i][0]), "end": int(end)})
    kept, at = [], 0
    for r in ranges:
        kept.append(text[at : r["start"]])
        at = r["end"]
    return ("".join(kept) + text[at:]).rstrip() if ranges else text, ranges


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs, the text without sentences that a non-first repeated span covers, and `removed`,
    the character ranges [start, end) of the original text that went.

    Sentences compare in lower case with single blanks. Spans within one document count too. Rows that
    share an id are one document: they don't repeat one another, and each is cut by its own text. Rows with a null id take
    no part and stay as they are. A null text stays null. A text of which nothing is left becomes empty; its row stays.
    No rows: no rows. Other columns may have any name; one named `removed` is replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "removed"])
    taken = {c.lower() for c in docs.columns}
    doc, row, held_at = (next(n for k in range(len(taken) + 1) if (n := f"_{x}{k}") not in taken) for x in ("doc", "row", "spots"))
    spots = repeated(docs, id_col, text_col, run, min_words).select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("spots").alias(held_at)).hint("shuffle_hash")
    both = docs.join(spots, (docs[id_col] == spots[doc]) & (row_key(docs[text_col]) == spots[row]), "left").drop(doc, row)
    names = list(docs.columns)
    at = names.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(len(names))
            cols = [b.column(i) for i in range(len(names))]
            if held.null_count == len(held):
                cut: list[list[dict]] = [[]] * len(held)
            else:
                texts, cut = cols[at].to_pylist(), []
                for i, s in enumerate(held.to_pylist()):
                    if s and texts[i]:
                        texts[i], r = cut_spans(texts[i], s, run, min_words)
                        cut.append(r)
                    else:
                        cut.append([])
                cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cut, kind)], [*names, "removed"])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", removed array<struct<start:int,end:int>>"
    return map_batches(both, fn, schema)


def brute_force(rows: list[tuple[int, str]], run: int = RUN, min_words: int = MIN_WORDS) -> dict[int, str]:
    """Cleaned texts by comparing the spans themselves; for tests."""
    def spans_of(u: list[tuple[int, int, str]]) -> Iterator[tuple[int, tuple[str, ...]]]:
        for k in range(len(u)):
            for e in range(k + 1, len(u) + 1):
                n = sum(len(x[2].split()) for x in u[k:e])
                if n >= min_words and (e - k >= run or n >= ENOUGH):
                    yield k, tuple(x[2] for x in u[k:e])
                    break

    units = {i: sentences(t or "") for i, t in sorted(rows)}
    firsts: dict[tuple, tuple[int, int]] = {}
    for i, u in units.items():
        for k, span in spans_of(u):
            firsts.setdefault(span, (i, k))
    return {i: cut_spans(t or "", [k for k, span in spans_of(units[i]) if firsts[span] != (i, k)], run, min_words)[0] for i, t in rows}
