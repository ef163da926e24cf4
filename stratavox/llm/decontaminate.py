"""Benchmark decontamination by template canonicalisation (operator 10)."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavox.llm.blocks import map_batches, pick, strings
from stratavox.llm.templates import SHINGLE, Lexer, opened, shingles
from stratavox.runtime import settle

#: Share of an item's shingles that a document must hold in one place.
CONTAINMENT = 0.8
#: Bits of the filter in front of the window join for each window of an item that is asked for, and at most: 32 MB.
FILTER_BITS, MOST_FILTER_BITS = 256, 1 << 28
#: Items that one text is compared with at a time; a text that may hold more is compared with several such parts.
ITEMS_TOGETHER = 64
_SLOTS = 8 | 16 | 32
#: Words that open sentences, where they count as names.
_OPENS = 64
#: Mixed into the hash of an item or text that is shorter than a window, which matches as a whole only.
_WHOLE = np.uint64(0x5851F42D4C957F2D)
FOUND = "item_id long, containment double, kind string, first_word int, end_word int"


def windows(plain: np.ndarray, typed: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of the three streams of one text: as it is, with names typed, and with capitalised words that
    open sentences typed too. A text shorter than a window has one hash of the whole."""
    if 0 < len(plain) < SHINGLE:
        h = shingles(plain, len(plain)) ^ (_WHOLE >> np.uint64(len(plain)))
        return h, h, h
    return shingles(plain), shingles(typed), shingles(opened(typed, flags))


@dataclass
class Item:
    """A benchmark item: its words, their flags, and by the hash of a window the places where it stands, as bits."""

    id: int
    words: list[str]
    flags: np.ndarray
    size: int
    where: dict[int, int]
    hashes: np.ndarray


def make_item(item: int, text: str, lex: Lexer) -> Item | None:
    chunks = (text or "").split()
    plain, typed, keep, flags = lex.stream(chunks)
    if not len(keep):
        return None
    where: dict[int, int] = defaultdict(int)
    for h in windows(plain, typed, flags):
        for k, x in enumerate(h.tolist()):
            where[x] |= 1 << k
    return Item(item, [lex.core(chunks[k]) for k in keep], flags, max(0, len(keep) - SHINGLE + 1), dict(where), np.array(sorted(where), np.uint64))


def make_block(items: list[tuple[int, str]]) -> list[Item]:
    lex = Lexer()
    return [x for x in (make_item(i, t, lex) for i, t in items) if x is not None]


def _slots_agree(pairs: list[tuple[str, str]]) -> tuple[bool, bool]:
    """Whether equal slots of the item are equal in the document, and whether any slot differs from the item's."""
    value: dict[str, str] = {}
    for mine, theirs in pairs:
        if value.setdefault(mine, theirs) != theirs:
            return False, True
    return True, any(a != b for a, b in value.items())


def matches(text: str, items: list[Item], lex: Lexer, containment: float) -> list[tuple[int, float, str, int, int]]:
    """(item, containment, kind, start, end) of those of the items that a whole text holds; offsets are of its white-space
    chunks."""
    chunks = text.split()
    plain, typed, keep, flags = lex.stream(chunks)
    if not len(keep):
        return []
    three = windows(plain, typed, flags)
    out = []
    for item in items:
        if len(keep) < SHINGLE or not item.size:
            if len(keep) == len(item.words) < SHINGLE and int(three[0][0]) in item.where:
                out.append((item.id, 1.0, "verbatim", int(keep[0]), int(keep[-1]) + 1))
            continue
        got = None
        held: dict[int, int] = {}
        # names that open sentences: for items not held with these words as they are
        for streams, slot in ((three[:2], _SLOTS), (three[2:], _SLOTS | _OPENS)):
            for h in streams:
                for p in np.flatnonzero(np.isin(h, item.hashes)).tolist():
                    held[p] = held.get(p, 0) | item.where[int(h[p])]
            got = got or _place(held, item, chunks, keep, flags, lex, containment, slot)
        if got:
            out.append(got)
    return out


def _bits(mask: int) -> list[int]:
    return [k for k in range(mask.bit_length()) if mask >> k & 1]


def _offsets(held: dict[int, int], size: int, need: float) -> list[int]:
    """Offsets (document position less item position) on which so many windows agree, the fullest first. Positions that
    agree with the same windows of the item are counted together."""
    groups: dict[int, list[int]] = defaultdict(list)
    for p, mask in held.items():
        groups[mask].append(p)
    counts = np.zeros(max(held) + size + 1, np.int64)
    for mask, at in groups.items():
        k, p = np.array(_bits(mask)), np.array(at) + size
        for i in range(0, len(p), max(1, (1 << 20) // len(k))):
            counts += np.bincount((p[i : i + max(1, (1 << 20) // len(k)), None] - k).ravel(), minlength=len(counts))
    good = np.flatnonzero(counts >= need)
    return (good[np.argsort(-counts[good], kind="stable")] - size).tolist()


def longest_chain(held: dict[int, int], at: list[int], size: int, need: float) -> list[tuple[int, int]]:
    """The longest chain of pairs (document position, item position) that goes up in both, or none if it has fewer than `need`.
    The common subsequence of two sequences, one addition of whole rows for each document position."""
    full = (1 << size) - 1
    row, rows = full, []
    for p in at:
        both = row & held[p]
        row = (row + both | row & ~both) & full
        rows.append(row)
    if size - row.bit_count() < need:
        return []
    out, i, k = [], len(at) - 1, size - 1
    while i >= 0 and k >= 0:
        if rows[i] >> k & 1:
            k -= 1
        elif i and not rows[i - 1] >> k & 1:
            i -= 1
        else:
            out.append((at[i], k))
            i, k = i - 1, k - 1
    return out[::-1]


def _chains(held: dict[int, int], size: int, need: float) -> Iterator[list[tuple[int, int]]]:
    """Pairs of one place each: first of single offsets, then chains over stretches of 1.25 times the item's length, for copies
    with words put in or left out. Stretches start an eighth of the item apart and are as much longer, so none is missed."""
    for d in _offsets(held, size, need):
        yield [(k + d, k) for k in range(size) if held.get(k + d, 0) >> k & 1]
    at, step = sorted(held), max(1, size // 8)
    width, left, right = size + size // 4 + 1 + step, 0, 0
    for start in range(at[0], at[-1] + 1, step):
        while left < len(at) and at[left] < start:
            left += 1
        right = max(right, left)
        while right < len(at) and at[right] < start + width:
            right += 1
        if right - left >= need and (found := longest_chain(held, at[left:right], size, need)):
            yield _extended(held, found)


def _extended(held: dict[int, int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A chain with the windows beyond its ends that go on at the same offsets: a stretch may have cut them off."""
    (p, k), (q, j) = pairs[0], pairs[-1]
    before, after = [], []
    while k and held.get(p - 1, 0) >> (k - 1) & 1:
        p, k = p - 1, k - 1
        before.append((p, k))
    while held.get(q + 1, 0) >> (j + 1) & 1:
        q, j = q + 1, j + 1
        after.append((q, j))
    return before[::-1] + pairs + after


def _place(held: dict[int, int], item: Item, chunks: list[str], keep: np.ndarray, flags: np.ndarray, lex: Lexer, containment: float, slot: int) -> tuple[int, float, str, int, int] | None:
    """A place where the document holds the item and its slots agree, a verbatim one before others. `held`: for positions of the
    document, the windows of the item that are equal, as bits.

    Each window of the document stands for one of the item. Windows of placeholders alone say nothing of the template, so a
    re-parameterised copy also holds `containment` of the windows that have a word of their own, of which there must be one."""
    need, best = containment * item.size, None
    if len(held) < need:
        return None
    own = sum(1 << k for k in range(item.size) if not (item.flags[k : k + SHINGLE] & slot).all())
    for pairs in _chains(held, item.size, need):
        to: dict[int, int] = {}
        for p, k in pairs:
            for j in range(SHINGLE):
                to.setdefault(k + j, p + j)
        slots = [(item.words[j], lex.core(chunks[keep[p]])) for j, p in to.items() if (item.flags[j] | flags[p]) & slot]
        agree, differ = _slots_agree(slots)
        if not agree or differ and (best or not own or sum(own >> k & 1 for _, k in pairs) < containment * own.bit_count()):
            continue
        best = (item.id, len(pairs) / item.size, "reparameterised" if differ else "verbatim", int(keep[pairs[0][0]]), int(keep[pairs[-1][0] + SHINGLE - 1]) + 1)
        if not differ:
            return best
    return best


def item_windows(benchmark: DataFrame, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """The items under a key of their own (key, item, text), and their windows (key, k, size, h)."""
    items = settle(pick(benchmark, item=item_col, text=item_text_col).where("text is not null").withColumn("key", F.monotonically_increasing_id()), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexer()
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                plain, typed, keep, flags = lex.stream(text.split())
                three = windows(plain, typed, flags)
                rows += [(key, k, max(0, len(keep) - SHINGLE + 1), h) for k, hs in enumerate(zip(*(x.view(np.int64).tolist() for x in three), strict=True)) for h in set(hs)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["key", "k", "size", "h"])

    return items, settle(map_batches(items.select("key", "text"), run, "key long, k long, size long, h long"), "item_windows")


def asked_windows(wins: DataFrame, containment: float) -> DataFrame:
    """(h, key): of each item so many of its windows that whoever holds `containment` of them holds one of these: all but
    those it may hold besides. They are the windows that fewest items have, so those of common phrases are hardly
    ever asked for."""
    common = wins.groupBy("h").agg(F.count_distinct("key").alias("n"))
    each = wins.join(common, "h").groupBy("key", "k", "size").agg(F.max("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("n", "k"))  # the windows of one item
    enough = F.col("size") - F.ceil(F.col("size") * F.lit(containment) - 1e-9) + 1
    asked = each.withColumn("rank", rank).where(F.col("rank") <= F.greatest(enough, F.lit(1))).select("key", "k")
    return settle(wins.join(asked, ["key", "k"]).select("h", "key").distinct(), "asked")


class WindowFilter:
    """Two bits for each hash. A text's window that lacks one is in no item; how full it is only decides how many
    windows go on to the join in vain."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    @staticmethod
    def spots(h, bits: int):
        """Positions of the bits of a column of hashes, counted from 1 as Spark's bitmap functions do."""
        return F.array(F.shiftrightunsigned(h, 64 - bits) + 1, h.bitwiseAND(F.lit((1 << bits) - 1)) + 1)

    @staticmethod
    def of(asked: DataFrame) -> WindowFilter:
        """Bitmaps of 32,768 bits made in the cluster; the driver receives the table, MOST_FILTER_BITS at most."""
        n = asked.select("h").distinct().count()
        bits = int(min(math.log2(MOST_FILTER_BITS), max(15, math.ceil(math.log2(max(1, n) * FILTER_BITS)))))
        p = asked.select(F.explode(WindowFilter.spots(F.col("h"), bits)).alias("p"))
        maps = p.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
        table = np.zeros(1 << (bits - 3), np.uint8)
        for r in maps.toLocalIterator():
            table[(r["b"] - 1) << 12 : r["b"] << 12] = np.frombuffer(r["m"], np.uint8)
        return WindowFilter(bits, table)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be asked for."""
        p = h >> np.uint64(64 - self.bits)
        at = np.flatnonzero(self.table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1)
        p = h[at] & np.uint64((1 << self.bits) - 1)
        return at[(self.table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1) > 0]

    def hits(self, texts: list[str], lex: Lexer) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the windows of whole texts that may be asked for, each once; all texts in one stream."""
        chunks: list[str] = []
        ends = []
        for t in texts:
            chunks += t.split()
            ends.append(len(chunks))
        ends = np.array(ends, np.int64)
        plain, typed, keep, flags = lex.stream(chunks, ends)
        owner = np.searchsorted(ends, keep, side="right")
        rows, found = [], []
        for h in (plain, typed, opened(typed, flags)):
            s = shingles(h)
            at = self.find(s)
            at = at[owner[at] == owner[at + SHINGLE - 1]]  # within one text
            rows.append(owner[at])
            found.append(s[at])
        size = np.bincount(owner, minlength=len(texts))
        for i in np.flatnonzero((size > 0) & (size < SHINGLE)):
            a = int(np.searchsorted(owner, i))
            s = windows(plain[a : a + size[i]], typed[a : a + size[i]], flags[a : a + size[i]])[0]
            at = self.find(s)
            rows.append(np.full(len(at), i))
            found.append(s[at])
        both = np.unique(np.rec.fromarrays([np.concatenate(rows), np.concatenate(found)], names="row,h"))
        return both["row"], both["h"]


def candidates(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (row, doc, text, hits) of the texts that may hold an item: one pass over whole texts, those without a window in
    the filter end there."""
    shared = docs.sparkSession.sparkContext.broadcast(WindowFilter.of(asked))  # MOST_FILTER_BITS at most
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexer()
        for b in batches:
            row, h = shared.value.hits(strings(b.column(1)), lex)
            own, first = np.unique(row, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(h.view(np.int64)))
            some = b.take(pa.array(own.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), lists.cast(kind)], ["doc", "text", "hits"])

    found = map_batches(pick(docs, doc=id_col, text=text_col).where("text is not null"), run, "doc long, text string, hits array<long>")
    return settle(found.withColumn("row", F.monotonically_increasing_id()), "candidates")


def judged(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, containment: float) -> DataFrame:
    """(row, doc, text_hash, item_id, containment, kind, first_word, end_word) of the items that the texts hold."""
    items, wins = item_windows(benchmark, item_col, item_text_col)
    asked = asked_windows(wins, containment)
    some = candidates(docs, asked, id_col, text_col)
    pairs = settle(some.select("row", F.explode("hits").alias("h")).join(asked, "h").select("row", "key").distinct(), "pairs")
    parts = pairs.groupBy("row").agg(F.ceil(F.count("*") / ITEMS_TOGETHER).alias("parts"))
    dealt = pairs.join(parts, "row").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    asks = dealt.join(items, "key").groupBy("row", "part").agg(F.collect_list(F.struct("item", F.col("text").alias("body"))).alias("items"))
    both = asks.join(some.select("row", "doc", "text"), "row").select("row", "doc", F.xxhash64("text").alias("text_hash"), "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexer()
        for b in batches:
            rows = []
            for i, (text, asked_items) in enumerate(zip(strings(b.column(3)), b.column(4).to_pylist(), strict=True)):
                made = [x for x in (make_item(it["item"], it["body"], lex) for it in asked_items) if x is not None]
                rows += [(i, *m) for m in matches(text, made, lex, containment)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            same = b.select([0, 1, 2]).take(pa.array(list(cols[0]), pa.int64()))
            kinds = (pa.int64(), pa.float64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*same.columns, *(pa.array(list(c), t) for c, t in zip(cols[1:], kinds, strict=True))], ["row", "doc", "text_hash", "item_id", "containment", "kind", "first_word", "end_word"])

    return map_batches(both, run, f"row long, doc long, text_hash long, {FOUND}", rows=100)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, containment, kind, first_word, end_word): the benchmark items that documents hold.

    Numbers, units and names become typed placeholders; windows of five tokens join the windows of the items, without
    names typed, with them, and with capitalised words that open sentences taken for names as well. An item is held if
    at least `containment` of its windows stand in one place of the document, each of them for one window of the document and in the
    item's order, and each slot value of the item is replaced consistently there: "verbatim" if all slots are as in the item, else
    "reparameterised", which also asks for `containment` of the windows with a word that is no placeholder. Every offset with
    enough windows is tried, and a verbatim place given first; copies with words put in or left out are aligned by one longest
    chain for each stretch of the text. Items shorter than a window match documents that consist of them alone.

    The join asks for the windows of an item that fewest other items have, as many as no holder can lack, and a filter
    of bounded size stands before it, so that the documents are read once whatever the size of the benchmark.

    Null or empty texts and items hold nothing; repeated rows, of documents or items, give repeated results; null ids are
    kept, other columns don't matter; no documents or no items: no rows.
    """
    found = judged(docs, benchmark, id_col, text_col, item_col, item_text_col, containment)
    return found.select(F.col("doc").alias("doc_id"), "item_id", "containment", "kind", "first_word", "end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """Filter: rows whose text holds no benchmark item, all columns as they are; null texts stay. A row is known by its id and the
    hash of its text: equal rows share their fate."""
    found = judged(docs, benchmark, id_col, text_col, item_col, item_text_col, containment)
    bad = settle(found.select(F.col("doc").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs[text_col]) == bad["bad_hash"]), "left_anti")


def brute_force(rows: list[tuple[int, str]], items: list[tuple[int, str]], containment: float = CONTAINMENT) -> list[tuple]:
    """Results of find() by looking every item up in every text; for tests."""
    block, lex = make_block(items), Lexer()
    return [(d, *m) for d, t in rows for m in matches(t or "", block, lex, containment)]
