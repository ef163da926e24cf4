"""Near copies by SimHash over distinct words, Golay keys and an exact check of five-word shingles.

Fingerprints within three bits, as operator 4 links them, miss many texts of which a few words were changed. Here
candidates come from the fingerprint of the distinct words, which moves by few bits when words change, through
Golay keys that forgive two errors in each of two segments; what links is then decided on the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.llm.blocks import map_batches, pick, raw_bytes
from stratavox.llm.golay import codewords
from stratavox.llm.simhash import HOT, KEYED, SEGMENTS, near_duplicates
from stratavox.operators.components import connected_components
from stratavox.runtime import settle

SIMILARITY = 0.8
SHINGLE = 5
#: Differing bits of word fingerprints that are looked at: texts at the least similarity differ in four to five on
#: average, unrelated ones in about thirty.
NEAR_BITS = 10
#: Candidate pairs for each text of a cell beyond which its texts are compared in place.
DENSE = 2
#: Texts, and bytes of their shingle hashes, of one side of a cell of dense groups.
CELL_ROWS = 1024
CELL_BYTES = 16 << 20
SKETCH_BITS = 1024


def word_fingerprint(text: bytes) -> int:
    """SimHash of the set of words, A-Z lowered, cut at ASCII white space; no word gives 0."""
    words = set(text.lower().split())
    if not words:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 17):
        ones += np.unpackbits(h[at : at + (1 << 17)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; a shorter text is one shingle, an empty one has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 7) for g in grams), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) if len(a) or len(b) else 1.0


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in fp): the Golay indices near two of three segments, for each pair of segments.

    Fingerprints with at most two errors in each of two segments share a key. Its bits: pair, index, index.
    """
    u = fp.view(np.uint64)
    near = [codewords((u >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    out, pos = [], []
    for kind, (i, j) in enumerate(combinations(range(3), 2)):
        for a in range(6):
            for b in range(6):
                has = np.flatnonzero((near[i][:, a] >= 0) & (near[j][:, b] >= 0))
                out.append(kind << 24 | near[i][has, a] << 12 | near[j][has, b])
                pos.append(has)
    return np.concatenate(out), np.concatenate(pos)


def is_own_key(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Whether a key is made of the nearest codewords of its fingerprint's segments, and not of farther ones."""
    u = fp.view(np.uint64)
    near = [codewords((u >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64))[:, 0] for at, n in SEGMENTS]
    own = np.stack([kind << 24 | near[i] << 12 | near[j] for kind, (i, j) in enumerate(combinations(range(3), 2))])
    return own[key >> 24, np.arange(len(key))] == key


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A lightest spanning forest of the pairs (a, b): linear in nodes, and whatever is connected by light pairs
    stays connected by pairs as light."""
    order = np.argsort(weight, kind="stable")
    a, b = a[order], b[order]
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[: len(a)], inv[len(a) :]
    edge, root = np.arange(len(a)), np.arange(len(ids))
    taken = []
    while len(edge):
        first = np.full(len(ids), len(a))
        np.minimum.at(first, root[i], edge)
        np.minimum.at(first, root[j], edge)
        pick_ = np.unique(first[first < len(a)])
        taken.append(pick_)
        x, y = root[inv[pick_]], root[inv[len(a) + pick_]]
        top = np.arange(len(ids))
        while True:
            low = np.minimum(top[x], top[y])
            nxt = top.copy()
            np.minimum.at(nxt, top[x], low)
            np.minimum.at(nxt, top[y], low)
            nxt = nxt[nxt]
            if np.array_equal(nxt, top):
                break
            top = nxt
        root = top[root]
        on = root[i] != root[j]
        i, j, edge = i[on], j[on], edge[on]
    taken = np.concatenate(taken) if taken else np.zeros(0, np.int64)
    return a[taken], b[taken]


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        every, many = np.asarray(b.column(0)), np.asarray(b.column(1))
        for at in range(0, len(every), KEYED):
            fp, w = every[at : at + KEYED], many[at : at + KEYED]
            k, p = keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[p]), pa.array(w[p])], ["k", "fp", "w"])


def _by_cell(batches: Iterator[pa.RecordBatch], cells: int, of) -> Iterator[pa.RecordBatch]:
    """of(columns) on runs of whole cells of rows sorted by their first `cells` columns."""
    left: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b])
        same = np.ones(b.num_rows, bool)
        for c in range(cells):
            v = np.asarray(b.column(c))
            same &= v == v[-1]
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if left is None:
            left = now.slice(0, 0)
        if cut:
            yield of(pa.concat_tables([left, now.slice(0, cut)]).combine_chunks())
            left = now.slice(cut)
        elif left.num_rows and any(left.column(c)[-1] != now.column(c)[0] for c in range(cells)):
            yield of(left.combine_chunks())
            left = now
        else:
            left = pa.concat_tables([left, now])
    if left is not None and left.num_rows:
        yield of(left.combine_chunks())


def _starts(*cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cell], axis=0)) + 1
    return np.r_[0, cut], np.r_[cut, len(cell[0])]


def _near_in_cells(bits: int):
    """Rows (k, i, j, own, fp, w) sorted by cell give near pairs (0, fp, fp), or of dense cells the members (1, k, fp)."""

    def of(t: pa.Table) -> pa.RecordBatch:
        k, i, j, own, fp, w = (np.asarray(t.column(c)) for c in range(6))
        fp = fp.view(np.uint64)
        start, end = _starts(k, i, j)
        m = end - start
        off = i[start] != j[start]
        pairs = [np.zeros((0, 2), np.uint64)]
        members = [np.zeros((0, 2), np.uint64)]
        small = ~off & (m > 1) & (m <= 64)
        s, n = start[small], m[small]
        for size in np.unique(n):  # runs of one size together: one table of index pairs serves them all
            p, q = np.triu_indices(size, 1)
            rows = s[n == size]
            for at in range(0, len(rows), max(1, (1 << 20) // len(p))):
                r = rows[at : at + max(1, (1 << 20) // len(p)), None]
                x, y = fp[r + p], fp[r + q]
                d = np.bitwise_count(x ^ y)
                on = (d <= bits) & (d > 0)
                dense = (on * w[r + p] * w[r + q]).sum(axis=1) > DENSE * w[r + np.arange(size)].sum(axis=1)
                if dense.any():
                    c, e = np.nonzero(on & dense[:, None])
                    at_ = np.unique(np.concatenate([r[c, 0] + p[e], r[c, 0] + q[e]]))
                    members.append(np.column_stack([k[at_].view(np.uint64), fp[at_]]))
                    on &= ~dense[:, None]
                pairs.append(np.column_stack([x[on], y[on]]))
        for a, e, o in zip(start[~small & (m > 1)], end[~small & (m > 1)], off[~small & (m > 1)], strict=True):
            one = np.arange(a, e) if not o else a + np.flatnonzero(own[a:e] == i[a])
            two = one if not o else a + np.flatnonzero(own[a:e] != i[a])
            weight, most, found, held = 0, DENSE * int(w[a:e].sum()), [], np.zeros(e - a, bool)
            for at in range(0, len(one), 1024):
                part = one[at : at + 1024]
                d = np.bitwise_count(fp[part, None] ^ fp[None, two])
                p, q = np.nonzero((d <= bits) & (d > 0))
                p, q = part[p], two[q]
                if not o:
                    p, q = p[p < q], q[p < q]
                held[p - a] = held[q - a] = True
                weight += int((w[p] * w[q]).sum())
                found = found + [np.column_stack([fp[p], fp[q]])] if weight <= most else []
            if weight > most:
                at_ = a + np.flatnonzero(held)
                members.append(np.column_stack([k[at_].view(np.uint64), fp[at_]]))
            else:
                pairs += found
        near = np.concatenate(pairs)
        near = np.unique(np.sort(near.view(np.int64), axis=1), axis=0)
        dense_ = np.concatenate(members).view(np.int64)
        kind = np.repeat(np.array([0, 1], np.int32), [len(near), len(dense_)])
        both = np.concatenate([near, dense_])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(both[:, 0]), pa.array(both[:, 1])], ["kind", "a", "b"])

    return lambda batches: _by_cell(batches, 3, of)


def candidate_edges(distinct: DataFrame, bits: int = NEAR_BITS, hot: int = HOT) -> DataFrame:
    """(kind, a, b) of distinct word fingerprints (columns fp, w: its texts): kind 0 are all pairs of unequal fingerprints
    within `bits` that share a key, but of cells with more than DENSE pairs a text; of those kind 1 gives the key (a)
    and its fingerprints with a partner (b), whose texts are to be compared in place.

    A key of more than `hot` fingerprints is dealt over a grid of cells, one for each pair of its parts, so no
    task holds the whole key and no pair is lost.
    """
    rows = map_batches(distinct.select("fp", "w"), _key_rows, "k long, fp long, w long")
    many = settle(rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("k", F.ceil(F.col("n") / hot).cast("int").alias("parts")), "hot")
    zero = F.lit(0)
    if many.isEmpty():
        dealt = rows.select("k", zero.alias("i"), zero.alias("j"), zero.alias("own"), "fp", "w")
    else:
        cold = rows.join(many, "k", "left_anti").select("k", zero.alias("i"), zero.alias("j"), zero.alias("own"), "fp", "w")
        own = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int")
        wide = rows.join(many, "k").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = cold.unionByName(wide.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "w"))
    cells = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return settle(map_batches(cells, _near_in_cells(bits), "kind int, a long, b long", rows=100_000).distinct(), "candidates")


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes over SKETCH_BITS places. Two sketches differ in at most as many bits as the sets do in
    members, so what they rule out is surely below the similarity."""
    odd = np.bincount((s >> np.uint64(20)) & np.uint64(SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1 if len(s) else np.zeros(SKETCH_BITS, np.int64)
    return np.packbits(odd.astype(bool)).view(np.uint64)


def linked(fp: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, equal: bool, bits: int, least: float, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows that have the similarity: every pair is compared, unless links found
    before connect it, or rows have the same `known` group. Equal fingerprints count if `equal`, others within `bits` if
    not; with sides, pairs of unequal sides only."""
    n, out = len(fp), []
    size = np.array([len(s) for s in sets])
    sketch = np.stack([odd_sketch(s) for s in sets])
    root = list(range(n)) if known is None else (lambda first, inv: first[inv])(*np.unique(known, return_index=True, return_inverse=True)[1:]).tolist()

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at in range(0, n, 64):
        part = np.arange(at, min(n, at + 64))
        tops = np.array([top(x) for x in range(n)])
        d = np.bitwise_count(fp[part, None] ^ fp[None, :])
        on = (d == 0 if equal else (d > 0) & (d <= bits)) & (tops[part, None] != tops[None, :])
        on &= part[:, None] < np.arange(n)[None, :]
        if side is not None:
            on &= side[part, None] != side[None, :]
        on &= np.minimum(size[part, None], size[None, :]) >= least * np.maximum(size[part, None], size[None, :]) - 1e-6
        p, q = np.nonzero(on)
        p = part[p]
        for k in range(0, len(p), 1 << 16):
            x, y = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
            apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
            may = apart <= (1 - least) / (1 + least) * (size[x] + size[y]) + 1e-6
            for u, v in zip(x[may].tolist(), y[may].tolist(), strict=True):
                ru, rv = top(u), top(v)
                if ru != rv and similarity(sets[u], sets[v]) >= least:
                    root[max(ru, rv)] = min(ru, rv)
                    out.append((u, v))
    return out


def _link_cells(bits: int, least: float):
    """Rows (kind, k, i, j, own, node, fp, root, s) sorted by cell give similar edges, those of a run of cells thinned to a forest."""

    def of(t: pa.Table) -> pa.RecordBatch:
        kind, k, i, j, own, node, fp, known = (np.asarray(t.column(c)) for c in range(8))
        a, b = [], []
        for s, e in zip(*_starts(kind, k, i, j), strict=True):
            sets = [np.frombuffer(x, np.uint64) for x in t.column(8).slice(s, e - s).to_pylist()]
            side = own[s:e] if i[s] != j[s] else None
            for u, v in linked(fp[s:e].view(np.uint64), sets, side, kind[s] == 2, bits, least, known[s:e]):
                a.append(node[s + u])
                b.append(node[s + v])
        a, b = forest(np.array(a, np.int64), np.array(b, np.int64), np.zeros(len(a)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return lambda batches: _by_cell(batches, 4, of)


def cell_edges(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of similar texts of groups, rows (kind, k, fp, node, n_words, root): each group is dealt over a grid of cells of
    bounded rows and bytes, and compared there. Texts of the same root are connected already."""
    parts = F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(8 * F.sum("n_words") / CELL_BYTES)).cast("int")
    sizes = settle(rows.groupBy("kind", "k").agg(parts.alias("parts")), "dense")
    own = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")).otherwise(F.lit(0))
    wide = rows.join(sizes, ["kind", "k"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = wide.select("kind", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "fp", "root").join(sets, "node")
    cells = cells.select("kind", "k", "i", "j", "own", "node", "fp", "root", "s").repartition("kind", "k", "i", "j").sortWithinPartitions("kind", "k", "i", "j")
    return map_batches(cells, _link_cells(NEAR_BITS, least), "a long, b long")


def dense_edges(members: DataFrame, texts: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of similar texts of dense groups, members (kind, k, fp).

    Near copies share many keys. First they are compared under the keys of their nearest codewords, three at most a text.
    Then the other keys follow, without those whose texts are all connected by now: their pairs could
    connect nothing. Keys with one codeword in common are taken together, as many as leave groups of a quarter of a cell's
    rows on average, so that a text isn't sent to one group for each of its keys; a group compares all that its keys would."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, k, fp = (np.asarray(b.column(c)) for c in range(3))
            own = kind == 2
            own[~own] = is_own_key(k[~own], fp[~own])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], ["kind", "k", "fp", "nearest"])

    rows = settle(map_batches(members, mark, "kind int, k long, fp long, nearest boolean", rows=KEYED).join(texts, "fp"), "dense_texts")
    columns = ["kind", "k", "fp", "node", "n_words"]
    first = settle(cell_edges(rows.where("nearest").select(*columns, F.col("node").alias("root")), sets, least), "nearest_edges")
    roots = connected_components(first).select(F.col("node").alias("linked"), F.col("root").alias("top"))
    rest = rows.where("kind = 1").join(roots, F.col("node") == F.col("linked"), "left").select(*columns, F.coalesce("top", "node").alias("root"))
    rest = settle(rest, "dense_rest")
    apart = rest.groupBy("kind", "k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("kind", "k")
    rest = settle(rest.join(apart, ["kind", "k"], "left_semi"), "dense_apart")
    keep = min(1 << 12, max(1, 4 * rest.count() // (3 * CELL_ROWS << 12)))  # values of the first codeword's number that stay apart
    second = F.col("k").bitwiseAND(F.lit(0xFFF))
    grouped = (F.shiftright("k", 24) * (1 << 24)) + second * (1 << 12) + F.pmod(F.shiftright("k", 12), F.lit(keep))
    return first.unionByName(cell_edges(rest.withColumn("k", grouped).distinct(), sets, least))


def similar_edges(docs: DataFrame, id_col: str, text_col: str, least: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) of ids of rows whose five-word shingles have a Jaccard similarity of `least` or more, enough to
    connect all such pairs of equal fingerprints or of a shared key: nothing is thinned before its similarity is known.

    Groups with many candidate pairs are compared in place and give forests; of the pairs of the other ones those
    that these forests don't connect are compared one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [t.lower().split() for t in raw_bytes(b.column(1))]
            fp = np.array([word_fingerprint(t) for t in raw_bytes(b.column(1))], np.uint64)
            same = np.array([xxhash.xxh64_intdigest(b" ".join(w), 3) for w in words], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), pa.array(same.view(np.int64)), pa.array([len(w) for w in words], pa.int64())], ["doc", "fp", "copy", "n_words"])

    source = pick(docs, doc=id_col, text=text_col).where("doc is not null")
    fps = settle(map_batches(source, run, "doc long, fp long, copy long, n_words long"), "word_fingerprints")
    # texts of equal words are told apart no further: operator 4 has linked them already
    texts = settle(fps.groupBy("fp", "copy").agg(F.min(F.struct("doc", "n_words")).alias("x")).select(F.col("x.doc").alias("node"), "fp", F.col("x.n_words").alias("n_words")), "texts")
    heads = settle(texts.groupBy("fp").agg(F.count("*").alias("w")), "heads")
    found = candidate_edges(heads)
    crowded = heads.where(F.col("w") > 2 * DENSE).select(F.lit(2).alias("kind"), F.col("fp").alias("k"), "fp")
    members = settle(found.where("kind = 1").select("kind", F.col("a").alias("k"), F.col("b").alias("fp")).unionByName(crowded), "members")
    named = found.where("kind = 0").join(texts.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(texts.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b").select("na", "nb")
    few = texts.join(heads.where(F.col("w").between(2, 2 * DENSE)), "fp").select("fp", "node")
    alike = few.select("fp", F.col("node").alias("na")).join(few.select("fp", F.col("node").alias("nb")), "fp").where("na < nb").select("na", "nb")
    wanted = settle(named.unionByName(alike).select(F.col("na").alias("a"), F.col("nb").alias("b")), "pairs")
    involved = wanted.select(F.explode(F.array("a", "b")).alias("id")).unionByName(members.join(texts, "fp").select(F.col("node").alias("id"))).distinct().hint("shuffle_hash")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t).tobytes() for t in raw_bytes(b.column(1))], pa.binary())], ["node", "s"])

    # rows that share an id are compared by one of their texts
    held = settle(map_batches(source.join(involved, source["doc"] == involved["id"], "left_semi"), sets, "node long, s binary"), "shingles")
    edges = None
    if not members.isEmpty():
        edges = settle(dense_edges(members, texts, held, least), "dense_edges")
        if not edges.isEmpty():
            roots = connected_components(edges)
            wanted = wanted.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
            wanted = wanted.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    left = wanted.join(held.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(held.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    single = map_batches(both, check, "a long, b long")
    return single if edges is None else single.unionByName(edges)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id, n): each non-null id, its group and its rows. A group is connected by links of operator 4
    and by similar edges."""
    close = near_duplicates(docs, id_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n"))
    close = settle(close, "close")
    edges = similar_edges(docs, id_col, text_col).unionByName(close.where("doc_id <> c").select(F.col("doc_id").alias("a"), F.col("c").alias("b")))
    roots = connected_components(edges)
    return close.join(roots, close["doc_id"] == roots["node"], "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"), "n")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Filter: of each group only its smallest id stays, once; rows with a null id stay, null and empty texts are copies of
    one another."""
    seen = settle(groups(docs, id_col, text_col), "seen")
    # the texts are dealt by id at every size, against the ids to remove in memory and without sorting the texts
    gone = seen.where("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).hint("shuffle_hash")
    kept = docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
    again = seen.where("component_id = doc_id and n > 1").select(F.col("doc_id").alias("again_id"))
    if again.isEmpty():
        return kept
    # ids that occur more than once are few; only their rows are regrouped
    single = kept.join(again, kept[id_col] == again["again_id"], "left_anti")
    return single.unionByName(kept.join(again, kept[id_col] == again["again_id"], "left_semi").dropDuplicates([id_col]))
