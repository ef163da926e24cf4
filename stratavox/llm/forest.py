"""Near-duplicate vectors by a forest of random-projection trees with spill (operator 3)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.llm.blocks import map_batches, star_edges
from stratavox.operators.components import connected_components
from stratavox.runtime import settle

COSINE = 0.93
#: Vectors of a leaf that isn't split further, and of one side of a cell of a leaf that can't be.
LEAF_ROWS = 2048
CELL_ROWS = 2048
#: Sampled vectors that the splits of one node are fitted on, and the least that one split is fitted on. All rows are indexed.
SAMPLE_ROWS, SPLIT_ROWS = 1024, 32
#: Chance that a pair just at the threshold is missed by all trees, and the trees at least.
MISS, MIN_TREES = 1e-5, 3
SEED = 20_240_607
#: A split that sends more than this share of its rows to both sides is not worth making; directions that are tried.
MAX_SPILL, TRIES = 0.5, 3


def margin(dim: int, cosine: float) -> float:
    """Half a standard deviation of the projected distance of two unit vectors at the least cosine."""
    return 0.5 * math.sqrt((2 - 2 * cosine) / dim)


def trees_for(n):
    """Trees of a group of n rows, as a column. A level keeps 0.575 of a node's rows, spill included, and separates a pair
    just at the threshold with a chance of 0.025 at most."""
    levels = F.greatest(F.lit(1.0), F.log(n / LEAF_ROWS) / math.log(1.74))
    trees = F.ceil(F.lit(math.log(MISS)) / F.log(F.least(F.lit(0.9), levels * 0.025)))
    return F.when(n <= LEAF_ROWS, 1).otherwise(F.greatest(F.lit(MIN_TREES), trees)).cast("int")


def directions(node: int, tries: int, dim: int) -> np.ndarray:
    """The random directions of a node's splits, the same wherever they are made."""
    u = np.random.default_rng([SEED, node & 0xFFFFFFFFFFFFFFFF]).standard_normal((tries, dim))
    return u / np.linalg.norm(u, axis=1, keepdims=True)


class Splits:
    """Some levels of splits below one node. A split has a direction by its number, a threshold and children (negative: leaf)."""

    #: Most splits of one node, and so most directions.
    MOST = 2 * TRIES * SAMPLE_ROWS // SPLIT_ROWS

    @staticmethod
    def fit(node: int, x: np.ndarray, scale: float, cosine: float, leaf_rows: int) -> list[tuple[int, float, int, int]]:
        """From a sample of unit vectors; scale: rows of the node for each row of the sample. No splits: it can't be split."""
        delta, every, out = margin(x.shape[1], cosine), directions(node, Splits.MOST, x.shape[1]), []
        used = leaves = 0

        def grow(rows: np.ndarray) -> int:
            nonlocal used, leaves
            if len(rows) * scale > leaf_rows and len(rows) >= min(SPLIT_ROWS, len(x)):
                for _ in range(TRIES):
                    if used == len(every):
                        break
                    k, used = used, used + 1
                    p = x[rows] @ every[k]
                    cut = float(np.median(p))
                    a, b = rows[p <= cut + delta], rows[p > cut - delta]
                    if len(a) + len(b) - len(rows) <= MAX_SPILL * len(rows) and len(a) < len(rows) and len(b) < len(rows):
                        i = len(out)
                        out.append((k, cut, 0, 0))
                        out[i] = (k, cut, grow(a), grow(b))
                        return i
            leaves += 1
            return -leaves

        grow(np.arange(len(x)))
        return out

    @staticmethod
    def route(node: int, splits: list[tuple[int, float, int, int]], x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, leaf numbers from 1) of unit vectors; a row near a threshold is in several leaves."""
        delta, every = margin(x.shape[1], cosine), directions(node, Splits.MOST, x.shape[1])
        rows, leaf = [], []
        stack = [(0 if splits else -1, np.arange(len(x)))]
        while stack:
            i, r = stack.pop()
            if not len(r):
                continue
            if i < 0:
                rows.append(r)
                leaf.append(np.full(len(r), -i))
                continue
            k, cut, left, right = splits[i]
            p = x[r] @ every[k]
            stack += [(left, r[p <= cut + delta]), (right, r[p > cut - delta])]
        return np.concatenate(rows), np.concatenate(leaf)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, of components of any size."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


_SPLIT = "array<struct<k:int,cut:double,left:int,right:int>>"


def _fit(cosine: float, leaf_rows: int):
    """The sample (node, n, vec) of one node gives (node, splits)."""
    kind = pa.list_(pa.struct([("k", pa.int32()), ("cut", pa.float64()), ("left", pa.int32()), ("right", pa.int32())]))

    def run(table: pa.Table) -> pa.Table:
        node, n = table.column("node")[0].as_py(), table.column("n")[0].as_py()
        splits = Splits.fit(node, _unit(_matrix(table.column("vec"))), n / table.num_rows, cosine, leaf_rows)
        return pa.table([pa.array([node], pa.int64()), pa.array([[dict(zip(("k", "cut", "left", "right"), x, strict=True)) for x in splits]], kind)], ["node", "splits"])

    return run


def _route(cosine: float):
    """Rows (key, node, vec, splits) become one row (key, node, leaf) per leaf; leaf 0: the node stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, node = np.asarray(b.column(0)), np.asarray(b.column(1))
            every, first, inv = np.unique(node, return_index=True, return_inverse=True)
            order, cut = np.argsort(inv, kind="stable"), np.cumsum(np.bincount(inv))[:-1]
            out = [(np.zeros(0, np.int64),) * 3]
            for x, at, own in zip(every.tolist(), first.tolist(), np.split(order, cut) if len(every) else [], strict=True):
                splits = [tuple(s.values()) for s in b.column(3)[at].as_py() or []]
                if splits:
                    rows, leaf = Splits.route(x, splits, _unit(_matrix(b.column(2).take(pa.array(own)))), cosine)
                    out.append((key[own[rows]], node[own[rows]], leaf))
                else:
                    out.append((key[own], node[own], np.zeros(len(own), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "node", "leaf"])

    return run


def leaves(reps: DataFrame, groups: DataFrame, cosine: float) -> DataFrame:
    """(key, leaf) of vectors (key, label, vec): every vector in every tree of its group (label, dim, n, trees).

    Nodes of more than LEAF_ROWS rows are split some levels at a time, by thresholds that tasks of the cluster fit on a
    sample of each such node; so leaves are small however many rows there are, and nothing of the trees passes
    the driver. Nodes that can't be split stay large.
    """
    rooted = reps.join(groups, (reps["label"] == groups["label"]) & (F.size(reps["vec"]) == groups["dim"]))
    tree = F.explode(F.sequence(F.lit(1), F.col("trees")))
    rooted = rooted.select("key", "vec", "n", reps["label"], "dim", tree.alias("tree")).select("key", F.xxhash64("label", "dim", "tree").alias("node"), "n", "vec")
    done = [rooted.where(F.col("n") <= LEAF_ROWS).select("key", F.col("node").alias("leaf"))]
    large = rooted.where(F.col("n") > LEAF_ROWS)
    while not large.isEmpty():
        share = F.pmod(F.xxhash64("key", "node"), F.lit(1 << 30)) < F.lit(float(1 << 30) * SAMPLE_ROWS) / F.col("n")
        splits = settle(large.where(share).select("node", "n", "vec").groupBy("node").applyInArrow(_fit(cosine, LEAF_ROWS), f"node long, splits {_SPLIT}"), "splits")
        asked = large.select("key", "node", "vec").join(splits, "node", "left").select("key", "node", "vec", "splits")
        routed = settle(map_batches(asked, _route(cosine), "key long, node long, leaf long", rows=10_000), "routed")
        below = routed.where("leaf > 0").select("key", F.xxhash64("node", "leaf").alias("node"))
        sizes = settle(below.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > LEAF_ROWS), "large")
        done.append(routed.where("leaf = 0").select("key", F.col("node").alias("leaf")))
        done.append(below.join(sizes, "node", "left_anti").select("key", F.col("node").alias("leaf")))
        large = below.join(sizes, "node").join(reps.select("key", "vec"), "key").select("key", "node", "n", "vec")
    return reduce(DataFrame.unionByName, done)


def _first_shared(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Whether rows of a and b (leaves, padded) share no leaf before this one."""
    ok = np.ones(len(a), bool)
    for i in range(a.shape[1]):
        col = a[:, i : i + 1]
        ok &= ~((col == b) & (col < leaf)).any(1)
    return ok


def _compare(cosine: float):
    """Pairs inside one cell: direct links of each vector, counted in the first leaf that both share, and star edges."""

    def cell(side: np.ndarray, leaf: int, rep: np.ndarray, n: np.ndarray, x: np.ndarray, leaves: np.ndarray, same: bool):
        a = np.flatnonzero(side != 1) if not same else np.arange(len(rep))
        b = np.flatnonzero(side == 1) if not same else a
        links = np.zeros(len(rep), np.int64)
        ea, eb = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(a), 256):
            part = a[at : at + 256]
            i, j = np.nonzero(x[part] @ x[b].T >= cosine)
            i, j = part[i], b[j]
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 100_000):
                p, q = i[k : k + 100_000], j[k : k + 100_000]
                new = _first_shared(leaves[p], leaves[q], leaf)
                p, q = p[new], q[new]
                np.add.at(links, p, n[q])
                np.add.at(links, q, n[p])
                ea.append(rep[p])
                eb.append(rep[q])
        node, root = star_edges(np.concatenate(ea), np.concatenate(eb))
        hit = np.flatnonzero(links)
        return rep[hit], links[hit], node, root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            lists = t.column("leaves").combine_chunks()
            width = np.diff(np.asarray(lists.offsets))
            padded = np.full((len(lists), int(width.max())), 1 << 62, np.int64)
            padded[np.arange(padded.shape[1])[None, :] < width[:, None]] = np.asarray(lists.flatten())
            i, j = int(t.column("i")[0].as_py()), int(t.column("j")[0].as_py())
            side = (np.asarray(t.column("own")) == j).astype(int)
            r, links, node, root = cell(side, int(t.column("leaf")[0].as_py()), np.asarray(t.column("key")), np.asarray(t.column("n")), _unit(_matrix(t.column("vec"))), padded, i == j)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([r, node])), pa.array(np.concatenate([links, np.zeros(len(node), np.int64)])), pa.array([None] * len(r) + root.tolist(), pa.int64())], ["key", "links", "root"]
            )

        key = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*(b.column(c).to_pylist() for c in ("label", "dim", "leaf", "i", "j")), strict=True))
            start = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[start]:
                    if key is not None and keys[start] != key and held:
                        yield flush()
                    key = keys[start]
                    held.append(b.slice(start, k - start))
                    start = k
        if held:
            yield flush()

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors with the same non-null label link if their cosine, in double precision, is `cosine` or more.
    Vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null label or
    null id, link with nothing: n_links 0, component_id their own id. Equal vectors of a label are compared once;
    each counts the others as links. Rows that share an id are separate vectors, equal or not: each has its own links, and
    equal ones link with each other. Other columns don't matter. No rows: no rows.

    Every vector is put into every tree, into both children where it is near a threshold. A leaf that can't be split is
    dealt over a grid of cells. A cell counts a pair only in the first leaf that its vectors share, so neither pairs nor their
    repeats are ever shuffled: a cell returns counts and star edges, linear in its rows.
    """
    kind = vectors.schema[vec_col].dataType.simpleString()
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].cast("long").alias("label"), vectors[vec_col].cast(kind if kind == "array<float>" else "array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    usable = rows.where("good")
    reps = settle(usable.groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("key", F.monotonically_increasing_id()), "vectors")
    sizes = reps.groupBy("label", F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    groups = settle(sizes.withColumn("trees", trees_for(F.col("n"))), "groups")
    found = settle(leaves(reps.select("key", "label", "vec"), groups, cosine), "leaves")
    many = found.groupBy("leaf").agg(F.count("*").alias("size")).where(F.col("size") > CELL_ROWS)
    big = settle(many.select("leaf", F.ceil(F.col("size") / CELL_ROWS).cast("int").alias("parts")), "big")
    lists = found.groupBy("key").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))  # bounded by trees and spill
    placed = lists.join(reps.select("key", "n", "label", F.size("vec").alias("dim"), "vec"), "key").select("*", F.explode("leaves").alias("leaf"))
    dealt = placed.join(big, "leaf", "left")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("key"), parts.cast("long")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = dealt.select("label", "dim", "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "n", "vec", "leaves")
    cells = cells.repartition("label", "dim", "leaf", "i", "j").sortWithinPartitions("label", "dim", "leaf", "i", "j")
    linked = settle(map_batches(cells, _compare(cosine), "key long, links long, root long"), "links")
    links = linked.where("links > 0").groupBy("key").agg(F.sum("links").alias("links"))
    roots = connected_components(linked.where("root is not null"), "key", "root")
    merged = reps.join(links, "key", "left").join(roots.withColumnRenamed("root", "top"), F.col("key") == F.col("node"), "left").withColumn("top", F.coalesce("top", "key"))
    least = merged.groupBy("top").agg(F.min("first").alias("component_id"))
    known = merged.join(least, "top").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    full = usable.join(known, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def oracle_sql(cosine: float = COSINE) -> str:
    """The same by all pairs of a label, for DuckDB on small tables."""
    return f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {cosine}
), reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
degree AS (SELECT a, count(*) AS n FROM pairs GROUP BY a), least_of AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(l.low, e.vec_id)) AS component_id, least(e.vec_id, coalesce(l.low, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least_of l ON l.a = e.vec_id
"""


def brute_force(rows: list[tuple[int, int | None, list[float] | None]], cosine: float = COSINE) -> dict[int, tuple[int, int]]:
    """(n_links, component_id) of each id by comparing all pairs of a label; for tests."""
    good = {i: (lab, np.array(v, float)) for i, lab, v in rows if lab is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    by_label: dict = {}
    for i, (lab, v) in good.items():
        by_label.setdefault((lab, len(v)), []).append(i)
    for ids in by_label.values():
        x = _unit(np.array([good[i][1] for i in ids]))
        for p, q in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1)), strict=True):
            i, j = ids[p], ids[q]
            links[i] += 1
            links[j] += 1
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return {i: (links[i], top(i)) for i in root}
