"""Near copies among crowds of texts that are alike but not similar enough."""

import numpy as np
import pytest

from stratavox.llm import copies


def lost(found, rows, least=0.8):
    """Pairs of texts that are similar, and whether fingerprints in reach of the keys, but that the groups part."""
    fp = {i: copies.word_fingerprint(t.encode()) for i, t in rows}
    sets = {i: copies.shingle_hashes(t.encode()) for i, t in rows}
    key = {i: set(copies.keys(np.array([f], np.uint64).view(np.int64))[0].tolist()) for i, f in fp.items()}
    ids, out, similar = list(fp), [], 0
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fp[i] ^ fp[j]).bit_count() <= copies.NEAR_BITS and (fp[i] == fp[j] or key[i] & key[j]) and copies.similarity(sets[i], sets[j]) >= least:
                similar += 1
                if found[i] != found[j]:
                    out.append((i, j))
    return out, similar


@pytest.mark.parametrize("dense, cell", [(8, 1024), (1, 48), (10**9, 1024)])
def test_true_pairs_among_boilerplate_are_compared(spark, monkeypatch, dense, cell):
    monkeypatch.setattr(copies, "DENSE", dense)
    monkeypatch.setattr(copies, "CELL_ROWS", cell)
    rng = np.random.default_rng(5)
    shared = [f"b{k}" for k in range(200)]
    rows = []
    for g in range(200):
        base = [*shared, f"o{g}", f"p{g}"]
        rng.shuffle(base)  # near in words, far in shingles
        rows.append((len(rows), " ".join(base)))
        if g % 2:
            for at in (20, 90, 160):
                base[at] = f"n{g}x{at}"
            rows.append((len(rows), " ".join(base)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    edges = [(r["a"], r["b"]) for r in copies.similar_edges(table, "doc_id", "text").collect()]
    root = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    text = dict(rows)
    assert all(copies.similarity(copies.shingle_hashes(text[a].encode()), copies.shingle_hashes(text[b].encode())) >= 0.8 for a, b in edges)
    missed, similar = lost(root, rows)
    assert similar > 50 and not missed
    assert len(edges) <= 30 * len(rows)
