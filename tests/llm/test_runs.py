import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from stratavox.llm import queries as Q
from stratavox.llm import runs as R


def naive_runs(words):
    """Every stretch by its definition: all periods, all maximal stretches, smallest period first."""
    n, found = len(words), {}
    for p in range(1, n + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            found.setdefault((i, j + p), p)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted((a, z - a, p) for (a, z), p in found.items() if z - a >= max(6, 4 * p))


def naive_row(doc, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(naive_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, p in found for i in range(s + p, s + length)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * top[1] // top[2] if found else None
    return (doc, len(found), *top, milli, sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def engine(words):
    s = R.word_numbers([w.encode() for w in words])
    parts = list(R.grid_pairs(s))
    if not parts:
        return []
    return [tuple(r) for r in R.find_runs([s], [tuple(np.concatenate(x) for x in zip(*parts, strict=True))])[0].tolist()]


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_against_the_definition(letters):
    rng = random.Random(letters)
    for _ in range(150):
        n = rng.randint(0, 70)
        words = [rng.choice("abcdefg"[:letters]) for _ in range(n)]
        if n > 20 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert engine(words) == naive_runs(words), words


def test_texts_together_and_alone():
    rng = random.Random(3)
    texts = [[rng.choice("ab") for _ in range(rng.randint(20, 90))] for _ in range(30)]
    s = [R.word_numbers([w.encode() for w in t]) for t in texts]
    have = [k for k in range(len(s)) if list(R.grid_pairs(s[k]))]
    pairs = [tuple(np.concatenate(x) for x in zip(*R.grid_pairs(s[k]), strict=True)) for k in have]
    for k, found in zip(have, R.find_runs([s[k] for k in have], pairs), strict=True):
        assert [tuple(r) for r in found.tolist()] == naive_runs(texts[k])


def test_grid_in_parts(monkeypatch):
    monkeypatch.setattr(R, "GRID_PAIRS", 7)
    words = list("abcabcabcabcabcxyxyxyxyxyxyzzzzzzzz")
    assert engine(words) == naive_runs(words)


def test_rows_of_a_table(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "x " * 500), (103, "x " * 500), (104, "one word " * 8), (None, "y " * 9), (105, "a\x0bb\x0cc\r" * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS runs", "2 AS top")
    docs.write.mode("overwrite").parquet(path := R_dir(spark) + "/documents.parquet")
    got = Q.op11_periodic_runs(spark, path.rsplit("/", 1)[0])
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((naive_row(d, t, d is not None) for d, t in rows), key=key)


def R_dir(spark):
    from stratavox.runtime import shared_dir

    return shared_dir(spark) + "/runs-test"


def test_given_documents(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in rows if len((r["text"] or "").split()) < 1500}
    got = {r["doc_id"]: tuple(r) for r in Q.op11_periodic_runs(spark, small).collect()}
    assert len(got) == len(rows)
    assert all(got[d] == naive_row(d, t) for d, t in short.items())


def test_no_rows_and_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.periodic_runs(empty).count() == R.plant_runs(empty).count() == 0
    long = spark.createDataFrame([(1, "a b c " * 100_000)], "doc_id long, text string")
    r = R.periodic_runs(long).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 300_000, 3)] and r["collapsed"] == "a b c"
