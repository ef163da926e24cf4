"""The pipeline against a brute-force version, and its stages on unusual rows."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from stratavox.llm import copies, langid, simhash, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def group_by_force(rows):
    """Smallest id of each group, by comparing all pairs on fingerprints and on shingles."""
    root = simhash.brute_force(rows)
    sets = {i: copies.shingle_hashes((t or "").encode()) for i, t in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if 0.8 * max(len(a), len(b)) <= min(len(a), len(b)) and copies.similarity(a, b) >= 0.8:
            x, y = sorted((top(i), top(j)))
            root[y] = x
    return {i: top(i) for i in root}


def test_run_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = langid.train(docs)
    rows = [(i, t) for (i, t), gone in zip(rows, model.judge([t for _, t in rows])[3], strict=True) if not gone]
    root = group_by_force(rows)
    rows = [(i, t) for i, t in rows if root[i] == i]
    clean = substring.brute_force(rows)
    rows = [(i, clean[i]) for i, _ in rows]
    items = [shingle_set(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(len(s & shingle_set(t)) >= 0.8 * len(s) for s in items if s)]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in rows)
    got = corpus_pipeline.run(spark, small).collect()
    length = Counter()
    for r in got:
        length[r["doc_id"]] += r["length"]
    assert Counter(length.items()) == want
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= np.ceil(sum(fill.values()) / 4096) + 1


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    item = "The benchmark question asks how many apples Anna has after giving 3 of 12 apples to Ben and buying 7 more."
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    long = " ".join(f"word{i} and other words." for i in range(3000))
    text = "Some ordinary sentences are here. They have words that models learn. Nothing in them repeats elsewhere."
    rows = [(1, text, "en", "s", 5), (2, text + " Truly.", "en", None, None), (3, None, "en", "s", None), (4, "", None, "s", 0), (5, "1234 ??", "en", "s", 7), (6, long, "en", "s", None)]
    rows += [(7, f"Before it stands this. {item} After it stands that.", "en", "s", 1), (None, "A row without an id has other words than the rest of them.", "en", "s", 1), (1, text, "en", "s", 5)]
    return spark.createDataFrame(rows, SCHEMA), folder


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows_and_on_none(spark, odd, name, stage):
    docs, folder = odd
    out = stage(spark, docs, folder)
    assert out.count() > 0
    if name != "packing":
        assert out.schema.simpleString() == docs.schema.simpleString()
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_each_stage_does_its_work(spark, odd):
    docs, folder = odd
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    assert ids(stages["language_id"](spark, docs, folder)) == [1, 1, 2, 6, 7, None]
    assert ids(stages["simhash_dedup"](spark, docs, folder)).count(1) == 1
    assert ids(stages["decontamination"](spark, docs, folder)) == [1, 1, 2, 3, 4, 5, 6, None]
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["substring_dedup"](spark, docs, folder).collect()}
    assert cut[2] == (" Truly.".strip(), 6) and cut[1][1] == 5 and cut[3] == (None, None)
    assert stages["packing"](spark, docs, folder).select("doc_id").distinct().count() == 8
