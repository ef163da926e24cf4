"""Texts of one word fingerprint that are not similar to the one with the smallest id."""

import numpy as np
import pytest

from stratavox.llm import copies
from test_operators import words


@pytest.mark.parametrize("dense", [8, 0])
def test_all_texts_of_one_fingerprint_take_part(spark, monkeypatch, dense):
    monkeypatch.setattr(copies, "DENSE", dense)
    rng = np.random.default_rng(7)
    b = [f"{w}{k}" for k, w in enumerate(words(rng, 120))]
    a, c = list(b), [*b, *b[:8]]
    rng.shuffle(a)
    d = list(b)
    d[60] = "other"
    texts = [(1, a), (2, b), (3, c), (4, d)]
    assert len({copies.word_fingerprint(" ".join(t).encode()) for _, t in texts[:3]}) == 1
    found = {r["doc_id"]: r["component_id"] for r in copies.groups(spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 2, 3: 2, 4: 2}
