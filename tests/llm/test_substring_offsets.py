"""Passages that begin and end inside sentences."""

import numpy as np
import pytest

from stratavox.llm import substring


@pytest.mark.parametrize("sentence", [10**9, 20])
def test_a_shared_passage_goes_at_any_offset(sentence):
    rng = np.random.default_rng(1)

    def some(n):
        return [f"w{k}" for k in rng.integers(0, 50_000, n)]

    def marked(words, at):
        return " ".join(w + "." * ((k + at) % sentence == 0 and k > 0) for k, w in enumerate(words))

    caught = []
    for _ in range(60):
        phase = int(rng.integers(20)) if sentence == 20 else -1
        passage = [w + "." * (k % sentence == phase) for k, w in enumerate(some(60))]
        rows = [(i, " ".join([marked(some(int(rng.integers(40, 80))), 3), *passage, marked(some(int(rng.integers(40, 80))), 5)])) for i in (1, 2)]
        out = substring.brute_force(rows)
        assert out[1] == rows[0][1]
        caught.append(len(rows[1][1].split()) - len(out[2].split()))
    assert np.mean(np.array(caught) > 0) > 0.9 and np.mean(caught) > 35 and max(caught) <= 60
