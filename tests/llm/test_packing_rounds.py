"""Packing rounds against a naive best fit, and the chunk tokenizer against the whole tokenizer."""

import math

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratavox.llm import packing
from stratavox.llm.tokens import chunk_tokenizer

PATH = public_tokenizers.path(packing.VOCABULARY)
WHOLE = Tokenizer.from_file(PATH)


def naive(lengths, capacity):
    """Sequences that best fit, longest document first, opens: one document and one look over all gaps at a time."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= x]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


@pytest.mark.parametrize("low, high", [(1, 100), (1, 40), (20, 45), (34, 60), (45, 55), (3, 3), (100, 100), (1, 2)])
def test_rounds_against_naive_best_fit(spark, low, high):
    lengths = np.random.default_rng([low, high]).integers(low, high + 1, 700)
    size, n = np.unique(lengths, return_counts=True)
    classes = spark.createDataFrame(list(zip(size.tolist(), n.tolist(), strict=True)), "length long, n long")
    plan = sorted(map(tuple, packing.rounds(classes, 100).collect()))
    held, at = {}, dict.fromkeys(size.tolist(), 0)
    for length, rank, k, first, offset in plan:
        assert rank == at[length]
        at[length] += k
        for s in range(first, first + k):
            held.setdefault(s, []).append((offset, length))
    assert at == dict(zip(size.tolist(), n.tolist(), strict=True))
    for parts in held.values():  # gapless, and within the capacity
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [x for _, x in parts])[:-1].tolist() and sum(x for _, x in parts) <= 100
    want = naive(lengths.tolist(), 100)
    assert math.ceil(lengths.sum() / 100) <= len(held) <= want * 1.01 + 1


def test_rounds_without_documents(spark):
    assert packing.rounds(spark.createDataFrame([], "length long, n long"), 100).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x17F), st.sampled_from(" .,'’s\n\t́̈İΣßﬁ東\x1c　")), max_size=40))
def test_any_text_has_the_tokenizers_ids(text):
    want = np.array(WHOLE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert chunk_tokenizer(PATH).encode([text]) == [want]


def test_every_latin_character_beside_letters_and_marks():
    tok = chunk_tokenizer(PATH)
    for c in map(chr, range(0x250)):
        for text in (c, c + "b", "b" + c, "b" + c + "b", "." + c + ".", "1" + c, "'" + c, c.upper() + "B"):
            assert tok.encode([text])[0] == np.array(WHOLE.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_memos_have_a_bound_in_bytes(monkeypatch):
    from stratavox.llm import tokens

    monkeypatch.setattr(tokens, "CHUNK_BYTES", 1 << 16)
    monkeypatch.setattr(tokens, "WORD_BYTES", 1 << 16)
    tok = tokens.ChunkTokenizer(PATH)
    for i in range(40):
        text = " ".join(f"w{i}x{j}" for j in range(200)) + " " + "長" * 5000 + str(i)
        assert tok.encode([text])[0] == np.array(WHOLE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert max(len(k) for k in tok.other) <= 200 and sum(map(len, tok.latin)) < 1 << 17
