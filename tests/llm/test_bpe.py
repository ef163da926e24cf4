import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratavox.llm import bpe, queries

PATH = public_tokenizers.path(bpe.VOCABULARY)
ODD = ["", " ", "  \n\n a", "don't we'll I'M", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "͸ ՘x", "\U00010940a\U0001e030 1₀౜b", "tab\tand\r\nline  ", "é é 中文 \U0001f600‍\U0001f469", "\x1c\x1d a\x85b c　", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "-" * 500 + "=" * 300, "\x00\x01\x7f", "1234567890" * 40]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.ByteCodec(PATH)


@pytest.fixture(scope="module")
def spell():
    return bpe.Spelling(PATH)


def held_alike(codec, library, texts):
    spell = bpe.Spelling(PATH)
    for t, raw in zip(texts, codec.encode(texts), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids, t
        assert spell.decode(raw) == library.decode(ids, skip_special_tokens=False)


def test_odd_texts(codec, library):
    held_alike(codec, library, ODD)


def test_random_texts(codec, library):
    rng = random.Random(1)
    kinds = ["ab", "abcdefghijklmnopqrstuvwxyz '", "aeiou  \n\t.,!?'0123456789", "".join(map(chr, range(32, 0x250))), "一丁абกั\U0001f600 a1"]
    texts = ["".join(rng.choice(rng.choice(kinds) if rng.random() < 0.05 else k) for _ in range(rng.randint(1, 60))) for k in kinds for _ in range(400)]
    texts += ["".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(20)) if not 0xD800 <= c < 0xE000) for _ in range(400)]
    held_alike(codec, library, texts)


def test_tokens_side_by_side(codec, library):
    """Two tokens stay apart just if the library keeps them apart."""
    rng = random.Random(2)
    m = codec.merges
    tokens = [t for t, raw in m.bytes.items() if raw.isalpha()]
    spell = {i: t for t, i in library.get_vocab().items()}
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        whole = [t.id for t in library.model.tokenize(spell[a] + spell[b])]
        assert m.stay_apart(a, b) == (whole == [a, b])


def test_settled_letters_and_long_words(codec, library):
    settled = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}\n" for c in range(bpe._SETTLED))
    assert [m.span() for m in bpe._PIECES.finditer(settled)] == [s for _, s in library.pre_tokenizer.pre_tokenize_str(settled)]
    held_alike(bpe.ByteCodec(PATH), library, [settled, "the them themes theme thematic then", "x" * 1000, "ab" * 3000, "-=" * 700 + "-" * 900])


def test_a_small_memo(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORD_BYTES", 500)
    monkeypatch.setattr(bpe, "PAIRS", 2)
    small = bpe.ByteCodec(PATH)
    for t in ["the cat sat on the mat", "then the cats sit on other mats", *ODD]:
        held_alike(small, library, [t, t + " and more of the same"])


def test_decoding_any_ids(spell, library):
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))] + [50256] * rng.randint(0, 1)
        assert spell.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
    assert spell.decode(np.array([60000, 64], "<u4").tobytes()) == library.decode([60000, 64], skip_special_tokens=False)


def test_tables(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(0, "again"), (0, "again"), (None, "no id"), (7, None)], "doc_id long, text string").selectExpr("doc_id", "text", "3 AS ids", "4 AS n_tokens")
    for packed in (False, True):
        made = bpe.encode(docs, packed=packed)
        rows = {(r["doc_id"], r["text"]) for r in bpe.decode(made).collect()}
        assert rows == {(i, t) for i, t in enumerate(ODD)} | {(0, "again"), (None, "no id"), (7, "")}
        assert made.count() == docs.count()
    got = bpe.encode(docs).where("doc_id = 4").first()
    assert got["ids"] == [50256] and got["n_tokens"] == 1
    loose = spark.createDataFrame([(1, [64, None, -5, 99999]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(loose).collect()} == {1: "a", 2: None, 3: ""}
    assert bpe.encode(docs.limit(0)).count() == bpe.decode(bpe.encode(docs.limit(0))).count() == 0


def test_given_documents(spark, small, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op12_bpe(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
