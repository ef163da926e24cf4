"""Byte-level BPE encoding and decoding of whole texts by a trie of their distinct words (operator 12)."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stratavox.llm.blocks import WordMemo, map_batches, pick, strings, worker_cache
from stratavox.llm.tokens import _byte_letters

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of one generation of the memo of words, verdicts on pairs of tokens and moves that are kept, texts that share a trie.
WORD_BYTES, PAIRS, TEXTS = 56 << 20, 300_000, 500
#: How the vocabulary's splitter cuts a text (fixed value).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters from here on may be letters in one table of Unicode and unknown in another.
_SETTLED = 0x370
_BEYOND = regex.compile(f"[^\\x00-{chr(_SETTLED - 1)}]")


class Merges:
    """Tokens by number, and whether two tokens stay apart when their bytes stand side by side."""

    def __init__(self, spec: dict):
        model, byte_of = spec["model"], {c: b for b, c in _byte_letters().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: bytes(map(byte_of.__getitem__, t)) for t, i in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = (model["vocab"][a], model["vocab"][b])
            self.rank[pair] = r
            halves[model["vocab"][a + b]] = pair
        self.halves = halves
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        tokens = {raw: i for i, raw in self.bytes.items()}
        self.packed = {i: np.array([i], "<u4").tobytes() for i in self.bytes}
        #: Beginnings of tokens by number; 0 is the empty one.
        self.beginnings: dict[bytes, int] = {b"": 0}
        for raw in tokens:
            for k in range(1, len(raw) + 1):
                self.beginnings.setdefault(raw[:k], len(self.beginnings))
        #: (token, length) of the tokens that end a beginning, longest first.
        self.ends = [tuple((tokens[raw[k:]], len(raw) - k) for k in range(len(raw)) if raw[k:] in tokens) for raw in self.beginnings]
        self.spelled = list(self.beginnings)
        self.moves: dict[int, int] = {}
        self.apart: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces at the right (1) or left (0) edge of a token while it is merged, each with the rank at which it goes into
        a larger piece."""
        known = self.right if side else self.left
        if token not in known:
            out, piece, dies = [], token, float("inf")
            while True:
                out.append((piece, dies))
                if piece not in self.halves:
                    break
                pair = self.halves[piece]
                dies, piece = self.rank[pair], pair[side]
            known[token] = out
        return known[token]

    def move(self, state: int, byte: int) -> int:
        """The longest beginning of a token that ends a text, from the one before its last byte: what can end there is a suffix
        of it."""
        raw = self.spelled[state] + bytes([byte])
        while raw not in self.beginnings:
            raw = raw[1:]
        if len(self.moves) >= PAIRS:
            self.moves.clear()
        found = self.moves[state << 8 | byte] = self.beginnings[raw]
        return found

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the text of a and b is encoded as these two. They join if a merge over their border comes up while both its
        pieces are there; of equal merges the left one goes first."""
        key = a << 32 | b
        found = self.apart.get(key)
        if found is None:
            found = not any((r := self.rank.get((x, y))) is not None and r < gone_x and r <= gone_y for x, gone_x in self.edge(a, 1) for y, gone_y in self.edge(b, 0))
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            self.apart[key] = found
        return found


def encode_words(words: Iterable[bytes], merges: Merges) -> dict[bytes, bytes]:
    """ids of distinct words, as little-endian unsigned 32-bit numbers.

    The words go into a trie, kept as sorted words and the length of the prefix that each shares with the one before: in this order
    they are the depth-first walk, and what lies below a shared prefix is all that is new. The walk carries down, for each
    prefix on its path, the last token of the encoding of that prefix. What stands before that token is the encoding of a
    shorter prefix on the path; so the token of a new prefix is the one that ends it and stays apart from the last token of
    the prefix before it. Encodings of shared prefixes are worked out once.
    """
    moves, ends, bytes_of, packed, apart = merges.moves, merges.ends, merges.bytes, merges.packed, merges.apart
    out: dict[bytes, bytes] = {}
    last: list[int] = []
    states: list[int] = []
    before = b""
    for w in sorted(words):
        shared, most = 0, min(len(w), len(before))
        while shared < most and w[shared] == before[shared]:
            shared += 1
        del last[shared:], states[shared:]
        state = states[-1] if shared else 0
        for end in range(shared, len(w)):
            move = state << 8 | w[end]
            state = moves[move] if move in moves else merges.move(state, w[end])
            for token, size in ends[state]:  # noqa: B007
                if size > end:
                    break
                pair = last[end - size] << 32 | token
                if apart[pair] if pair in apart else merges.stay_apart(last[end - size], token):
                    break
            last.append(token)
            states.append(state)
        ids, k = [], len(w)
        while k:
            ids.append(packed[last[k - 1]])
            k -= len(bytes_of[last[k - 1]])
        ids.reverse()
        out[w] = b"".join(ids)
        before = w
    return out


class ByteCodec:
    """Encoder of a byte-level vocabulary file, kept in a worker with the words that it knows."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only byte-level vocabularies without a normaliser, prefix blank and stripping special tokens")
        self.path = path
        self.merges = Merges(spec)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words = WordMemo(self._alone, WORD_BYTES)
        self.alike, self.odd = set(map(chr, range(_SETTLED))), set()

    def _alone(self, word: str) -> bytes:
        raw = word.encode()
        return encode_words([raw], self.merges)[raw]

    @cached_property
    def splitter(self):
        """The library's own splitter, loaded when a text needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str

    def _odd(self, text: str) -> bool:
        """Whether a character counts otherwise here than in the library, whose tables of letters may be of another age: each
        character is tried once beside a letter, a digit and a mark."""
        fresh = set(text) - self.alike
        for c in fresh - self.odd:
            probe = f"a{c}1{c}!{c} {c}\n"
            same = [m.span() for m in _PIECES.finditer(probe)] == [s for _, s in self.splitter(probe)]
            (self.alike if same else self.odd).add(c)
        return bool(fresh & self.odd)

    def pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if not text.isascii() and _BEYOND.search(text) and self._odd(text):
            return [text[a:z] for _, (a, z) in self.splitter(text)]
        return _PIECES.findall(text)

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if self.special is None or not self.special.search(text):
            return self.pieces(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self.pieces(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of whole texts; words that aren't known yet go into one trie."""
        split = [self.split(t) for t in texts]
        memo = self.words
        ids = {t: np.array([i], "<u4").tobytes() for t, i in self.merges.special.items()}
        fresh = []
        for w in set().union(*split).difference(ids):
            if w in memo:
                ids[w] = memo[w]
            elif w in memo.old:
                ids[w] = memo[w]
            else:
                fresh.append(w)
        made = {w.decode(): x for w, x in encode_words(map(str.encode, fresh), self.merges).items()}
        for w, x in made.items():
            memo.keep(w, x)
        ids |= made
        return [b"".join(map(ids.__getitem__, words)) for words in split]


class Spelling:
    """Decoder of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in _byte_letters().items()}
        self.bytes = {i: bytes(map(byte_of.__getitem__, t)) for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}

    def decode(self, ids: bytes) -> str:
        """Text of ids; ids that the vocabulary lacks are passed over, and bytes that are no text become U+FFFD."""
        spell = self.bytes
        try:
            raw = b"".join([spell[i] for i in memoryview(ids).cast("I")])
        except KeyError:
            raw = b"".join([spell.get(i, b"") for i in memoryview(ids).cast("I")])
        return raw.decode("utf-8", "replace")


def byte_codec(path: str) -> ByteCodec:
    return worker_cache(path, lambda: ByteCodec(path))


def spelling(path: str) -> Spelling:
    return worker_cache(f"{path} spelled", lambda: Spelling(path))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, packed: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): token ids of whole texts, as the vocabulary's own library gives them without added tokens.

    `ids` is an array of integers, or with `packed` their bytes as little-endian unsigned 32-bit numbers. Strings of special tokens
    in a text become these tokens, as in the library. Distinct words go into a trie, and a depth-first walk carries the last
    token of each prefix down to its continuations.

    A null text counts as empty and has no ids; repeated rows and null ids are kept; other columns don't matter; no rows: no rows.
    A text is encoded at once, whatever its length, and so is a word.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(path)
        for b in batches:
            raw = codec.encode(strings(b.column(1)))
            size = np.array([len(r) // 4 for r in raw], np.int64)
            if packed:
                ids = pa.array(raw, pa.binary())
            else:
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), ids], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(pick(docs, doc_id=id_col, text=text_col), run, f"doc_id {kind}, n_tokens bigint, ids {'binary' if packed else 'array<int>'}", keeps=path, rows=TEXTS)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the text of ids, arrays or packed, special tokens included.

    Null ids give a null text, no ids an empty one; ids that the vocabulary lacks and null elements are passed over; bytes that
    are no UTF-8 become U+FFFD; repeated rows and null row ids are kept, other columns don't matter; no rows: no rows.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind, held = encoded.schema[id_col].dataType.simpleString(), encoded.schema[ids_col].dataType.simpleString()

    def packed(value: bytes | list) -> bytes:
        return value if isinstance(value, bytes) else np.array([x for x in value if x is not None and x >= 0], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = spelling(path)
        for b in batches:
            texts = [None if v is None else codec.decode(packed(v)) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return map_batches(pick(encoded, doc_id=id_col, ids=ids_col), run, f"doc_id {kind}, ids {held}, text string", keeps=f"{path} spelled", rows=TEXTS)
