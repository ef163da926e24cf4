"""Tokenisation of whole texts with a public vocabulary, through a memo of white-space separated chunks."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from stratavox.llm.blocks import WordMemo, worker_cache

#: Bytes of the memos of chunks and of words.
CHUNK_BYTES, WORD_BYTES = 72 << 20, 40 << 20
#: Latin-1 letters in lower case, and marks that stand beside words. An apostrophe is none: it may begin a token of its own.
_LETTERS = b"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_PLAIN = re.compile(rb"([" + _LETTERS + rb"]*)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest
    for the characters from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


def _folded() -> bytes:
    """Latin-1 bytes in lower case, white space as blanks."""
    space = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}
    return bytes(32 if b in space else ord(chr(b).lower()) for b in range(256))


class ChunkTokenizer:
    """ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary's rules never look across white space (its normaliser composes and lowers
    single characters, its splitter drops white space), so the ids of a text are those of its chunks
    in order. Texts of Latin-1 characters, which the normaliser leaves composed, are lowered and split as bytes. A run of
    letters never joins the marks after it, so a chunk of letters and marks takes the ids of the word, straight from the
    merges, and those of the marks. All other chunks go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.merge = self.tok.model.tokenize
        #: Strings of special tokens in any case: folded, other strings would look like them.
        names = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, names)) or "(?!)", re.IGNORECASE)
        same = os.path.commonprefix(names)
        #: What they all begin with, up to the first letter: most texts lack it.
        self.mark = same[: next((k for k, c in enumerate(same) if c.isalpha()), len(same))]
        self.letters, self.fold = _byte_letters(), _folded()
        self.words = WordMemo(self._word, WORD_BYTES)
        self.marks = WordMemo(self._marks, 1 << 20)
        self.latin = WordMemo(self._latin, CHUNK_BYTES)
        self.other = WordMemo(self._whole, CHUNK_BYTES // 4)

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes() if chunk else b""

    def _word(self, word: bytes) -> bytes:
        plain = word.decode("ascii") if word.isascii() else word.decode("latin-1").encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(plain)]).tobytes()

    def _marks(self, marks: bytes) -> bytes:
        return self._whole(marks.decode("ascii"))

    def _latin(self, chunk: bytes) -> bytes:
        found = _PLAIN.fullmatch(chunk)
        if not found:
            return self._whole(chunk.decode("latin-1"))
        word, marks = found.groups()
        return (self.words[word] if word else b"") + (self.marks[marks] if marks else b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        out, latin, other = [], self.latin.__getitem__, self.other.__getitem__
        for t in texts:
            if self.mark in t and self.special.search(t):
                out.append(b"".join(map(other, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))))
                continue
            try:
                chunks = t.encode("latin-1").translate(self.fold).split()
            except UnicodeEncodeError:
                out.append(b"".join(map(other, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))))
            else:
                out.append(b"".join(map(latin, chunks)))
        return out


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """The tokenizer of a vocabulary file, kept in the worker with what it has learned."""
    return worker_cache(path, lambda: ChunkTokenizer(path))
