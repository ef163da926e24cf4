"""Token streams with typed placeholders, shared by decontamination and license scans."""

from __future__ import annotations

import re
from array import array
from sys import getsizeof

import numpy as np
import xxhash

#: Words of a shingle.
SHINGLE = 5
#: Units of measure that become a placeholder (fixed values).
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb lbs oz t ml l gal s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years % percent usd eur gbp dollar dollars euro euros pound pounds cent cents mph kph km/h w kw v a hz khz mhz ghz kb mb gb tb byte bytes degree degrees".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th|[eE][+-]?\d+)?%?")
_EDGE = re.compile(r"^[^\w$€£%+-]+|[^\w%]+$")
PLAIN, NUMBER, UNIT = 0, 1, 2
_P = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


NAME_HASH = word_hash("\x00name")


class Lexer:
    """Numbers of the chunks of texts: their hash with placeholders, whether they can be a name, whether they end a sentence.

    What is known of a chunk has a place in two arrays, and the memo keeps the place: a stream is one pass over the
    memo and two gathers. When the memo has `size` bytes it starts afresh; long chunks aren't kept.
    """

    #: Bytes of an entry beside its chunk; longest chunk that is kept.
    ENTRY, LONGEST = 140, 200

    def __init__(self, typed: bool = True, size: int = 96 << 20):
        self.typed, self.size = typed, size
        self.place = _Places(self)
        self.hashes, self.flags, self.held = array("Q"), array("B"), 0

    def core(self, chunk: str) -> str:
        return _EDGE.sub("", chunk).lower()

    def look(self, chunk: str) -> tuple[int, int]:
        """(hash, flags): 1 may be a name, 2 ends a sentence, 4 has no word, 8 number, 16 unit."""
        bare = chunk[:-1] if chunk[-1] in ".,;:!?" else chunk
        if bare.isalpha():  # most chunks: letters, and perhaps a mark
            word = bare.lower()
            if self.typed and word in UNITS:
                return word_hash("\x00unit"), 2 * (chunk[-1] in ".!?") | 16
            return word_hash(word), 2 * (chunk[-1] in ".!?") | (bare[:1].isupper() and bare[1:].islower())
        word = self.core(chunk)
        flags = 2 * (chunk[-1] in ".!?")
        if not word.isalnum() and not any(c.isalnum() or c == "%" for c in word):
            return 0, flags | 4
        if self.typed and _NUMBER.fullmatch(word):
            return word_hash("\x00number"), flags | 8
        if self.typed and word in UNITS:
            return word_hash("\x00unit"), flags | 16
        bare = chunk.strip(".,;:!?\"'()[]")
        return word_hash(word), flags | (bare[:1].isupper() and bare[1:].islower())

    def stream(self, chunks: list[str], starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes without and with names as placeholders, the chunk of each token, and its flags: 32 a name, 64 opens a
        sentence and may be one. `starts`: the first chunks of further texts, where sentences open too."""
        if not chunks:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.held > self.size:
            self.place.clear()
            self.hashes, self.flags, self.held = array("Q"), array("B"), 0
        at = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))
        h, f = np.frombuffer(self.hashes, np.uint64)[at], np.frombuffer(self.flags, np.uint8)[at].astype(np.int64)
        opens = np.ones(len(at), bool)
        opens[1:] = (f[:-1] & 2) > 0
        if starts is not None:
            opens[starts[starts < len(at)]] = True
        capital = (f & 1) > 0
        name = capital & ~opens
        keep = np.flatnonzero((f & 4) == 0)
        typed = np.where(name, np.uint64(NAME_HASH), h)
        return h[keep], typed[keep], keep, (f | 32 * name | 64 * (capital & opens))[keep]


class _Places(dict):
    """Chunk to place in a lexer's arrays."""

    def __init__(self, lexer: Lexer):
        super().__init__()
        self.lexer = lexer

    def __missing__(self, chunk: str) -> int:
        x, k = self.lexer, len(self.lexer.hashes)
        h, f = x.look(chunk)
        x.hashes.append(h)
        x.flags.append(f)
        x.held += 9
        if len(chunk) <= x.LONGEST:
            x.held += getsizeof(chunk) + x.ENTRY
            self[chunk] = k
        return k


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of every n consecutive tokens."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + m]) * _P
        out ^= out >> np.uint64(29)
    return out


def opened(typed: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The typed stream with capitalised words that open sentences as names too."""
    return np.where(flags & 64 > 0, np.uint64(NAME_HASH), typed)


class HashSet:
    """Sorted hashes behind a bit table that turns most probes away."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.sorted = np.unique(hashes)
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.sorted >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are members, and their ranks in `sorted`."""
        if not len(self.sorted) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        rank = np.searchsorted(self.sorted, h[at])
        rank[rank == len(self.sorted)] = 0
        hit = self.sorted[rank] == h[at]
        return at[hit], rank[hit]
