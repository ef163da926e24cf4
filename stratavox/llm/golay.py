"""The perfect binary Golay code [23, 12, 7] as a fuzzy hash of 23-bit segments.

Every 23-bit word lies within distance 3 of exactly one codeword. If two words differ in at most one
bit, the codeword nearest to the first lies within distance 4 of the second; if they differ in at most
two bits, the sets of codewords within distance 4 of each share a member. A word at distance 3 from
its codeword has five more codewords at distance 4, any other word none, so a word has 1 or 6 keys.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0b110001110101
BITS = 23


def _syndrome(word: int) -> int:
    for shift in range(BITS - 12, -1, -1):
        if word >> (shift + 11) & 1:
            word ^= GENERATOR << shift
    return word


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and up to six error patterns of each syndrome (-1: none)."""
    one = [_syndrome(1 << i) for i in range(BITS)]
    low, high = (np.zeros(1 << n, np.int64) for n in (12, 11))
    for i in range(12):
        low[np.arange(1 << 12) >> i & 1 == 1] ^= one[i]
    for i in range(11):
        high[np.arange(1 << 11) >> i & 1 == 1] ^= one[12 + i]
    errors = np.full((1 << 11, 6), -1, np.int64)
    for weight in (0, 1, 2, 3):
        for at in combinations(range(BITS), weight):
            s = 0
            for i in at:
                s ^= one[i]
            errors[s, 0] = sum(1 << i for i in at)
    filled = np.ones(1 << 11, np.int64)
    for at in combinations(range(BITS), 4):
        s = one[at[0]] ^ one[at[1]] ^ one[at[2]] ^ one[at[3]]
        if bin(errors[s, 0]).count("1") == 3:
            errors[s, filled[s]] = sum(1 << i for i in at)
            filled[s] += 1
    return low, high, errors


def codewords(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices, the message bits, of the codewords near each word: the nearest first, -1 where there are fewer."""
    low, high, errors = tables()
    w = words.astype(np.int64)
    e = errors[low[w & 0xFFF] ^ high[w >> 12]]
    return np.where(e >= 0, (w[:, None] ^ e) >> 11, -1)
