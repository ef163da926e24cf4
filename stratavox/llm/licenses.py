"""License scans: MinHash bands over text windows retrieve templates, exact containment verifies (operator 6)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratavox.llm.blocks import map_batches, pick, strings
from stratavox.llm.license_texts import TEMPLATES
from stratavox.llm.templates import SHINGLE, HashSet, Lexer, shingles

CONTAINMENT = 0.8
#: Bands of one MinHash value each. A template of n shingles lies in a window of at most 3n of them (window
#: sizes are powers of two, windows overlap by half), so a copy that keeps 0.8 of it has a Jaccard similarity
#: of 0.8 / 3.2 = 0.25 at the least and is missed by all bands with a chance of at most (1 - 0.25)^96 < 1e-12.
BANDS = 96
SEED = 7
#: Template characters in memory on each executor; a larger collection has to be scanned in parts.
MOST_CHARS = 32 << 20


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def minhash(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value of each band's hash function over a set of shingles."""
    x = h[:, None] * a[None, :] + b[None, :]
    return (x ^ x >> np.uint64(31)).min(axis=0)


@dataclass
class Library:
    """Templates by the half-window that suits their length, with their shingles and band keys."""

    names: list[str] = field(default_factory=list)
    shingle_sets: list[np.ndarray] = field(default_factory=list)
    #: half window -> {(band, value): templates}
    bands: dict[int, dict[tuple[int, int], list[int]]] = field(default_factory=dict)
    table: HashSet | None = None
    #: for each rank in the table, the half windows of templates with this shingle
    halves: list[set[int]] = field(default_factory=list)
    coefficients: tuple[np.ndarray, np.ndarray] = field(default_factory=_coefficients)

    @staticmethod
    def build(templates: Mapping[str, str]) -> Library:
        if sum(map(len, templates.values())) > MOST_CHARS:
            raise ValueError(f"templates of more than {MOST_CHARS} characters: scan with parts of the collection and unite the results")
        lib, lex = Library(), Lexer(typed=False)
        for name, text in templates.items():
            h, _, _, _ = lex.stream(text.split())
            s = np.unique(shingles(h))
            if not len(s):
                raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
            half = 1 << (len(s) - 1).bit_length()
            t = len(lib.names)
            lib.names.append(name)
            lib.shingle_sets.append(s)
            found = lib.bands.setdefault(half, defaultdict(list))
            for band, value in enumerate(minhash(s, *lib.coefficients).tolist()):
                found[band, value].append(t)
        lib.table = HashSet(np.concatenate(lib.shingle_sets) if lib.names else np.zeros(0, np.uint64))
        lib.halves = [set() for _ in lib.table.sorted]
        for half, found in lib.bands.items():
            for t in {t for ts in found.values() for t in ts}:
                for r in np.searchsorted(lib.table.sorted, lib.shingle_sets[t]).tolist():
                    lib.halves[r].add(half)
        return lib


def scan(text: str, lib: Library, lex: Lexer, containment: float = CONTAINMENT) -> list[tuple[str, float, int, int]]:
    """(template, containment, first chunk, end chunk) of the templates that a whole text holds.

    Windows of 2 x half shingles start every half. A window without any template shingle can't share a
    MinHash value with a template, so only windows with one are hashed; that loses nothing.
    """
    h, _, keep, _ = lex.stream(text.split())
    s = shingles(h)
    at, rank = lib.table.find(s)
    if not len(at):
        return []
    windows: dict[int, set[int]] = defaultdict(set)
    for p, r in zip(at.tolist(), rank.tolist(), strict=True):
        for half in lib.halves[r]:
            k = p // half
            windows[half].update((k, k - 1) if k else (k,))
    places: dict[tuple[int, int, int], tuple[int, float]] = {}
    for half, starts in windows.items():
        found = lib.bands[half]
        for k in sorted(starts):
            part = s[k * half : (k + 2) * half]
            candidates: set[int] = set()
            for band, value in enumerate(minhash(np.unique(part), *lib.coefficients).tolist()):
                candidates.update(found.get((band, value), ()))
            for t in candidates:
                mine = lib.shingle_sets[t]
                hit = np.flatnonzero(np.isin(part, mine))
                for n, first, last in _places(hit, part[hit], len(mine), containment):
                    places[t, k * half + first, k * half + last] = n, n / len(mine)
    # of templates on the same shingles the one with the most stays: versions of one notice differ by a word
    kept: list[tuple[int, float, int, int]] = []
    taken = np.zeros(len(s), bool)
    for (t, first, last), (_, share) in sorted(places.items(), key=lambda x: (-x[1][0], -x[1][1], x[0])):
        own = first + np.flatnonzero(np.isin(s[first : last + 1], lib.shingle_sets[t]))
        if 2 * taken[own].sum() <= len(own):
            taken[own] = True
            kept.append((t, share, int(keep[first]), int(keep[last + SHINGLE - 1]) + 1))
    return [(lib.names[t], *place) for t, *place in sorted(kept, key=lambda x: (x[0], x[2]))]


def _places(at: np.ndarray, h: np.ndarray, size: int, containment: float) -> list[tuple[int, int, int]]:
    """(distinct shingles, first, last position) of the places that hold a template of `size` shingles, from its hits (position,
    hash) in a window: the fullest of 1.25 times its length, or failing that the tightest one that holds it; then again
    beside it."""
    need = containment * size
    if len(np.unique(h)) < need:
        return []
    pos, ids = at.tolist(), np.unique(h, return_inverse=True)[1].tolist()
    best = _fullest(pos, ids, size + size // 4 + 1) or (0, 0, 0)
    if best[0] < need:
        best = _tightest(pos, ids, need)
    n, a, b = best
    out = [(n, pos[a], pos[b])]
    for x, y in ((0, a), (b + 1, len(pos))):
        out += _places(at[x:y], h[x:y], size, containment)
    return out


def _fullest(pos: list[int], ids: list[int], width: int) -> tuple[int, int, int]:
    """Most distinct ids of hits within `width` positions, of the tightest window; its count, first and last hit."""
    inside, left, best = Counter(), 0, (0, 0, 0)
    for right, i in enumerate(ids):
        inside[i] += 1
        while pos[right] - pos[left] >= width or inside[ids[left]] > 1:
            inside[ids[left]] -= 1
            if not inside[ids[left]]:
                del inside[ids[left]]
            left += 1
        now = (len(inside), left, right)
        if now[0] > best[0] or now[0] == best[0] and pos[right] - pos[left] < pos[best[2]] - pos[best[1]]:
            best = now
    return best


def _tightest(pos: list[int], ids: list[int], need: float) -> tuple[int, int, int]:
    """The shortest window with `need` distinct ids; its count, first and last hit."""
    inside, left, best = Counter(), 0, None
    for right, i in enumerate(ids):
        inside[i] += 1
        while len(inside) >= need:
            if best is None or pos[right] - pos[left] < pos[best[2]] - pos[best[1]]:
                best = (len(inside), left, right)
            inside[ids[left]] -= 1
            if not inside[ids[left]]:
                del inside[ids[left]]
            left += 1
    return best


def find_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_word, end_word): the license templates that each document holds,
    of those that mostly match the same shingles of the text the one with the most.

    Shingles of five words in lower case without marks; a template is held if a window has at least
    `containment` of its distinct shingles. Every place that isn't mostly taken by a fuller one is given, a row each, as
    numbers of white-space separated words. Null, empty and short texts hold nothing; repeated rows give
    repeated results; a null id is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Library.build(templates))  # at most MOST_CHARS of templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, lex = shared.value, Lexer(typed=False)
        for b in batches:
            rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True) for m in scan(t, lib, lex, containment)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "license", "containment", "first_word", "end_word"])

    return map_batches(pick(docs, doc_id=id_col, text=text_col), run, "doc_id long, license string, containment double, first_word int, end_word int")


def brute_force(text: str, templates: Mapping[str, str], containment: float = CONTAINMENT) -> set[str]:
    """Templates held anywhere, by testing every window of three times their length; for tests."""
    lex = Lexer(typed=False)
    words = [lex.core(c) for c in text.split()]
    words = [w for w in words if any(c.isalnum() for c in w)]
    grams = [tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
    out = set()
    for name, t in templates.items():
        own = [w for w in (lex.core(c) for c in t.split()) if any(c.isalnum() for c in w)]
        want = {tuple(own[i : i + SHINGLE]) for i in range(len(own) - SHINGLE + 1)}
        for i in range(max(1, len(grams))):
            if len(want & set(grams[i : i + len(want) + len(want) // 4])) >= containment * len(want):
                out.add(name)
                break
    return out
