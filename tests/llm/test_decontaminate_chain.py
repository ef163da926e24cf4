"""Matches of operator 10 against a matcher of its own kind: plain loops over word lists, no code of the operator."""

import random
import re
import time

import pytest

from stratavox.llm import decontaminate as D
from stratavox.llm.templates import Lexer

TEMPLATE = ["tom", "buys", "#", "red", "apples", "and", "#", "pears", "then", "adds", "#", "more"]


def naive_windows(words):
    """Five words with numbers as one sign; texts of lower-case words and numbers only, so no names and no units."""
    typed = ["#" if re.fullmatch(r"\d+", w) else w for w in words]
    return [tuple(typed[i : i + 5]) for i in range(len(words) - 4)]


def slots_agree(item, doc, pairs):
    value = {}
    for j, p in pairs:
        if re.fullmatch(r"\d+", item[j]) and value.setdefault(item[j], doc[p]) != doc[p]:
            return None
    return "reparameterised" if any(a != b for a, b in value.items()) else "verbatim"


def naive_offset(doc, item, share=0.8):
    """The kind of the item if it stands on a single offset of the document: verbatim, reparameterised or None."""
    a, b, kinds = naive_windows(doc), naive_windows(item), set()
    own = [k for k, w in enumerate(b) if any(x != "#" for x in w)]
    for d in range(-len(b), len(a) + 1):
        hit = [k for k in range(len(b)) if 0 <= k + d < len(a) and a[k + d] == b[k]]
        if len(hit) >= share * len(b):
            kind = slots_agree(item, doc, sorted({(k + j, k + d + j) for k in hit for j in range(5)}))
            if kind == "verbatim" or kind and own and len(set(hit) & set(own)) >= share * len(own):
                kinds.add(kind)
    return "verbatim" if "verbatim" in kinds else kinds.pop() if kinds else None


def naive_chain(doc, item):
    """Length of the longest common subsequence of windows."""
    a, b = naive_windows(doc), naive_windows(item)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for k, y in enumerate(b):
            best[i + 1][k + 1] = best[i][k] + 1 if x == y else max(best[i][k + 1], best[i + 1][k])
    return best[-1][-1]


def found(doc, item):
    block, lex = D.make_block([(7, item)]), Lexer()
    return D.matches(doc, block, lex, D.CONTAINMENT)


NUMBERS = "Sort these: " + " ".join(str(7 * k * k + 3) for k in range(1, 31))
ADDS = "A machine adds " + " then adds ".join(f"{3 * k} and {5 * k + 1}" for k in range(1, 9)) + " and shows the total at last"


def test_a_few_numbers_are_no_item():
    text = "On the way home we saw 512 615 718 820 922 and then went to sleep early in the evening."
    assert found(text, NUMBERS) == []
    assert found("adds 21 and 34 then adds 55 and 89 then adds", ADDS) == []
    assert found(" ".join(str(k) for k in range(40)), NUMBERS) == []  # numbers without the question


@pytest.mark.parametrize("item", [NUMBERS, ADDS])
def test_copies_are_still_found(item):
    other = re.sub(r"\d+", lambda m: str(int(m[0]) + 1000), item)
    for copy, kind in ((item, "verbatim"), (other, "reparameterised")):
        got = found(f"some words before it . {copy} and some words after it", item)
        assert [(g[0], g[2]) for g in got] == [(7, kind)] and got[0][1] == 1.0
    words = item.split()
    edited = words[: len(words) // 2] + ["indeed"] + words[len(words) // 2 :]
    got = found("before " + " ".join(edited) + " after", item)
    assert len(got) == 1 and (item == NUMBERS or got[0][2] == "verbatim")  # in a row of numbers a shift looks like other numbers


def test_random_texts_against_plain_loops():
    rng = random.Random(5)
    seen = set()
    for _ in range(600):
        small = rng.random() < 0.5
        word = lambda: str(rng.randint(1, 3 if small else 90)) if rng.random() < 0.4 else rng.choice(TEMPLATE[:6] if small else TEMPLATE).replace("#", "9")  # noqa: B023, E731
        item = [word() for _ in range(rng.randint(5, 16))]
        doc = [word() for _ in range(rng.randint(0, 20))]
        if rng.random() < 0.7:
            copy = [str(int(w) + 100) if w.isdigit() and rng.random() < 0.5 else w for w in item]
            if rng.random() < 0.3:
                copy.insert(rng.randrange(len(copy)), word())
            doc += copy + [word() for _ in range(rng.randint(0, 20))]
        want = naive_offset(doc, item) if len(doc) >= 5 else None
        got = found(" ".join(doc), " ".join(item))
        seen.add(want)
        kinds = [g[2] for g in got]
        if want:
            assert kinds in ([want], ["verbatim"])
        if got and kinds != [want]:  # only a chain over several offsets can have given it
            assert naive_chain(doc, item) >= 0.8 * len(naive_windows(item))
    assert seen == {None, "verbatim", "reparameterised"}


def test_chain_length_against_plain_loops():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(1, 25))] for _ in range(2))
        held = {p: sum(1 << k for k, y in enumerate(b) if y == x) for p, x in enumerate(a) if x in b}
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for k, y in enumerate(b):
                best[i + 1][k + 1] = best[i][k] + 1 if x == y else max(best[i][k + 1], best[i + 1][k])
        got = D.longest_chain(held, sorted(held), len(b), 1)
        assert len(got) == best[-1][-1]
        assert all(a[p] == b[k] for p, k in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_pages_of_figures_take_no_time():
    rng = random.Random(7)
    item = "Order the list: " + " ".join(str(rng.randint(1, 10**6)) for _ in range(40))
    text = " ".join(str(rng.randint(1, 10**6)) for _ in range(2000))
    began = time.process_time()
    assert found(text, item) == []
    assert time.process_time() - began < 1
