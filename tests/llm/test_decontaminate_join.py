"""The window join against looking every item up in every text."""

import numpy as np
import pytest
from test_decontaminate_places import held

from stratavox.llm import decontaminate
from stratavox.llm.templates import Lexer

REPEATING = "Add 1 and 2 then add 3 and 1 then add 2 and 3 then add 1 and 3 then add 2 and 1 then stop here now please"


def problem(rng):
    name, other = rng.choice(["Anna", "Ben", "Carl", "Dora"], 2)
    a, b, c = rng.integers(2, 90, 3)
    return str(rng.choice([
        f"{name} has {a} apples. {other} has {b} apples. {name} gives {c} to {other}. How many apples does {name} have now?",
        f"A car drives {a} km in {b} hours and then {c} km in {b} hours on the same road so how fast is it",
        f"If {name} buys {a} pens at {b} euros each and sells {c} of them to {other}, how many euros are left in the end?",
    ]))


def test_items_with_repeated_windows_hold_themselves():
    assert held(REPEATING, REPEATING) == held(REPEATING, f"Before it. {REPEATING} After it.") == ["verbatim"]


@pytest.mark.parametrize("bits", [decontaminate.MOST_FILTER_BITS, 1 << 15])  # a filter of any fill
def test_join_against_all_pairs(spark, bits, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_FILTER_BITS", bits)
    monkeypatch.setattr(decontaminate, "ITEMS_TOGETHER", 3)
    rng = np.random.default_rng(12)
    items = [(i, problem(rng)) for i in range(25)] + [(30, REPEATING), (31, "Ten words are in this item, more or less so."), (32, "one two"), (33, "Ünïcode ÉTÉ 東京 " * 4), (34, "x " * 30)]
    items += [(40 + i, items[0][1]) for i in range(3)]  # an item many times
    rows = [(i, " ".join(rng.choice([problem(rng), items[int(rng.integers(25))][1], "Some filler words stand here and there."], rng.integers(1, 6)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "one two"), (103, "ONE two!"), (104, "y " * 4000 + REPEATING), (105, "x " * 5000), (106, "x x x x"), (107, items[33 - 5][1])]
    rows += [rows[0]] * 2 + [(0, items[1][1])]  # repeated rows, and another text of the same id
    docs = spark.createDataFrame([(i, t, 7, "r", "h") for i, t in rows], "doc_id long, text string, key long, row string, hits string")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc string")
    got = sorted(map(tuple, decontaminate.find(docs, bench).collect()))
    want = sorted(decontaminate.brute_force(rows, items))
    assert got == want and len(want) > 50
    bad = {(r[0]) for r in want}
    kept = decontaminate.drop_contaminated(docs, bench)
    clean = [t for t in rows if not decontaminate.matches(t[1] or "", decontaminate.make_block(items), Lexer(), 0.8)]
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted((i, t or "") for i, t in clean) and 104 in bad


def test_every_passage_of_an_item_is_found_by_plain_words(spark):
    """Independent of the lexer: texts of which 0.8 of the plain five-word shingles stand unchanged in a row."""
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, 40))) for i in range(30)]
    rows, want = [], set()
    for d in range(60):
        i, t = items[int(rng.integers(30))]
        w = t.split()
        cut = int(rng.integers(0, 20))
        rows.append((d, " ".join([*rng.choice(vocabulary, 30), *w[: len(w) - cut], *rng.choice(vocabulary, 30)])))
        if len(w) - cut - 4 >= 0.8 * (len(w) - 4):
            want.add((d, i))
    found = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and len(want) > 10
