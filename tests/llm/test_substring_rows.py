"""Rows that share an id, extra columns of clashing names, scripts without blanks."""

import numpy as np

from stratavox.llm import substring

SAME = "This passage stands in several texts. It has some sentences of common words. They go on for a while here. And then they end."


def test_texts_that_share_an_id_are_cut_each_by_its_own(spark):
    rng = np.random.default_rng(2)
    own = lambda n: " ".join(f"Own sentence {int(rng.integers(10**9))} says {int(rng.integers(10**9))}." for _ in range(n))
    a, b, c = own(2), own(40), own(3)
    rows = [(1, f"{own(1)} {SAME}"), (5, f"{a} {SAME}"), (5, f"{b} {SAME} {c}"), (5, own(3)), (5, None), (5, f"{SAME} {SAME}"), (None, SAME), (9, SAME)]
    docs = spark.createDataFrame([(i, t, "x", "y", [1], "z") for i, t in rows], "doc_id long, text string, _doc string, _spots string, removed array<int>, _ROW0 string")
    out = substring.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "_doc", "_spots", "_ROW0", "removed"]
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect())
    want = [(1, rows[0][1]), (5, a), (5, f"{b} {c}"), (5, rows[3][1]), (5, ""), (5, ""), (None, SAME), (9, "")]
    assert got == sorted((str(i), t) for i, t in want)


def test_rows_of_one_id_do_not_repeat_one_another(spark):
    rows = [(3, f"One. {SAME}"), (3, f"Two. {SAME}")]
    assert sorted(r["text"] for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [t for _, t in rows]


def test_scripts_without_blanks(spark):
    rng = np.random.default_rng(8)
    text = lambda n, stop: "".join("".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9000, 9)) + stop for _ in range(n))
    for stop in ("。", ""):  # with full stops, and one run of characters
        same, a, b = text(20, stop), text(15, stop), text(12, stop)
        rows = [(1, a + same), (2, b + same + a[:3])]
        got = {r["doc_id"]: r["text"] for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[1] == rows[0][1] and got[2].startswith(b[:60])
        assert len(got[2]) <= len(b) + 60 and substring.brute_force(rows) == got
    assert len(substring.sentences("他来了。她走了！谁？  明天再说")) == 4


def test_sentences_cover_texts_in_order():
    for text in ("A b. C d! E\nf  g? ", "混合 text。With blanks. 和" * 9, "İ. " * 30 + "ไทย" * 40):
        spots = [x for s, e, _ in substring.sentences(text) for x in (s, e)]
        assert spots == sorted(spots) and "".join(text[s:e] for s, e, _ in substring.sentences(text)).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
