"""Several licences in one text."""

from itertools import permutations

import pytest

from stratavox.llm import licenses

LIB, LEX = licenses.Library.build(licenses.TEMPLATES), licenses.Lexer(typed=False)


@pytest.mark.parametrize("before", [0, 30, 90, 128])
def test_licences_that_share_phrases_are_all_found(before):
    t = licenses.TEMPLATES
    alone = {n for n in t if [x[0] for x in licenses.scan(t[n], LIB, LEX)] == [n]}
    assert {"MIT", "ISC", "GPL-3.0-notice"} <= alone
    for a, b in [*permutations(("MIT", "GPL-3.0-notice"), 2), *permutations(("MIT", "ISC"), 2)]:
        text = " ".join(["word"] * before + [t[a], t[b]])
        assert {x[0] for x in licenses.scan(text, LIB, LEX)} == {a, b}


def test_versions_of_one_notice_count_once():
    for n, t in licenses.TEMPLATES.items():
        assert [x[0] for x in licenses.scan(f"Some words before. {t} And after.", LIB, LEX)] == [n]
