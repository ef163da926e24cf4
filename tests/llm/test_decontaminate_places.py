"""Items whose windows repeat, and documents with several places like an item."""

import pytest

from stratavox.llm import decontaminate
from stratavox.llm.templates import Lexer


def held(item, text):
    return [m[2] for m in decontaminate.matches(text, decontaminate.make_block([(1, item)]), Lexer(), 0.8)]


@pytest.mark.parametrize("before", range(8))
@pytest.mark.parametrize(
    "item",
    [
        "A shop sells 12 apples for 5 euros on Monday and a shop sells 5 apples for 12 euros on Sunday so what is the price of 3 apples",
        "Tom runs 3 km in 20 minutes and then Tom runs 5 km in 40 minutes while Sue runs 3 km in 25 minutes and then Sue runs 5 km in 30 minutes",
    ],
)
def test_a_verbatim_copy_is_held_wherever_it_stands(item, before):
    assert held(item, " ".join(["word"] * before) + f" {item} and other words follow here") == ["verbatim"]
