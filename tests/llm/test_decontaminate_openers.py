"""Items whose names open sentences."""

from test_decontaminate_places import held

ITEM = "Anna has 12 apples. Ben has 7 apples. Anna gives 3 to Ben. How many apples does Anna have now?"


def test_names_that_open_sentences_are_replaced():
    other = ITEM.replace("Anna", "Carl").replace("Ben", "Dora").replace("12", "15").replace("7", "8").replace("3", "4")
    assert held(ITEM, f"Here some words stand before. {other} And some after it.") == ["reparameterised"]
    assert held(ITEM, ITEM) == held(ITEM, f"before it {ITEM} After it") == ["verbatim"]
    assert held(ITEM, other.replace("Carl gives", "Erik gives")) == []
