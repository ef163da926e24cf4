"""Documents with several places like an item."""

from test_decontaminate_places import held

LAPS = "a car drives {} km in {} hours and then {} km in {} hours on the same road so how fast is it"


def test_a_look_alike_does_not_hide_the_item():
    item, other = LAPS.format(60, 2, 60, 3), LAPS.format(50, 2, 70, 3)
    filler = "some words in between that belong to nothing " * 4
    assert held(item, other) == []
    for text in (f"{other} {filler} {item}", f"{item} {filler} {other}", f"{other} {item}", f"{other} {other} {item} {other}"):
        assert held(item, text) == ["verbatim"]
    assert held(item, f"{other} {filler} {LAPS.format(9, 4, 9, 5)}") == ["reparameterised"]
