import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratavox.llm import golay, simhash


def test_every_word_is_near_one_codeword():
    _, _, errors = golay.tables()
    assert (errors[:, 0] >= 0).all()
    keys = (errors >= 0).sum(1)
    assert set(keys.tolist()) == {1, 6}
    assert (keys == 6).sum() == 1771  # the error patterns of weight three


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_fingerprints_within_three_bits_share_a_key(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    a, b = (np.array([v], np.uint64).view(np.int64) for v in (fp, other))
    (ka, ra, _), (kb, rb, _) = simhash.keys(a), simhash.keys(b)
    assert set(ka[ra == 0].tolist()) & set(kb[rb == 1].tolist())
    assert set(kb[rb == 0].tolist()) & set(ka[ra == 1].tolist())
