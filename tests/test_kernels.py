import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratavox.functions import kernels as K


def row(*v, dtype=np.int64):
    return np.array([[v]], dtype)


def test_ball_sizes():
    assert [len(K.ball(r)) for r in (1, 2, 3, 5)] == [7, 33, 123, 515]
    assert [len(K.ball(r, closed=False)) for r in (1, 2, 3, 5)] == [1, 27, 93, 485]


def test_threshold_includes_the_value():
    assert K.threshold(row(59, 60, 61), 60).ravel().tolist() == [0, 1, 1]


def test_tophat_by_hand():
    assert K.tophat(row(5, 5, 9, 5, 5, 5, 5), 1).ravel().tolist() == [0, 0, 4, 0, 0, 0, 0]
    assert K.tophat(row(1, 2, 3, 4, 5), 1).ravel().tolist() == [0, 0, 0, 0, 1]


def test_local_maxima_by_hand():
    v = row(1, 3, 3, 1, 0, 5, 0)
    assert K.local_maxima(v, 1, np.ones_like(v)).ravel().tolist() == [0, 1, 1, 0, 0, 1, 0]
    assert K.local_maxima(v, 1, row(1, 1, 1, 1, 0, 0, 0)).ravel().tolist() == [0, 1, 1, 0, 0, 0, 0]


def test_watershed_by_hand():
    markers = row(0, 1, 0, 0, 0, 2, 0)
    assert K.watershed(row(3, 5, 3, 1, 2, 6, 2), markers, np.ones_like(markers)).ravel().tolist() == [1, 1, 1, 1, 2, 2, 2]
    walled = K.watershed(row(3, 5, 3, 1, 2, 6, 2), markers, row(1, 1, 1, 0, 1, 1, 0))
    assert walled.ravel().tolist() == [1, 1, 1, 0, 2, 2, 0]


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 3), st.integers(0, 2**32 - 1))
def test_dilation_against_a_loop_over_mirrored_offsets(radius, seed):
    block = np.random.default_rng(seed).integers(0, 50, (4, 5, 6))
    wide = np.pad(block, radius, mode="symmetric")
    want = np.zeros_like(block)
    for z, y, x in np.ndindex(*block.shape):
        want[z, y, x] = max(wide[z + radius + d[0], y + radius + d[1], x + radius + d[2]] for d in K.ball(radius))
    assert (K.dilate(block, radius) == want).all()
    assert (K.erode(-block, radius) == -want).all()
    assert (K.tophat(block, radius) <= block).all()


@pytest.mark.parametrize("sigma", [0.6, 1.0, 5.0])
def test_gaussian_against_direct_convolution(sigma):
    block = np.random.default_rng(0).normal(size=(6, 7, 9))
    w = K.gaussian_weights(sigma)
    r = len(w) // 2
    want = block
    for axis in range(3):
        n = want.shape[axis]
        wide = np.take(want, K.fold(np.arange(-r, n + r), n), axis)
        want = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), axis, wide)
    assert np.allclose(K.convolve_axes(block, w), want)


def test_labels_count_in_order_of_first_voxel():
    assert K.label6(row(1, 0, 1, 1)).ravel().tolist() == [1, 0, 2, 2]
    diagonal = np.zeros((2, 2, 2), int)
    diagonal[0, 0, 0] = diagonal[1, 1, 1] = 1
    assert K.label6(diagonal).max() == 2
    assert not K.label6(np.zeros((2, 2, 2))).any()
    assert K.label_volumes(row(1, 0, 2, 2)).ravel().tolist() == [1, 0, 2, 2]


def test_zoom_keeps_ends_and_reproduces_samples():
    assert np.allclose(K.zoom_matrix(9, 9), np.eye(9))
    x = np.cos(np.linspace(0, 3, 9))
    y = K.zoom_matrix(9, 17) @ x
    assert np.allclose(y[::2], x) and K.zoom(np.ones((4, 6, 8)), (1.0, 0.5, 0.5)).shape == (4, 3, 4)


def test_reorient_by_hand():
    a = np.arange(24).reshape(2, 3, 4)
    out = K.reorient(a, (-2, 1, 3))
    assert out.shape == (3, 2, 4)
    assert all(out[j, i, k] == a[i, 2 - j, k] for i, j, k in np.ndindex(2, 3, 4))
    with pytest.raises(ValueError):
        K.reorient(a, (1, 1, 3))


def test_mean_threshold_ignores_zeros():
    assert K.mean_threshold(row(0, 0, 1, 3)).ravel().tolist() == [0, 0, 0, 1]
    assert not K.mean_threshold(row(0, 0)).any()


def test_uint16_cuts_and_clips():
    assert K.to_uint16(np.array([-1.5, 0.9, 2.99, 70000])).tolist() == [0, 0, 2, 65535]
