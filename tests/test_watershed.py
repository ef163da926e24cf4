"""The bucketed watershed against one heap step per voxel."""

import heapq
import time

import numpy as np
import pytest

from stratavox.functions import kernels as K


def by_heap(block, markers, mask):
    nz, ny, nx = block.shape
    label = np.where(mask > 0, markers, 0)
    queue = [(-int(block[p]), k, p) for k, p in enumerate(zip(*np.nonzero(label), strict=True))]
    heapq.heapify(queue)
    arrival = len(queue)
    while queue:
        _, _, (z, y, x) = heapq.heappop(queue)
        for p in ((z - 1, y, x), (z, y - 1, x), (z, y, x - 1), (z, y, x + 1), (z, y + 1, x), (z + 1, y, x)):
            if 0 <= p[0] < nz and 0 <= p[1] < ny and 0 <= p[2] < nx and mask[p] and not label[p]:
                label[p] = label[z, y, x]
                heapq.heappush(queue, (-int(block[p]), arrival, p))
                arrival += 1
    return label


@pytest.mark.parametrize("front", [1, 3, 20, 10**9])
@pytest.mark.parametrize("levels", [1, 2, 5, 1000])
def test_against_a_heap(monkeypatch, front, levels):
    monkeypatch.setattr(K, "FRONT", front)
    rng = np.random.default_rng(front % 97 + levels)
    for shape in ((1, 1, 9), (4, 5, 6), (7, 8, 9), (3, 1, 20)):
        for _ in range(12):
            block = rng.integers(0, levels, shape).astype(np.uint16)
            if levels > 2 and rng.random() < 0.5:  # smooth: wide fronts, few climbs
                block = np.rint(K.gaussian(block, 1)).astype(np.uint16)
            mask = (rng.random(shape) < rng.choice([0.3, 0.8, 1.0])).astype(np.uint8)
            markers = np.where(rng.random(shape) < 0.08, rng.integers(1, 50, shape) << 33, 0)
            got = K.watershed(block, markers, mask)
            assert got.dtype == markers.dtype and np.array_equal(got, by_heap(block, markers, mask))


def test_nothing_to_flood():
    none = np.zeros((2, 3, 4), np.int64)
    assert not K.watershed(none, none, none).any()
    assert not K.watershed(none, none, none + 1).any()


@pytest.mark.parametrize("levels, smooth", [(60000, 0), (60000, 2), (8, 2)])
def test_a_large_block_takes_seconds(levels, smooth):
    rng = np.random.default_rng(1)
    block = rng.integers(0, levels, (100, 100, 100)).astype(np.uint16)
    if smooth:
        block = np.rint(K.gaussian(block, smooth)).astype(np.uint16)
    markers = np.zeros(block.shape, np.int64)
    at = np.flatnonzero(rng.random(block.size) < 0.0005)
    markers.ravel()[at] = np.arange(1, len(at) + 1)
    began = time.process_time()
    got = K.watershed(block, markers, np.ones(block.shape, np.uint8))
    took = time.process_time() - began
    print(levels, smooth, took)
    assert (got > 0).all() and took < 20
