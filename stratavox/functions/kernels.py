"""numpy kernels over one dense block; axes are (z, y, x)."""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np


def ball(radius: int, closed: bool = True) -> np.ndarray:
    """Lattice offsets (n, 3) within a radius: at most r away, or nearer than r if not closed."""
    r = np.arange(-radius, radius + 1)
    z, y, x = np.meshgrid(r, r, r, indexing="ij")
    d = z * z + y * y + x * x
    return np.argwhere(d <= radius * radius if closed else d < radius * radius) - radius


def _running(block: np.ndarray, half: int, op: np.ufunc, blank) -> np.ndarray:
    """op over 2 * half + 1 neighbours along x, by doubling: logarithmic in the width."""
    if not half:
        return block
    n, width = block.shape[-1], 2 * half + 1
    out = np.pad(block, ((0, 0), (0, 0), (half, half)), constant_values=blank)
    have = 1
    while have < width:
        step = min(have, width - have)
        out = op(out[..., : out.shape[-1] - step], out[..., step:])
        have += step
    return out[..., :n]


def _over_ball(block: np.ndarray, radius: int, op: np.ufunc, blank) -> np.ndarray:
    """op over the ball around each voxel. Mirrored voxels lie inside the ball's part of the block, so leaving
    out what is beyond an edge gives the same as mirroring."""
    nz, ny, _ = block.shape
    rows: dict[int, np.ndarray] = {}
    out = np.full_like(block, blank)
    for dz in range(-min(radius, nz - 1), min(radius, nz - 1) + 1):
        for dy in range(-min(radius, ny - 1), min(radius, ny - 1) + 1):
            left = radius * radius - dz * dz - dy * dy
            if left < 0:
                continue
            half = int(left**0.5)
            if half not in rows:
                rows[half] = _running(block, half, op, blank)
            to = (slice(max(0, -dz), nz - max(0, dz)), slice(max(0, -dy), ny - max(0, dy)))
            frm = (slice(max(0, dz), nz + min(0, dz)), slice(max(0, dy), ny + min(0, dy)))
            out[to] = op(out[to], rows[half][frm])
    return out


def _limits(dtype: np.dtype) -> tuple:
    return (np.iinfo(dtype).min, np.iinfo(dtype).max) if dtype.kind in "iu" else (-np.inf, np.inf)


def erode(block: np.ndarray, radius: int) -> np.ndarray:
    return _over_ball(block, radius, np.minimum, _limits(block.dtype)[1])


def dilate(block: np.ndarray, radius: int) -> np.ndarray:
    return _over_ball(block, radius, np.maximum, _limits(block.dtype)[0])


def to_uint16(block: np.ndarray) -> np.ndarray:
    """Negative values become 0, fractions are cut."""
    return np.clip(block, 0, 65535).astype(np.uint16)


def tophat(block: np.ndarray, radius: int = 10) -> np.ndarray:
    """White top-hat: what a ball can't fit under."""
    v = block.astype(np.float32)
    return to_uint16(v - dilate(erode(v, radius), radius))


def fold(i: np.ndarray, n: int) -> np.ndarray:
    """Indices mirrored at the edges, the edge voxel repeated: -1 is 0, n is n - 1; any number of folds."""
    i = np.mod(i, 2 * n)
    return np.where(i < n, i, 2 * n - 1 - i)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


@lru_cache(64)
def _folded_matrix(n: int, weights: bytes, dtype: str) -> np.ndarray:
    """(n, n) matrix of a kernel along an axis of n voxels with mirrored edges."""
    w = np.frombuffer(weights, dtype)
    at = np.arange(n)[:, None]
    to = fold(at + np.arange(len(w)) - len(w) // 2, n)
    m = np.zeros((n, n), dtype)
    np.add.at(m, (np.broadcast_to(at, to.shape), to), np.broadcast_to(w, to.shape))
    return m


def convolve_axes(block: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One symmetric kernel along each axis with mirrored edges: shifted sums for narrow kernels, one small matrix
    per axis for wide ones."""
    radius = len(weights) // 2
    out = block
    for axis in range(3):
        n = out.shape[axis]
        moved = np.moveaxis(out, axis, 0)
        if 4 * radius < n:
            acc = np.zeros_like(moved)
            for k, w in enumerate(weights):
                acc += w * moved[fold(np.arange(n) + k - radius, n)]
        else:
            acc = np.tensordot(_folded_matrix(n, weights.tobytes(), weights.dtype.str).astype(moved.dtype), moved, axes=1)
        out = np.moveaxis(acc, 0, axis)
    return out


def gaussian(block: np.ndarray, sigma: float, dtype: str = "f4") -> np.ndarray:
    return convolve_axes(block.astype(dtype), gaussian_weights(sigma).astype(dtype))


def gaussian_blur(block: np.ndarray, sigma: float, dtype: str = "f4") -> np.ndarray:
    return to_uint16(gaussian(block, sigma, dtype))


def dog(block: np.ndarray, sigma1: float = 1, sigma2: float = 4, dtype: str = "f4") -> np.ndarray:
    """Difference of two Gaussians."""
    return to_uint16(gaussian(block, sigma1, dtype) - gaussian(block, sigma2, dtype))


def subtract_gaussian(block: np.ndarray, sigma: float = 101, dtype: str = "f4") -> np.ndarray:
    """What is above the local mean."""
    return to_uint16(block.astype(dtype) - gaussian(block, sigma, dtype))


def local_maxima(block: np.ndarray, radius: int, mask: np.ndarray | None = None) -> np.ndarray:
    """Voxels equal to the maximum of their ball; of a plateau every voxel. Outside the mask values count as 0 and no
    voxel is a maximum."""
    v = block if mask is None else np.where(mask > 0, block, 0)
    top = v == dilate(v, radius)
    return (top if mask is None else top & (mask > 0)).astype(np.uint8)


def threshold(block: np.ndarray, value: float) -> np.ndarray:
    return (block >= value).astype(np.uint8)


def mean_threshold(block: np.ndarray, offset_sd: float = 0.0) -> np.ndarray:
    """Above the mean plus some population standard deviations of the non-zero voxels of the block."""
    seen = block[block > 0].astype(np.float64)
    return (block > seen.mean() + offset_sd * seen.std()).astype(np.uint8) if len(seen) else np.zeros(block.shape, np.uint8)


def min_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each of n nodes, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        nxt = root.copy()
        np.minimum.at(nxt, root[a], low)
        np.minimum.at(nxt, root[b], low)
        while True:
            jump = nxt[nxt]
            if np.array_equal(jump, nxt):
                break
            nxt = jump
        if np.array_equal(nxt, root):
            return root
        root = nxt


def label6(mask: np.ndarray) -> np.ndarray:
    """Face-connected components numbered from 1 in the order of their first voxel; 0 outside."""
    flat = np.flatnonzero(mask.ravel() > 0)
    if not len(flat):
        return np.zeros(mask.shape, np.int64)
    number = np.full(mask.size, -1)
    number[flat] = np.arange(len(flat))
    cube = number.reshape(mask.shape)
    a, b = [], []
    for axis in range(3):
        lo, hi = (np.take(cube, range(s, cube.shape[axis] - 1 + s), axis=axis).ravel() for s in (0, 1))
        both = (lo >= 0) & (hi >= 0)
        a.append(lo[both])
        b.append(hi[both])
    _, order = np.unique(min_roots(len(flat), np.concatenate(a), np.concatenate(b)), return_inverse=True)
    out = np.zeros(mask.size, np.int64)
    out[flat] = order + 1
    return out.reshape(mask.shape)


def label_volumes(labels: np.ndarray) -> np.ndarray:
    """At each voxel the size of its label inside the block."""
    ids, inv, n = np.unique(labels, return_inverse=True, return_counts=True)
    return np.where(ids == 0, 0, n)[inv].reshape(labels.shape)


#: Voxels of a front that are flooded together; smaller fronts go voxel by voxel.
FRONT = 512


def watershed(block: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Flood from the markers, brightest voxels first and in order of arrival among equals, through faces and inside
    the mask; every reached voxel takes the label it was reached from.

    Only voxels of the mask are numbered. They wait in one bucket for each brightness, in order of arrival. A large bucket is
    flooded as a whole, each neighbour claimed by the first that reaches it; where a neighbour is brighter the front ends
    before it, as what lies behind has to wait until the brighter voxel and all brighter ones beyond it are done.
    """
    inside = np.flatnonzero(mask > 0)
    n = len(inside)
    out = np.zeros(block.size, markers.dtype)
    if not n:
        return out.reshape(block.shape)
    number = np.full([s + 2 for s in block.shape], n, np.int32)  # n: outside
    zyx = [k + 1 for k in np.unravel_index(inside, block.shape)]
    number[tuple(zyx)] = np.arange(n, dtype=np.int32)
    _, ny, nx = number.shape
    steps = np.array([-ny * nx, -nx, -1, 1, nx, ny * nx])
    near = number.ravel()[np.ravel_multi_index(zyx, number.shape)[:, None] + steps]
    levels, rank = np.unique(block.ravel()[inside], return_inverse=True)
    ranks = array("q", (len(levels) - 1 - rank).astype(np.int64).tobytes())  # 0: brightest
    labels = array("q", np.r_[markers.ravel()[inside].astype(np.int64), -1].tobytes())
    rank_of, label_of, beside = np.frombuffer(ranks, np.int64), np.frombuffer(labels, np.int64), near.tolist() if n < 4 * FRONT else None
    flat = array("i", np.ascontiguousarray(near, np.int32).tobytes())

    buckets: dict[int, list[int]] = {}
    active: list[int] = []

    def add(voxels: np.ndarray) -> None:
        r = rank_of[voxels]
        order = np.argsort(r, kind="stable")
        cuts = np.flatnonzero(np.diff(r[order])) + 1
        for part in np.split(voxels[order], cuts):
            if len(part):
                k = ranks[int(part[0])]
                if k in buckets:
                    buckets[k].extend(part.tolist())
                else:
                    buckets[k] = part.tolist()
                    heapq.heappush(active, k)

    add(np.flatnonzero(label_of[:n]))
    done: dict[int, int] = {}  # how far a bucket has been taken
    while active:
        level = active[0]
        front, at, wait = buckets[level], done.get(level, 0), 0
        brighter = False
        while at < len(front) and not brighter:
            if len(front) - at >= FRONT and at >= wait:
                voxels = np.array(front[at:], np.int64)
                reached = near[voxels].ravel()
                free = np.flatnonzero(label_of[reached] == 0)
                new, first = np.unique(reached[free], return_index=True)
                first = free[first]
                higher = first[rank_of[new] < level]
                cut = int(higher.min()) // 6 if len(higher) else len(voxels)
                mine = np.argsort(first, kind="stable")
                mine = mine[first[mine] < 6 * cut]
                label_of[new[mine]] = label_of[voxels[first[mine] // 6]]
                add(new[mine].astype(np.int64))
                at += cut
                if cut <= FRONT // 4:
                    wait = at + FRONT
                continue
            i = front[at]
            at += 1
            own = labels[i]
            for j in beside[i] if beside else flat[6 * i : 6 * i + 6]:
                if not labels[j]:
                    labels[j] = own
                    k = ranks[j]
                    if k in buckets:
                        buckets[k].append(j)
                    else:
                        buckets[k] = [j]
                        heapq.heappush(active, k)
                    if k < level:
                        brighter = True
        if at < len(front) or active[0] != level:
            done[level] = at
        else:
            heapq.heappop(active)
            buckets.pop(level)
            done.pop(level, None)
    out[inside] = label_of[:n]
    return out.reshape(block.shape)


def bspline3(t: np.ndarray) -> np.ndarray:
    """Cubic B-spline."""
    t = np.abs(t)
    return np.where(t < 1, 2 / 3 - t * t + t**3 / 2, np.where(t < 2, (2 - t) ** 3 / 6, 0.0))


def zoom_matrix(n: int, m: int) -> np.ndarray:
    """(m, n) cubic spline resampling with both ends aligned; the spline passes through the samples, edges mirror."""
    if n == 1:
        return np.ones((m, 1))
    mirror = lambda i: np.where(i < 0, -i, np.where(i > n - 1, 2 * (n - 1) - i, i))
    basis = np.zeros((n, n))
    for d in (-1, 0, 1):
        np.add.at(basis, (np.arange(n), mirror(np.arange(n) + d)), bspline3(np.array(float(d))))
    at = np.arange(m) * ((n - 1) / (m - 1)) if m > 1 else np.zeros(1)
    first = np.floor(at).astype(int)
    read = np.zeros((m, n))
    for d in (-1, 0, 1, 2):
        i = first + d
        np.add.at(read, (np.arange(m), np.clip(mirror(i), 0, n - 1)), bspline3(at - i))
    return np.linalg.solve(basis.T, read.T).T


def sample_places(n: int, m: int) -> np.ndarray:
    """Where m samples lie among n, both ends aligned."""
    return np.arange(m) * ((n - 1) / (m - 1)) if m > 1 else np.zeros(1)


#: What the weights of a coefficient add up to in the SQL version, where they are doubles: 3e-16 less than 1, as much as the last
#: of the ten digits of a result can turn on.
_WEIGHTS = sum(np.longdouble(math.sqrt(3) * math.pow(math.sqrt(3) - 2, abs(k))) for k in range(-40, 41))


def spline_coefficients(f: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic spline through samples along the first axis, mirrored at both ends: one sweep forward and one
    back through the three diagonals. They are of extended precision, so the sweeps add no rounding to that of the weights."""
    n = len(f)
    if n == 1:
        return f.copy()
    out, ratio = np.empty(f.shape, np.longdouble), np.empty(n, np.longdouble)
    ratio[0], out[0] = 0.5, f[0] * (1.5 * _WEIGHTS)
    sixth = np.longdouble(1) / 6
    for i in range(1, n):
        below = sixth if i < n - 1 else 2 * sixth
        pivot = 4 * sixth - below * ratio[i - 1]
        ratio[i] = sixth / pivot
        out[i] = f[i] * (_WEIGHTS / pivot) - out[i - 1] * (below / pivot)
    for i in range(n - 2, -1, -1):
        out[i] -= ratio[i] * out[i + 1]
    return out


def resample_window(window: np.ndarray, start: int, n: int, at: np.ndarray) -> np.ndarray:
    """The spline at places of an axis of n samples, from a window of the samples from `start` on that reaches far enough;
    rounded to doubles at the end alone."""
    c = spline_coefficients(window)
    if n == 1:
        return np.repeat(c, len(at), axis=0)
    i = np.floor(at).astype(np.int64)[:, None] + np.arange(-1, 3)
    inside = np.clip(np.where(i < 0, -i, np.where(i > n - 1, 2 * (n - 1) - i, i)), 0, n - 1)
    out = np.empty((len(at), *window.shape[1:]))
    for k, weights in enumerate(bspline3(at[:, None] - i)):
        out[k] = sum(w * c[j] for w, j in zip(weights, inside[k] - start, strict=True))
    return out


def zoom(block: np.ndarray, factors: tuple[float, float, float]) -> np.ndarray:
    """Cubic spline resampling of a whole volume; each axis gets round(n * factor) samples."""
    out = block.astype(np.float64)
    for axis, f in enumerate(factors):
        n = out.shape[axis]
        out = np.moveaxis(np.tensordot(zoom_matrix(n, max(1, round(n * f))), np.moveaxis(out, axis, 0), axes=1), 0, axis)
    return out


def orient_axes(orientation: tuple[int, int, int]) -> tuple[list[int], list[bool]]:
    """Source axis and flip of each result axis of a signed permutation of 1, 2, 3; signs belong to source axes."""
    if sorted(abs(o) for o in orientation) != [1, 2, 3]:
        raise ValueError("orientation is a signed permutation of 1, 2, 3")
    flips = [o < 0 for o in orientation]
    return [abs(o) - 1 for o in orientation], flips


def reorient(block: np.ndarray, orientation: tuple[int, int, int]) -> np.ndarray:
    """Flip the axes whose number is negative, then permute: result axis k is source axis |orientation[k]|."""
    axes, flips = orient_axes(orientation)
    turned = [i for i, f in zip(axes, flips, strict=True) if f]
    return np.ascontiguousarray(np.flip(block, turned).transpose(axes))


def chain(*steps: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Several kernels as one, so a block goes to Python once."""

    def run(block: np.ndarray) -> np.ndarray:
        for step in steps:
            block = step(block)
        return block

    return run
