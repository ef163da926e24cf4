import numpy as np
import pytest

from stratavox.functions import kernels as K
from stratavox.operators import mapping as M
from stratavox.operators import resample
from stratavox.sources.volumes import collect_volume
from test_volumes import blocks_of

HEAD = '(Transform "{}")\n(TransformParameters {})\n(CenterOfRotationPoint {})\n(InitialTransformParameterFileName "{}")\n(HowToCombineTransforms "{}")\n'


def test_rotations_by_hand():
    quarter = np.pi / 2
    turn = M.parse_parameters(HEAD.format("EulerTransform", f"0 0 {quarter} 10 0 0", "1 1 0", "NoInitialTransform", "Compose"))
    assert np.allclose(turn(np.array([[2.0, 1, 5]])), [[11, 2, 5]])  # about z: x to y, around (1, 1, 0), then 10 along x
    both = HEAD.format("EulerTransform", f"{quarter} 0 {quarter} 0 0 0", "0 0 0", "NoInitialTransform", "Compose")
    assert np.allclose(M.parse_parameters(both)(np.array([[0.0, 1, 0]])), [[0, 0, 1]])  # x turns y to z, z leaves it
    late = M.parse_parameters(both + '(ComputeZYX "true")\n')
    assert np.allclose(late.matrix, M._turn(2, quarter) @ M._turn(0, quarter))
    x, y, z = (M._turn(a, t) for a, t in enumerate((0.3, -0.4, 0.5)))
    mixed = HEAD.format("EulerTransform", "0.3 -0.4 0.5 0 0 0", "0 0 0", "NoInitialTransform", "Compose")
    assert np.allclose(M.parse_parameters(mixed).matrix, z @ x @ y)
    assert np.allclose(M.parse_parameters(mixed + '(ComputeZYX "true")\n').matrix, z @ y @ x)
    half = np.sin(quarter / 2)
    same = M.parse_parameters(HEAD.format("SimilarityTransform", f"0 0 {half} 0 0 3 2", "0 0 0", "NoInitialTransform", "Compose"))
    assert np.allclose(same(np.array([[1.0, 0, 0]])), [[0, 2, 3]])
    move = M.parse_parameters('(Transform "TranslationTransform")\n(TransformParameters 1 2 3)\n')
    assert np.allclose(move(np.zeros((1, 3))), [[1, 2, 3]])


def files(how):
    return {
        "a/T.0.txt": HEAD.format("TranslationTransform", "1 0 0", "0 0 0", "NoInitialTransform", "Compose"),
        "a/T.1.txt": HEAD.format("AffineTransform", "2 0 0 0 1 0 0 0 1 0 0 0", "0 0 0", "elsewhere/T.0.txt", how),
        "a/T.2.txt": HEAD.format("TranslationTransform", "0 5 0", "0 0 0", "T.1.txt", "Compose"),
    }


def test_chains():
    p = np.array([[3.0, 0, 0]])
    (compose,), (add,) = M.parse_files(files("Compose")), M.parse_files(files("Add"))
    assert np.allclose(compose(p), [[8, 5, 0]]) and np.allclose(add(p), [[7, 5, 0]])  # 2 (3 + 1); (3 + 1) + 2 * 3 - 3
    loose = {n: t.replace("elsewhere/T.0.txt", "NoInitialTransform").replace("T.1.txt", "NoInitialTransform") for n, t in files("Compose").items()}
    assert [np.allclose(t(p), w) for t, w in zip(M.parse_files(loose), ([[4, 0, 0]], [[6, 0, 0]], [[3, 5, 0]]), strict=True)] == [True] * 3
    with pytest.raises(ValueError, match="not one chain"):
        M.parse_files({k: v for k, v in files("Add").items() if "T.0" not in k})
    with pytest.raises(ValueError, match="starts from itself"):
        M.parse_chain(lambda n: files("Add")["a/T.1.txt"].replace("elsewhere/T.0.txt", "T.1.txt"), "T.1.txt")
    with pytest.raises(ValueError, match="parameters are no"):
        M.parse_parameters('(Transform "AffineTransform")\n(TransformParameters 1 2)\n')


def test_chain_of_points(spark):
    (chain,) = M.parse_files(files("Add"))
    got = M.transform_points(spark.createDataFrame([(0.0, 0.0, 3.0), (None, 0.0, 0.0)], "z double, y double, x double"), [chain]).collect()
    assert (got[0]["z_trfm"], got[0]["y_trfm"], got[0]["x_trfm"]) == (0, 5, 7) and got[1]["x_trfm"] is None


def by_numpy(a, shape, transforms, missing):
    """Every voxel alone, from the coefficients of the whole volume."""
    c = a.astype(np.float64)
    for axis in range(3):
        c = np.moveaxis(K.spline_coefficients(np.moveaxis(c, axis, 0)), 0, axis)
    out = np.full(shape, missing, np.float64)
    for p in np.ndindex(*shape):
        to = np.array([p[::-1]], np.float64)
        for t in transforms:
            to = t(to)
        to = to[0, ::-1]
        if any(v < -0.5 or v >= n - 0.5 for v, n in zip(to, a.shape, strict=True)):
            continue
        total = 0.0
        for d in np.ndindex(4, 4, 4):
            k = [int(np.floor(v)) - 1 + i for v, i in zip(to, d, strict=True)]
            w = np.prod([float(K.bspline3(np.array(v - i))) for v, i in zip(to, k, strict=True)])
            k = [min(max(-i if i < 0 else 2 * (n - 1) - i if i > n - 1 else i, 0), n - 1) for i, n in zip(k, a.shape, strict=True)]
            total += w * c[tuple(k)]
        out[p] = total
    return out


@pytest.mark.parametrize("name", ["identity", "shift", "affine", "spline"])
def test_image_transform(spark, name):
    a = np.random.default_rng(8).integers(0, 900, (9, 10, 11)).astype(np.uint16)
    grid = np.random.default_rng(9).normal(0, 1.5, (3, 7, 7, 7))
    steps = {
        "identity": [],
        "shift": [M.Affine(np.eye(3), np.array([2.0, -1, 3]), np.zeros(3))],
        "affine": [M.Affine(np.array([[0.8, 0.2, 0], [-0.1, 0.9, 0.1], [0, 0.3, 1.1]]), np.array([0.313, -0.217, 1.029]), np.full(3, 4.0))],
        "spline": [M.BSpline((7, 7, 7), np.full(3, 3.0), np.full(3, -4.0), grid)],
    }[name]
    shape = (8, 9, 13)
    want = by_numpy(a, shape, steps, -7)
    blocks = resample.transform_volume(blocks_of(spark, a, (4, 5, 6)), a.shape, shape, steps, (5, 4, 6), missing=-7)
    got = collect_volume(blocks, shape, "f8")
    assert np.abs(got - want).max() < 1e-8
    if name == "identity":
        assert np.abs(got[:, :, :11] - a[:8, :9]).max() < 1e-8 and (got[:, :, 11:] == -7).all()
    if name == "shift":
        assert np.abs(got[:6, 1:, :9] - a[3:9, :8, 2:11]).max() < 1e-8
