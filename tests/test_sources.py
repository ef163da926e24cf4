import re

import numpy as np
import pytest

from stratavox.sources import nifti, tiff, zarr
from stratavox.sources import volumes as S
from test_volumes import blocks_of


@pytest.mark.parametrize("dtype", ["u1", "u2", "u4", "i2", "f4", "f8"])
@pytest.mark.parametrize("compress", [False, True])
def test_tiff_round_trip(dtype, compress):
    a = (np.random.default_rng(0).normal(size=(3, 5, 7)) * 100).astype(dtype)
    assert (tiff.from_bytes(tiff.to_bytes(a, compress)) == a).all()
    assert tiff.from_bytes(tiff.to_bytes(a[0])).shape == (5, 7)
    assert tiff.from_bytes(tiff.to_bytes(a[0]), squeeze=False).shape == (1, 5, 7)


@pytest.mark.parametrize("compress", [False, True, "lzw"])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("cut", [{"tile": (16, 32)}, {"rows": 4}, {}])
def test_tiff_segments(compress, predictor, cut):
    rng = np.random.default_rng(3)
    for a in (rng.integers(0, 60000, (2, 37, 50)).astype("u2"), np.zeros((1, 90, 70), "u1"), np.cumsum(rng.integers(0, 3, (2, 20, 33)), axis=2).astype("i4")):
        data = tiff.to_bytes(a, compress, predictor, **cut)
        assert np.array_equal(tiff.from_bytes(data, squeeze=False), a)
        for y, x in ((slice(3, 18), slice(20, 33)), (slice(0, 1), slice(0, 1)), (slice(5, 5), slice(None)), (slice(None), slice(30, 31))):
            opened = []

            def read(at, n, data=data, opened=opened):
                opened.append(at)
                return data[at : at + n]

            page = list(tiff.pages(read))[-1]
            opened.clear()
            assert np.array_equal(page.decode(read, y, x), a[-1][y, x])
            sh, sw = page.segment
            want = len({(r // sh, c // sw) for r in range(*y.indices(page.shape[0])) for c in range(*x.indices(page.shape[1]))})
            assert len(opened) == want


def test_lzw_round_trips_and_known_bytes():
    rng = np.random.default_rng(4)
    cases = [b"", b"a", b"a" * 100_000, bytes(range(256)) * 40, rng.bytes(70_000), rng.integers(0, 3, 200_000).astype("u1").tobytes()]
    for data in cases:
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    # 7 7 7 8 8 7 7 6 6: clear, 7, 258, 8, 8, 258, 6, 6, end, nine bits each
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    known = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == known
    assert tiff.lzw_decode(known) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    with pytest.raises(ValueError):
        tiff.lzw_decode(b"\x80\x7f\xff")


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        tiff.from_bytes(b"not a file at all")
    with pytest.raises(ValueError):
        nifti.from_bytes(b"\0" * 400)


@pytest.mark.parametrize("compress", [False, True])
def test_nifti_round_trip(compress):
    a = np.random.default_rng(0).integers(0, 1000, (3, 5, 7)).astype("u2")
    assert (nifti.from_bytes(nifti.to_bytes(a, compress)) == a).all()


def test_zarr_chunk_round_trip():
    a = np.arange(60, dtype="<u2").reshape(3, 4, 5)
    import json

    meta = json.loads(zarr.metadata((3, 4, 5), (2, 4, 4), "<u2"))
    assert (zarr.decode(zarr.encode(a[2:, :, 4:], (2, 4, 4)), meta, (1, 0, 1)) == a[2:, :, 4:]).all()


def test_volumes_from_files(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 5000, (5, 6, 7)).astype(np.uint16)
    stack = tmp_path / "stack"
    stack.mkdir()
    for i, page in enumerate(a):
        (stack / f"img{i * 5}.tif").write_bytes(tiff.to_bytes(page))  # img10 comes after img5
    (stack / "note.tiff").write_text("not read")
    one = tmp_path / "one.tif"
    one.write_bytes(tiff.to_bytes(a, compress=True))
    nii = tmp_path / "a.nii.gz"
    nii.write_bytes(nifti.to_bytes(a))
    z = str(tmp_path / "a.zarr")
    S.write_zarr(blocks_of(spark, a, (2, 4, 4)), z, a.shape, (2, 4, 4), "uint16")
    for path in (str(stack), str(one), str(nii), z):
        got = S.read_volume(spark, path, (2, 4, 4))
        assert (S.collect_volume(got, a.shape, "uint16") == a).all(), path
        assert got.count() == 3 * 2 * 2
    for bad in ("x.png", "y.jpg"):
        with pytest.raises(ValueError):
            S.read_volume(spark, str(tmp_path / bad), (2, 4, 4))
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(Exception):
        S.read_volume(spark, str(empty), (2, 4, 4))


def test_single_files(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 5000, (5, 6, 7)).astype(np.uint16)
    b = blocks_of(spark, a, (2, 4, 4))
    for name, read in (("o/v.tif", tiff.from_bytes), ("o/v.nii", nifti.from_bytes)):
        S.write_single(b, str(tmp_path / name), a.shape, "uint16")
        assert (read((tmp_path / name).read_bytes()) == a).all()
    with pytest.raises(ValueError):
        S.collect_volume(b, a.shape, "uint16", most=10)


@pytest.mark.parametrize("cut", [{"tile": (16, 16)}, {"rows": 5}])
@pytest.mark.parametrize("compress", [False, "lzw"])
def test_a_box_of_a_large_file(spark, tmp_path, cut, compress):
    a = np.random.default_rng(5).integers(0, 5000, (9, 60, 70)).astype(np.uint16)
    (tmp_path / "a.tif").write_bytes(tiff.to_bytes(a, compress, **cut))
    whole, part = tmp_path / "whole", tmp_path / "part"
    whole.mkdir()
    part.mkdir()
    path, chunk = str(tmp_path / "a.tif"), (4, 20, 30)
    assert (S.collect_volume(S.read_big_tiff(spark, path, chunk, opened=str(whole)), a.shape, "u2") == a).all()
    box = ((5, 21, 0), (7, 39, 29))
    near = S.read_big_tiff(spark, path, chunk, box, opened=str(part))
    rows = near.collect()
    assert [(r["z0"], r["y0"], r["x0"]) for r in rows] == [(4, 20, 0)]
    assert (S.as_array(rows[0].asDict()) == a[4:8, 20:40, :30]).all()
    count = lambda d: sum(int(f.read_text()) for f in d.iterdir())
    # four pages; rows 20 to 39 and columns up to 29 meet 2 by 2 tiles of 16, or 4 strips of 5
    assert count(part) == 4 * 4 and count(whole) > 5 * count(part)
    q = near._jdf.queryExecution()
    left = lambda plan: re.search(r"z0#\d+L [<>] (cast\()?-?\d", plan.toString())
    assert left(q.analyzed()) and not left(q.executedPlan())  # Spark has handed these comparisons to the source


def test_a_large_file_written_by_tasks(spark, tmp_path):
    a = np.random.default_rng(6).integers(0, 5000, (7, 50, 40)).astype(np.uint16)
    path = str(tmp_path / "sub" / "out.tif")
    blocks = blocks_of(spark, a, (3, 20, 16)).repartition(5)
    S.write_big_tiff(blocks, path, a.shape, "uint16")
    with open(path, "rb") as f:
        assert np.array_equal(tiff.from_bytes(f.read()), a)
    assert (S.collect_volume(S.read_big_tiff(spark, path, (4, 20, 30)), a.shape, "u2") == a).all()
    with pytest.raises(Exception, match="out.tif"):
        S.write_big_tiff(blocks, path, a.shape, "uint16")
    S.write_big_tiff(blocks.where("cz = 0"), path, a.shape, "uint16", overwrite=True)
    with open(path, "rb") as f:
        got = tiff.from_bytes(f.read())
    assert np.array_equal(got[:3], a[:3]) and not got[3:].any()
    with pytest.raises(Exception, match="outside the shape"):
        S.write_big_tiff(blocks, path, (7, 50, 30), "uint16", overwrite=True)
    assert [f.name for f in (tmp_path / "sub").iterdir()] == ["out.tif"]  # a failed write leaves the old file alone


def test_stack_of_files_with_several_pages(spark, tmp_path):
    a = np.random.default_rng(7).integers(0, 5000, (11, 6, 7)).astype(np.uint16)
    for k, (lo, hi) in enumerate(((0, 4), (4, 5), (5, 11))):
        (tmp_path / f"part{k * 6}.tif").write_bytes(tiff.to_bytes(a[lo:hi], "lzw"))
    got = S.read_tiff_stack(spark, str(tmp_path), (4, 4, 4), multipage=True)
    assert (S.collect_volume(got, a.shape, "u2") == a).all() and got.count() == 3 * 2 * 2
    with pytest.raises(Exception, match="multipage=True"):
        S.read_tiff_stack(spark, str(tmp_path), (4, 4, 4)).count()


def test_single_files_of_any_size(spark, tmp_path):
    a = np.random.default_rng(9).integers(0, 5000, (5, 20, 30)).astype(np.uint16)
    blocks = blocks_of(spark, a, (2, 20, 16))
    for most, big in ((1 << 20, False), (100, True)):
        S.write_single(blocks, str(tmp_path / "a.tif"), a.shape, "uint16", most)
        data = (tmp_path / "a.tif").read_bytes()
        assert np.array_equal(tiff.from_bytes(data), a) and (data[2] == 43) == big
