import numpy as np
import pytest

from stratavox.functions import kernels as K
from stratavox.operators import labels, objects, raster, stencils
from stratavox.operators import volumes as V
from stratavox.plans.schema import COORDS
from stratavox.sources.volumes import collect_volume


def blocks_of(spark, a, chunk):
    rows = []
    for c in np.ndindex(*[-(-n // k) for n, k in zip(a.shape, chunk, strict=True)]):
        lo = [i * k for i, k in zip(c, chunk, strict=True)]
        part = a[tuple(slice(o, o + k) for o, k in zip(lo, chunk, strict=True))]
        rows.append(tuple(V.as_row(dict(zip(("cz", "cy", "cx", "z0", "y0", "x0"), [*c, *lo], strict=True)), part).values()))
    return spark.createDataFrame(rows, V.BLOCK)


def voxels_of(spark, a, value="v"):
    rows = [(*map(int, i), int(a[i])) for i in np.ndindex(*a.shape)]
    return spark.createDataFrame(rows, f"z long, y long, x long, {value} long")


def dense(df, shape, value="v"):
    out = np.zeros(shape, np.int64)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = r[value]
    return out


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(7).integers(0, 100, (6, 7, 9)).astype(np.uint16)


def test_layouts_round_trip(spark, cube):
    b = blocks_of(spark, cube, (4, 4, 4))
    assert (dense(V.blocks_to_voxels(b), cube.shape) == cube).all()
    again = V.voxels_to_blocks(V.blocks_to_voxels(b, sparse=True), (3, 5, 2), cube.shape)
    assert (collect_volume(again, cube.shape, "uint16") == cube).all()
    assert (collect_volume(V.rechunk(b, (5, 2, 9)), cube.shape, "uint16") == cube).all()
    assert V.blocks_to_voxels(b, sparse=True).count() == (cube > 0).sum()


@pytest.mark.parametrize("radius", [1])
def test_halo_makes_the_chunk_grid_invisible(spark, cube, radius):
    want = K.dilate(cube, radius)
    for chunk in ((3, 5, 5), (6, 7, 9), (3, 3, 7)):
        got = collect_volume(stencils.dilate(blocks_of(spark, cube, chunk), radius, halo=radius), cube.shape, "uint16")
        assert (got == want).all()


def test_without_halo_each_chunk_stands_alone(spark, cube):
    got = collect_volume(stencils.tophat(blocks_of(spark, cube, (3, 4, 5)), 1), cube.shape, "uint16")
    assert (got[:3, :4, :5] == K.tophat(cube[:3, :4, :5], 1)).all()


def test_slices_follow_python(spark):
    a = np.arange(6).reshape(1, 1, 6)
    vox = voxels_of(spark, a)
    for s in (slice(1, None, 2), slice(-3, None), slice(0, -1, 3), slice(4, 2)):
        got = sorted((r["x"], r["v"]) for r in V.crop(vox, (slice(None), slice(None), s), (1, 1, 6)).collect())
        assert got == list(enumerate(a[0, 0, s].tolist()))
    assert sorted(r["v"] for r in V.stride(vox, (1, 1, 3)).collect()) == [0, 3]
    with pytest.raises(ValueError):
        V.crop(vox, (slice(None), slice(None), slice(None, None, -1)), (1, 1, 6))


def test_scalar_filters(spark):
    one = spark.createDataFrame([(v,) for v in (0, 1, 5, 10, 11, 99, 100, 5000, 5001)], "v long")
    assert [r[0] for r in one.select(V.size_between(5, 10)).collect()] == [0, 0, 5, 10, 0, 0, 0, 0, 0]
    assert [r[0] for r in one.select(V.size_between(None, None)).collect()] == [0, 1, 5, 10, 11, 99, 100, 5000, 5001]
    assert [r[0] for r in one.select(V.map_bounds(100, 0, 5000, 5000)).collect()] == [0, 0, 0, 0, 0, 0, 100, 5000, 5000]
    assert one.select(V.wrap(one["v"] + 300, 8)).first()[0] == 44


def test_pruned_blocks_meet_the_box(spark, cube):
    kept = V.prune_blocks(blocks_of(spark, cube, (3, 4, 5)), (0, 4, 0), (3, 7, 5))
    assert [(r["cz"], r["cy"], r["cx"]) for r in kept.collect()] == [(0, 1, 0)]


def test_channels_round_and_clip(spark):
    a = spark.createDataFrame([(0, 0, 0, 0.5), (0, 0, 1, 1.5), (0, 0, 2, -3.0)], "z long, y long, x long, v double")
    b = spark.createDataFrame([(0, 0, 0, 70000.0)], "z long, y long, x long, v double")
    got = {r["x"]: list(r["channels"]) for r in V.stack_channels(a, b).collect()}
    assert got == {0: [0, 65535], 1: [2, 0], 2: [0, 0]}


# ---- labels and objects -----------------------------------------------------------------------------------------------


def label_table(spark, mask, chunk):
    grid = [-(-n // k) for n, k in zip(mask.shape, chunk, strict=True)]
    return labels.labelled_voxels(labels.label_blocks(blocks_of(spark, mask.astype(np.uint8), chunk), chunk, grid))


def test_labels_across_a_chunk_face_by_hand(spark):
    mask = np.array([[[1, 0, 1, 1, 1, 1, 0, 1]]])
    assert labels.label_budget((1, 1, 4)) == 3
    lab = label_table(spark, mask, (1, 1, 4))
    assert [r["label"] for r in lab.orderBy("x").collect()] == [1, 2, 2, 4, 4, 5]
    assert [(r["lo"], r["hi"]) for r in labels.boundary_pairs(lab, (1, 1, 4)).collect()] == [(2, 4)]
    assert [r["size"] for r in labels.component_volumes(lab, (1, 1, 4)).orderBy("x").collect()] == [1, 4, 4, 4, 4, 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_component_sizes_do_not_depend_on_chunks(spark, seed):
    mask = np.random.default_rng(seed).random((6, 6, 7)) < 0.45
    want = K.label_volumes(K.label6(mask))
    for chunk in ((2, 3, 4), (6, 6, 7), (1, 1, 1)):
        vol = labels.component_volumes(label_table(spark, mask, chunk), chunk)
        assert (dense(vol, mask.shape, "size") == want).all()


def test_scatter_and_map_values(spark):
    mask = np.array([[[1, 0, 1, 1, 1, 1, 0, 1]]])
    blocks = labels.label_blocks(blocks_of(spark, mask.astype(np.uint8), (1, 1, 4)), (1, 1, 4), (1, 1, 2))
    table = spark.createDataFrame([(2, 7), (4, 7)], "label long, size long")
    assert collect_volume(labels.scatter_volumes(blocks, table), (1, 1, 8), "int64").ravel().tolist() == [0, 0, 7, 7, 7, 7, 0, 0]


def test_extraction_by_hand(spark):
    def vox(values, name):
        return spark.createDataFrame([(0, 0, 1, 0, 0, 6 + i, v) for i, v in enumerate(values)], f"cz int, cy int, cx int, z long, y long, x long, {name} long")

    raw = vox([10, 20, 30, 0, 7, 8], "v")
    maxima = vox([0, 4, 0, 0, 5, 5], "label")
    regions = vox([4, 4, 4, 0, 5, 5], "label").join(vox([3, 3, 3, 0, 2, 2], "size"), ["cz", "cy", "cx", *COORDS])
    got = {r["label"]: (r["x"], r["volume"], r["sum_intensity"]) for r in objects.extract_cells(raw, maxima, regions.where("label > 0")).collect()}
    assert got == {4: (7, 3, 60.0), 5: (10, 2, 15.0)}


def test_points_and_spheres_by_hand(spark):
    pts = spark.createDataFrame([(0.0, 0.0, x) for x in (0.5, 1.5, 2.4, 3.6, -0.4)], "z double, y double, x double")
    row = lambda df: [next((r["n"] for r in df.collect() if r["x"] == x), 0) for x in range(4)]
    assert row(raster.count_points(pts, (1, 1, 4))) == [2, 0, 2, 0]
    assert row(raster.mark_points(pts, (1, 1, 4))) == [1, 0, 1, 0]
    many = spark.createDataFrame([(0.0, 0.0, 1.0)] * 300, "z double, y double, x double")
    assert raster.count_points(many, (1, 1, 4), bits=8).first()["n"] == 44
    one = spark.createDataFrame([(20.0, 20.0, 20.0)], "z double, y double, x double")
    assert raster.count_spheres(one, (40, 40, 40), 3).count() == 123 and raster.mark_spheres(one, (40, 40, 40), 3).count() == 93
    assert raster.count_spheres(one, (60, 60, 60), 9).count() == len(K.ball(9))
    assert raster.mark_spheres(many, (1, 1, 4), 2).agg({"n": "max"}).first()[0] == 1


def test_few_rows_of_a_large_batch_are_python_objects_at_once():
    import tracemalloc

    one = V.as_row(dict.fromkeys(("cz", "cy", "cx", "z0", "y0", "x0"), 1), np.ones((4, 4, 4), np.int32))
    batch = V.to_batch([one] * 10_000)
    tracemalloc.start()
    n = sum(1 for r in V.block_rows(iter([batch])) if V.as_array(r).shape == (4, 4, 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10_000 and peak < 2 << 20
    assert list(V.block_rows(iter([batch.slice(0, 0), batch.slice(0, 300)]))) == [one] * 300
