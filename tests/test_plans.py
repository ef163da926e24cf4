"""The shapes of plans that matter at scale."""

import re

import pytest

from stratavox import queries as Q
from stratavox.operators import labels, objects, resample
from stratavox.operators import volumes as V
from stratavox.plans import fixtures as X


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_chunk_local_work_has_no_shuffle(spark, small):
    for name in ("threshold_mask", "crop", "reorient", "tophat_r1", "detection_front", "label_in_chunk", "scale_coords", "bspline_points"):
        assert "Exchange" not in plan(Q.QUERIES[name](spark, small)), name


def test_filters_and_columns_reach_the_scan(spark, small, tmp_path):
    blocks = str(tmp_path / "blocks")
    X.volume(spark, small).write.parquet(blocks)
    p = plan(V.prune_blocks(spark.read.parquet(blocks), (0, 0, 0), (4, 4, 4)))
    assert re.search(r"PushedFilters: \[\w*\(?z0", p) or re.search(r"PushedFilters: \[IsNotNull\(\w+\)", p)
    p = plan(X.cells(spark, small))
    assert "l_extendedprice" in p and "l_discount" not in p and "o_totalprice" not in p


def test_neighbours_meet_by_equality(spark, small):
    vox = X.voxels(spark, small).withColumnRenamed("v", "label")
    p = plan(labels.neighbour_edges(vox, X.CHUNK_SHAPE))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_no_query_multiplies_tables(spark, small):
    for name in ("region_rollup", "atlas_rollup", "specimen_pivot", "raster_spheres_closed", "grid_lookup", "cells_extract"):
        p = plan(Q.QUERIES[name](spark, small))
        assert "NestedLoop" not in p and "Cartesian" not in p, name


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as with tables that are too large for it
    yield
    spark.conf.set(key, before)


def exchanged(p: str) -> list[str]:
    """What rows are dealt by, for each shuffle of a plan."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", p)


def test_objects_and_strides_stay_in_their_blocks(spark, small, no_broadcast):
    raw = X.volume(spark, small)
    lab = labels.label_blocks(raw, X.CHUNK_SHAPE, (1 << 20, X.GRID, X.GRID))
    for df in (objects.threshold_objects(raw, X.FOREGROUND, X.CHUNK_SHAPE, (1, X.GRID, X.GRID)), labels.block_label_sizes(lab), labels.block_face_voxels(lab), V.stride_blocks(raw, (3, 6, 6))):
        assert "Exchange" not in plan(df)
    keys = exchanged(plan(objects.extract_from_blocks(raw, lab, lab, lab)))
    assert keys and all(re.sub(r"#\d+", "", k) == "cz, cy, cx" for k in keys)  # blocks meet by chunk, no voxel is shuffled


def test_all_specimens_come_from_one_scan(spark, small):
    p = plan(Q.QUERIES["specimen_pivot"](spark, small))
    assert len(re.findall(r"FileScan parquet [^\n]*l_returnflag", p)) == 1


def test_image_transforms_meet_by_chunk(spark, small, no_broadcast):
    moving = V.voxels_to_blocks(X.voxels(spark, small).where("z < 28"), (8, 8, 8), (28, 32, 32), "float64")
    p = plan(resample.transform_volume(moving, (28, 32, 32), (10, 10, 10), [], (5, 5, 5)))
    assert "NestedLoop" not in p and "Cartesian" not in p
    keys = {re.sub(r"#\d+L?", "", k) for k in exchanged(p)}
    assert {"cz, cy, cx", "tz, ty, tx"} <= keys and not keys & {"z, y, x", "_z, _y, _x"}


def python_steps(p: str) -> int:
    """The most Python steps between two exchanges, scans or joins of a plan: processes that a task holds at once."""
    most = run = 0
    for line in p.split("\n"):
        if re.search(r"MapInArrow|FlatMapGroupsInArrow", line):
            run += 1
            most = max(most, run)
        elif re.search(r"Exchange|Scan|Join", line):
            run = 0
    return most


def test_a_task_of_the_detection_holds_one_python_process(spark, small, monkeypatch):
    written = []
    settle = Q.settle
    monkeypatch.setattr(Q, "settle", lambda df, name: written.append((name, python_steps(plan(df)))) or settle(df, name))
    last = python_steps(plan(Q.QUERIES["detect_cells"](spark, small)))
    assert dict(written) == dict.fromkeys(("raw", "labels", "kept", "maxima", "regions", "sizes"), 1) and last == 1
    assert python_steps(plan(Q.QUERIES["label_in_chunk"](spark, small))) == 3


def test_kernels_go_into_the_pass_that_labels_or_scatters(spark, small):
    grid = (1 << 20, X.GRID, X.GRID)
    raw = X.volume(spark, small).localCheckpoint()
    mask = V.map_blocks(raw, lambda b: (b >= X.FOREGROUND).astype("u1")).localCheckpoint()
    rows = lambda df: sorted(map(tuple, df.collect()))
    lab = labels.label_blocks(mask, X.CHUNK_SHAPE, grid)
    assert rows(labels.label_blocks(raw, X.CHUNK_SHAPE, grid, lambda b: b >= X.FOREGROUND)) == rows(lab)
    both = V.map_aligned(lambda b, m: ((b % 2 == 0) & (m > 0)).astype("u1"), raw, mask)
    assert rows(labels.label_blocks(raw, X.CHUNK_SHAPE, grid, lambda b, m: (b % 2 == 0) & (m > 0), [mask])) == rows(labels.label_blocks(both, X.CHUNK_SHAPE, grid))
    table = labels.block_label_sizes(lab)
    few = lambda b: (b > 2).astype("u1")
    assert rows(labels.scatter_volumes(lab, table, value="n", kernel=few)) == rows(V.map_blocks(labels.scatter_volumes(lab, table, value="n"), few))
