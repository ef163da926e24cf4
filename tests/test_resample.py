import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from stratavox import queries as Q
from stratavox.functions import kernels as K
from stratavox.operators import resample
from stratavox.operators import volumes as V
from stratavox.sources.volumes import collect_volume
from test_volumes import blocks_of


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 60])
def test_coefficients_against_the_matrix(n):
    f = np.random.default_rng(n).normal(size=(n, 5))
    for m in (1, 2, 5, n, 2 * n + 1):
        at = K.sample_places(n, m)
        assert np.allclose(K.resample_window(f, 0, n, at), K.zoom_matrix(n, m) @ f, atol=1e-12)


@pytest.mark.parametrize("chunk, slab", [((7, 40, 9), (5, 16, 8)), ((100, 100, 100), (100, 100, 100)), ((3, 3, 3), (64, 2, 64))])
def test_slabs_give_what_one_block_gives(spark, chunk, slab):
    a = np.random.default_rng(2).integers(0, 5000, (11, 100, 18)).astype(np.uint16)
    factors = (1.0, 0.6, 1.7)
    want = K.zoom(a, factors)
    got = resample.zoom(blocks_of(spark, a, chunk), a.shape, factors, slab)
    assert want.shape == tuple(resample.zoomed(n, f) for n, f in zip(a.shape, factors, strict=True))
    assert np.abs(collect_volume(got, want.shape, "f8") - want).max() < 1e-9
    most = got.agg({"ny": "max", "nx": "max"}).first()
    assert most["max(ny)"] <= slab[1] and most["max(nx)"] <= slab[2]


def test_missing_blocks_are_an_error(spark):
    a = np.ones((4, 8, 8), np.uint16)
    with pytest.raises(Exception, match="missing blocks"):
        resample.zoom(blocks_of(spark, a, (4, 4, 4)).where("cy = 0"), a.shape, (1.0, 0.5, 1.0)).count()


def test_nothing_is_resampled_where_all_samples_stay(spark):
    blocks = blocks_of(spark, np.ones((4, 8, 8), np.uint16), (4, 4, 4))
    assert resample.zoom(blocks, (4, 8, 8), (1.0, 1.0, 1.0)) is blocks
    assert V.blocks_to_voxels(blocks).count() == 256


def test_absent_chunks_are_zeros_as_in_sql(spark, small, tmp_path):
    """Chunks missing inside a block row, at the end, and a gap wider than a spline reads."""
    for t in oracle.TABLES:
        if t != "embeddings":
            (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    given = spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 141 AND vec_id NOT BETWEEN 20 AND 60 OR vec_id >= 490")
    given.withColumn("vec_id", F.expr("IF(vec_id < 490, vec_id, vec_id + 64 * 50)")).write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("zoom_volume", "image_affine"):
        got, want = oracle.both(spark, str(tmp_path), Q.QUERIES[name], Q.ORACLE_SQL[name])
        assert got == want


def test_gaps_are_zeros(spark):
    a = np.random.default_rng(3).integers(0, 5000, (12, 8, 8)).astype(np.uint16)
    a[4:8, :4] = 0
    blocks = blocks_of(spark, a, (4, 4, 4)).where("NOT (cz = 1 AND cy = 0)")
    got = resample.zoom(V.fill_blocks(blocks, (4, 4, 4), a.shape, 12), a.shape, (0.5, 0.5, 1.0), (4, 4, 4), gaps=True)
    assert np.abs(collect_volume(got, (6, 4, 8), "f8") - K.zoom(a, (0.5, 0.5, 1.0))).max() < 1e-9


def test_sums_add_no_bias_to_the_weights_in_sql():
    """Against sums without rounding over the double weights of the SQL version."""
    n, m = 100, 50
    f = np.random.default_rng(5).integers(900, 1100, (n, 60)).astype(np.float64)
    weights = [{} for _ in range(m)]
    for i, j, w in duckdb.sql(f"WITH {Q._SPLINE('s', n, m)} SELECT i, j, w FROM s").fetchall():
        weights[i][j] = w
    want = np.array([[math.fsum(w * f[j, k] for j, w in row.items()) for k in range(f.shape[1])] for row in weights])
    off = K.resample_window(f, 0, n, K.sample_places(n, m)) / want - 1
    assert abs(off.mean()) < 1e-16 and np.abs(off).max() < 1e-15


def test_a_voxel_whose_last_digit_turns_on_the_weights_of_sql(spark, small, tmp_path):
    """Voxel (9, 4, 5) lies within 1e-15 of the value at which v_micro changes; SQL on 1 to 8 threads finds the lower one."""
    for t in oracle.TABLES:
        if t != "embeddings":
            (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    e = np.random.default_rng(1198).normal(0, 0.01, (512, 64)).astype(np.float32)
    spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(e)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got, want = oracle.both(spark, str(tmp_path), Q.QUERIES["zoom_volume"], Q.ORACLE_SQL["zoom_volume"])
    assert len(got[1]) == 16 * 24 * 24 and got == want
