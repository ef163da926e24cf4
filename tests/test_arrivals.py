import numpy as np
import pytest

from stratavox.operators import labels
from stratavox.runtime import settle
from stratavox.streaming import components as C
from test_volumes import blocks_of


@pytest.mark.parametrize("seed", [0, 1])
def test_any_order_gives_what_all_chunks_give(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    chunk = (3, 4, 3)
    a = (rng.random((9, 12, 9)) < (0.45, 0.3)[seed]).astype(np.uint8)
    blocks = settle(labels.label_blocks(blocks_of(spark, a, chunk), chunk, (3, 3, 3)), "labels")
    want = {tuple(r) for r in labels.component_table(labels.labelled_voxels(blocks), chunk).collect()}
    assert want == {tuple(r) for r in labels.block_component_table(blocks, chunk).collect()}
    part = rng.integers(0, 4, 27)
    part[rng.integers(0, 27)] = 9  # a batch of one chunk
    for epoch, p in enumerate(sorted(set(part.tolist()))):
        mine = blocks.where("(cz * 3 + cy) * 3 + cx IN (" + ", ".join(map(str, np.flatnonzero(part == p))) + ")")
        C.merge_batch(mine, epoch, str(tmp_path), chunk)
        if epoch == 1:
            C.merge_batch(mine, epoch, str(tmp_path), chunk)  # a batch that runs again
    assert {tuple(r) for r in C.component_table(spark, str(tmp_path)).collect()} == want


def test_stream_of_chunks_and_nothing(spark, tmp_path):
    a = np.ones((4, 4, 8), np.uint8)
    blocks = blocks_of(spark, a, (2, 4, 4))
    for k in range(4):
        blocks.where(f"cz * 2 + cx = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(blocks.schema).parquet(f"{tmp_path}/in")
        C.merge_arrivals(stream, lambda b: labels.label_blocks(b, (2, 4, 4), (2, 1, 2)), f"{tmp_path}/state", f"{tmp_path}/ck", (2, 4, 4)).awaitTermination()
        rows = C.component_table(spark, f"{tmp_path}/state").collect()
        assert len(rows) == k + 1 and {r["size"] for r in rows} == ({32 * (k + 1)} if k != 2 else {96})
    assert C.component_table(spark, f"{tmp_path}/none").count() == 0
