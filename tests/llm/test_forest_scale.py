"""Forests whose nodes are split in several passes, ids that repeat, components of any size."""

import numpy as np
import pytest

from stratavox.llm import forest


def test_nodes_are_split_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF_ROWS", 20)
    monkeypatch.setattr(forest, "CELL_ROWS", 16)
    monkeypatch.setattr(forest, "SAMPLE_ROWS", 64)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 24))
    near = base[:200] + 0.1 * rng.normal(size=(200, 24))
    rows = [(i, int(i % 7 == 0), v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    want = forest.brute_force(rows)
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in forest.near_duplicates(table).collect()}
    assert set(got) == set(want) and sum(n for n, _ in want.values()) > 200
    assert all(got[i][0] <= n for i, (n, _) in want.items())  # none below the threshold
    assert sum(n for n, _ in got.values()) >= 0.995 * sum(n for n, _ in want.values())


def test_large_groups_of_near_copies_cannot_be_split(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF_ROWS", 30)
    monkeypatch.setattr(forest, "CELL_ROWS", 32)
    rng = np.random.default_rng(6)
    center = rng.normal(size=24)
    rows = [(i, 1, (center + 0.05 * rng.normal(size=24)).tolist()) for i in range(300)] + [(300 + i, 1, rng.normal(size=24).tolist()) for i in range(60)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    want = forest.brute_force(rows)
    assert sum(n for n, _ in got.values()) == pytest.approx(sum(n for n, _ in want.values()), rel=1e-3)
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}


def test_ids_that_repeat_are_vectors_of_their_own(spark):
    rows = [(1, 0, [1.0, 0.0, 0.0]), (1, 0, [0.0, 1.0, 0.0]), (2, 0, [1.0, 0.05, 0.0]), (3, 0, [1.0, 0.0, 0.05]), (4, 0, [0.0, 2e200, 1e199]), (4, 0, [1e300, 1e300, 1e300])]
    out = forest.near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, key int, leaf int"))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (4, 1, 1)]
