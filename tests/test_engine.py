import numpy as np
import pytest

from stratavox.operators.mapping import Affine
from stratavox.plans import engine as E
from stratavox.plans.catalog import Catalog, discover_projects
from stratavox.plans.config import Config
from stratavox.streaming import live
from test_regions import TREE, onto
from test_volumes import blocks_of, voxels_of

CONFIG = {
    "chunks": {"z": 12, "y": 12, "x": 12},
    "tuning_trim": {"z": {"start": 0, "stop": 12}, "y": {"start": 0, "stop": 24}, "x": {"start": 12, "stop": 24}},
    "registration": {"downsample_rough": [2, 2, 2], "downsample_fine": [1.0, 0.5, 0.5], "lower_bound": 10, "upper_bound": 4000, "upper_bound_mapto": 4000},
    "cell_counting": {"tophat_radius": 3, "dog_sigma1": 1, "dog_sigma2": 4, "large_gauss_radius": 9, "threshd_value": 20, "maxima_radius": 2},
    "visual_check": {"cellcount_trim": {"z": {"start": 0, "stop": 6}}},
}
PLACES = [(5, 5, 5), (5, 17, 6), (17, 6, 18), (18, 18, 18), (6, 6, 17), (11, 18, 5)]


def image():
    """Blobs on a dim background; the last one sits on a chunk face."""
    z, y, x = np.meshgrid(*[np.arange(24)] * 3, indexing="ij")
    a = np.full((24, 24, 24), 20.0)
    for p in PLACES:
        a += 900 * np.exp(-((z - p[0]) ** 2 + (y - p[1]) ** 2 + (x - p[2]) ** 2) / 2.0)
    return a.astype(np.uint16)


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("projects") / "p1")
    e = E.Engine(spark, root, Config.from_dict(CONFIG), transforms=[Affine(np.eye(3), np.zeros(3), np.zeros(3))])
    e.catalog.write("raw", blocks_of(spark, image(), (12, 12, 12)))
    e.set_ontology(onto(spark, TREE))
    e.catalog.write("annot", voxels_of(spark, np.random.default_rng(0).choice([2, 3, 4], (12, 6, 6))))
    e.config.write(f"{root}/config.yaml")
    return e


def test_whole_run(project):
    ran = project.run()
    assert ran == [*E.STEPS]
    cells = project.read("cells_raw").collect()
    found = {(r["z"], r["y"], r["x"]) for r in cells}
    assert set(PLACES[:5]) <= found and len({r["label"] for r in cells}) == len(cells)
    assert all(r["volume"] >= 1 and r["sum_intensity"] > 0 and r["count"] == 1 for r in cells)
    agg = {r["id"]: r for r in project.read("cells_agg").collect()}
    assert agg[1]["count"] == len(cells) == sum(r["count"] for i, r in agg.items() if i in (2, 4)) + project.read("cells").where("id = 3").count()
    assert project.run() == []  # complete steps are skipped
    assert project.run(["group_cells"], overwrite=True) == ["group_cells"]
    assert open(__import__("glob").glob(E.cells2csv(project) + "/*.csv")[0]).readline().startswith("id,name")


def test_checks_after_a_run(project):
    project.run()
    n = project.read("cells_raw").count()
    assert E.coords2points_raw(project).agg({"n": "sum"}).first()[0] == n
    assert E.coords2heatmap_raw(project).count() > n
    assert 0 < E.coords2points_trfm(project).count() <= n and E.coords2heatmap_trfm(project).count() > 0
    assert E.combine_cellc(project).count() == 6 * 24 * 24
    project.catalog.write("regresult", project.read("bounded"))
    assert len(E.combine_reg(project).first()["channels"]) == 3
    same = voxels_of(project.spark, np.random.default_rng(0).choice([2, 3, 4], (12, 6, 6)))
    E.prepare_reference(project, same, same, (12, 6, 6))
    assert E.combine_heatmap_trfm(project).count() == 12 * 6 * 6


def test_tuning_twin_gives_the_same_places(project):
    project.run()
    project.make_tuning()
    twin = E.Engine(project.spark, project.root, project.config, tuning=True, transforms=project.transforms)
    twin.run([s for s in E.STEPS if not s.startswith("reg_") and s not in ("transform_coords", "cell_mapping", "group_cells")])
    crop = {(r["z"], r["y"], r["x"]) for r in twin.read("cells_raw").collect()}
    whole = {(r["z"], r["y"], r["x"]) for r in project.read("cells_raw").where("z < 12 and x >= 12").collect()}
    assert crop == whole and crop
    assert twin.catalog.path("raw") != project.catalog.path("raw")


def test_rechunk_and_missing_inputs(spark, tmp_path):
    e = E.Engine(spark, str(tmp_path / "p"), Config.from_dict(CONFIG))
    with pytest.raises(FileNotFoundError):
        e.run(["tophat_filter"])
    e.catalog.write("raw", blocks_of(spark, image(), (8, 24, 6)))
    assert E.rechunk_raw(e) and not E.rechunk_raw(e)
    assert e.grid() == (2, 2, 2) and e.shape() == (24, 24, 24)
    assert e.catalog.drop("raw") and not e.catalog.drop("raw")


def test_projects_combine(project, tmp_path):
    project.run()
    root = project.root.rsplit("/", 1)[0]
    other = E.Engine(project.spark, f"{root}/p10", project.config)
    other.catalog.write("cells_agg", project.read("cells_agg"))
    other.config.write(f"{root}/p10/config.yaml")
    assert discover_projects(project.spark, root) == ["p1", "p10"]
    wide = E.combine_projects(project.spark, root, str(tmp_path / "out"))
    one = {r["id"]: r for r in wide.collect()}
    assert one[1]["p1__count"] == one[1]["p10__count"] > 0 and one[0]["name"] == "universe"
    changed = Config.from_dict(CONFIG | {"reference": {"ref_version": "another"}})
    changed.write(f"{root}/p10/config.yaml")
    with pytest.raises(ValueError):
        E.combine_projects(project.spark, root, str(tmp_path / "out"))
    E.update_config(f"{root}/p10/config.yaml", f"{root}/p1/config.yaml")
    with pytest.raises(FileNotFoundError):
        E.combine_projects(project.spark, str(tmp_path), str(tmp_path / "out"))


def test_clean_keeps_raw_and_results(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "p"))
    for n in ("raw", "bgrm", "cells_agg"):
        c.write(n, spark.range(1))
    Catalog(spark, c.root, True).write("dog", spark.range(1))
    c.clean()
    assert c.exists("raw") and c.exists("cells_agg") and not c.exists("bgrm") and not Catalog(spark, c.root, True).exists("dog")


def test_arriving_chunks(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame([(i % 2, 1, 10 * i, float(i))], "id long, count long, volume long, sum_intensity double").write.mode("append").parquet(src)
    stream = live.stream_table(spark, src, files_per_trigger=1)
    live.append_cells(stream, lambda b: b.where("volume > 0"), out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    got = {r["id"]: r["volume"] for r in live.run_to_end(live.region_totals(live.stream_table(spark, src)), "arriving").collect()}
    assert got == {0: 20, 1: 10}
    timed = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 05:00:00", "a"), ("2024-01-02 01:00:00", "b")], "t string, k string").selectExpr("to_timestamp(t) t", "k")
    assert live.windowed_counts(timed, "t", "k").count() == 2


def test_project_object(spark, tmp_path):
    import json

    from stratavox.plans.pipeline import Pipeline
    from stratavox.sources import tiff

    root, atlas, stack = tmp_path / "p", tmp_path / "atlas", tmp_path / "stack"
    for d in (root, stack, atlas / "reference", atlas / "annotation", atlas / "region_mapping"):
        d.mkdir(parents=True)
    for i, page in enumerate(image()):
        (stack / f"z{i}.tif").write_bytes(tiff.to_bytes(page))
    annot = np.random.default_rng(0).choice([2, 3, 4], (12, 6, 6)).astype(np.uint32)
    (atlas / "reference" / "average_template_25.tif").write_bytes(tiff.to_bytes(annot.astype(np.uint16)))
    (atlas / "annotation" / "ccf_2016_25.tif").write_bytes(tiff.to_bytes(annot))
    nodes = [{"id": i, "name": f"r{i}", "acronym": f"A{i}", "parent_structure_id": p, "children": []} for i, p in TREE]
    nodes[2]["children"], nodes[0]["children"] = [nodes[3]], [nodes[1], nodes[2]]
    (atlas / "region_mapping" / "ABA_annotations.json").write_text(json.dumps({"msg": [nodes[0]]}))
    Config.from_dict(CONFIG | {"reference": {"atlas_dir": str(atlas)}}).write(f"{root}/config.yaml")
    p = Pipeline(str(root), spark=spark, transforms=[Affine(np.eye(3), np.zeros(3), np.zeros(3))])
    p.tiff2zarr(str(stack))
    p.reg_ref_prepare()
    p.run()
    p.coords2points_raw()
    assert set(PLACES[:5]) <= {(r["z"], r["y"], r["x"]) for r in p.catalog.read("cells_raw").collect()}
    assert p.catalog.read("cells_agg").count() == 4 and p.catalog.exists("points_raw")
    p.tophat_filter(overwrite=True)
    p.clean_proj()
    assert not p.catalog.exists("bgrm") and p.catalog.exists("raw") and p.catalog.exists("cells")
    with pytest.raises(NotImplementedError):
        p.reg_elastix()
