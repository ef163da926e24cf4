from pathlib import Path

import numpy as np
import pytest

from stratavox.operators import ontology
from stratavox.plans import engine as E
from stratavox.plans.catalog import Catalog
from stratavox.plans.config import Config
from test_engine import CONFIG, image
from test_volumes import blocks_of

CELLS = "label long, id long, count long, volume long, sum_intensity double"
TREE = {"msg": [{"id": 1, "name": "root", "acronym": "r", "children": [{"id": 2, "name": "a", "acronym": "a", "parent_structure_id": 1, "children": []}, {"id": 3, "name": "b", "acronym": "b", "parent_structure_id": 1, "children": []}]}]}


def make(spark, root, name, rows):
    Path(f"{root}/{name}").mkdir(parents=True)
    Config.from_dict(CONFIG).write(f"{root}/{name}/config.yaml")
    c = Catalog(spark, f"{root}/{name}")
    c.write("onto", ontology.flatten_document(spark, TREE))
    c.write("cells", spark.createDataFrame(rows, CELLS))
    return c


@pytest.fixture
def specimens(spark, tmp_path):
    root = str(tmp_path / "all")
    make(spark, root, "s1", [(1, 2, 1, 10, 5.0), (2, 3, 1, 20, 1.0), (3, -1, 1, 7, 1.0)])
    make(spark, root, "s2 late+", [(1, 3, 1, 40, 8.0)])
    make(spark, root, "s10", [])
    return root


def test_one_report_of_all_specimens(spark, specimens, tmp_path):
    got = {(r["specimen"], r["id"]): (r["name"], r["count"], r["volume"], r["iov"]) for r in E.combine_batch(spark, specimens, str(tmp_path / "out")).collect()}
    assert got["s1", 1] == ("root", 2, 30, 0.2) and got["s1", -1] == ("invalid", 1, 7, 1 / 7)
    assert got["s2 late+", 3] == ("b", 1, 40, 0.2) and got["s2 late+", 2] == ("a", 0, 0, None) and got["s10", 1] == ("root", 0, 0, None)
    assert len(got) == 3 * 3 + 1
    assert spark.read.schema(E.QUARANTINE).parquet(f"{tmp_path}/out/quarantine").count() == 0


def test_broken_specimens_leave_the_others_complete(spark, specimens, tmp_path):
    out = str(tmp_path / "out")
    want = sorted(map(tuple, E.combine_batch(spark, specimens, out).where("specimen <> 's10'").collect()), key=str)
    make(spark, specimens, "bad config", [])
    Path(f"{specimens}/bad config/config.yaml").write_text("chunks: 7\n")
    partial = make(spark, specimens, "partial", [(1, 2, 1, 1, 1.0)])
    Path(f"{partial.path('cells')}/_SUCCESS").unlink()
    rot = make(spark, specimens, "rot", [(1, 2, 1, 1, 1.0)])
    for f in Path(rot.path("cells")).glob("*"):
        if f.suffix in (".parquet", ".crc"):
            f.write_bytes(b"no parquet") if f.suffix == ".parquet" else f.unlink()
    lacking = make(spark, specimens, "lacking", [])
    lacking.write("cells", spark.range(3))
    make(spark, specimens, "s10b", [])
    Config.from_dict(CONFIG | {"reference": {"ref_version": "another"}}).write(f"{specimens}/s10b/config.yaml")
    again = E.combine_batch(spark, specimens, out)
    assert sorted(map(tuple, again.where("specimen <> 's10'").collect()), key=str) == want
    why = {r["specimen"]: r["reason"] for r in spark.read.parquet(f"{out}/quarantine").collect()}
    assert set(why) == {"bad config", "partial", "rot", "lacking", "s10b"}
    assert "not complete" in why["partial"] and "can't be read" in why["rot"] and "columns lacking" in why["lacking"] and "another atlas" in why["s10b"]
    with pytest.raises(FileNotFoundError):
        E.combine_batch(spark, str(tmp_path / "out"), out)


def test_steps_of_all_projects(spark, tmp_path):
    root = str(tmp_path / "all")
    for name in ("p1", "p2", "p3"):
        Path(f"{root}/{name}").mkdir(parents=True)
        Config.from_dict(CONFIG).write(f"{root}/{name}/config.yaml")
        if name != "p2":  # no raw volume: its first step fails
            Catalog(spark, f"{root}/{name}").write("raw", blocks_of(spark, image(), (12, 12, 12)))
    steps = ["tophat_filter", "dog_filter"]
    failed = E.run_projects(spark, root, steps).collect()
    assert [(r["specimen"], r["stage"]) for r in failed] == [("p2", "tophat_filter")] and "raw" in failed[0]["reason"]
    for name in ("p1", "p3"):
        e = E.Engine(spark, f"{root}/{name}", Config.from_dict(CONFIG))
        assert not e.catalog.missing(["bgrm", "dog"])
        noted = {r["table"]: r for r in e.log_table().collect()}
        n = e.read("raw").count()
        assert {(t, r["step"], r["rows"]) for t, r in noted.items()} == {("bgrm", "tophat_filter", n), ("dog", "dog_filter", n)}
        assert all(r["bytes"] == 2 * np.prod(e.shape()) and r["seconds"] > 0 for r in noted.values())
