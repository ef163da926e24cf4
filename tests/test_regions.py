import json

import numpy as np
import pytest

from stratavox.operators import combine, mapping, ontology
from stratavox.plans.schema import ONTOLOGY


def onto(spark, rows):
    return spark.createDataFrame([(i, None, None, f"A{i}", f"region {i}", "fff", None, None, None, p) for i, p in rows], ONTOLOGY)


TREE = [(1, None), (2, 1), (3, 1), (4, 3)]


def test_roll_up_by_hand(spark):
    own = spark.createDataFrame([(2, 2), (3, 1), (4, 3), (99, 7)], "id long, count long")
    got = {r["id"]: r["count"] for r in ontology.roll_up(own, onto(spark, TREE), ("count",)).collect()}
    assert got == {1: 6, 2: 2, 3: 4, 4: 3, 99: 7}
    cells = spark.createDataFrame([(2, 1, 10, 5.0), (4, 1, 0, 1.0), (None, 1, 1, 1.0), (-1, 1, 2, 3.0), (99, 1, 4, 2.0)], "id long, count long, volume long, sum_intensity double")
    agg = {r["id"]: r for r in ontology.group_cells(cells, onto(spark, TREE)).collect()}
    assert agg[1]["count"] == 2 and agg[1]["iov"] == 0.6 and agg[4]["iov"] is None and agg[3]["parent_acronym"] == "A1"
    assert (agg[-1]["name"], agg[99]["name"], agg[99]["acronym"]) == ("invalid", "no_label", None)


def test_special_names(spark):
    cells = spark.createDataFrame([(-1,), (0,), (9999,), (2,), (None,)], "id long")
    got = {r["id"]: r["name"] for r in ontology.with_regions(cells, onto(spark, TREE)).collect()}
    assert got == {-1: "invalid", 0: "universe", 9999: "no_label", 2: "region 2", None: "no_label"}


def test_parents_children_paths(spark):
    o = onto(spark, TREE)
    assert {r["id"]: r["parent_acronym"] for r in ontology.with_parents(o).collect()} == {1: None, 2: "A1", 3: "A1", 4: "A3"}
    assert {r["id"]: r["children"] for r in ontology.with_children(o).collect()} == {1: [2, 3], 2: [], 3: [4], 4: []}
    assert {r["id"]: r["path"] for r in ontology.with_paths(o).collect()} == {1: [1], 2: [1, 2], 3: [1, 3], 4: [1, 3, 4]}


def test_document_round_trip(spark, tmp_path):
    doc = {"msg": [{"id": 1, "name": "r", "acronym": "R", "parent_structure_id": None, "children": [{"id": 2.0, "name": "c", "parent_structure_id": 1.0, "graph_order": 1}, {"id": 3, "name": "d", "parent_structure_id": 1, "graph_order": 0, "children": []}]}]}
    path = tmp_path / "onto.json"
    path.write_text(json.dumps(doc))
    table = ontology.read_ontology(spark, str(path))
    assert [r["id"] for r in table.collect()] == [1, 2, 3]
    again = ontology.to_document(table)
    assert [c["id"] for c in again["msg"][0]["children"]] == [3, 2]
    assert sorted(map(tuple, ontology.flatten_document(spark, again).collect()), key=str) == sorted(map(tuple, table.collect()), key=str)


@pytest.mark.parametrize("rows", [[(1, 1)], [(1, 2), (2, 1)], [(1, 7)], [(1, None), (1, None)]])
def test_trees_are_checked(spark, rows):
    with pytest.raises(ValueError):
        ontology.check_tree(onto(spark, rows))
    ontology.check_tree(onto(spark, TREE))


def test_scaling_by_hand(spark):
    p = spark.createDataFrame([(300, 600, 1200)], "z long, y long, x long")
    assert tuple(mapping.scale_coords(p, (3, 6, 6), (1, 0.6, 0.6), (10, None, 5)).first()) == (90.0, 60.0, 115.0)


def test_parameter_files_and_chain(spark):
    affine = mapping.parse_parameters('// made by hand\n(Transform "AffineTransform")\n(TransformParameters 2 0 0 0 1 0 0 0 1 10 20 30)\n(CenterOfRotationPoint 1 1 1)\n')
    assert np.allclose(affine(np.array([[1.0, 2, 3], [2, 2, 3]])), [[11, 22, 33], [13, 22, 33]])
    n = 8 * 8 * 8
    shift = " ".join(["0.5"] * n + ["0"] * n + ["-1"] * n)
    spline = mapping.parse_parameters(f'(Transform "BSplineTransform")\n(TransformParameters {shift})\n(GridSize 8 8 8)\n(GridSpacing 2 2 2)\n(GridOrigin -4 -4 -4)\n')
    assert np.allclose(spline(np.array([[1.0, 2, 3]])), [[1.5, 2, 2]])  # equal coefficients move every point alike
    assert np.allclose(spline(np.array([[100.0, 2, 3]])), [[100, 2, 3]])  # beyond the grid
    pts = spark.createDataFrame([(3.0, 2.0, 1.0, 7), (None, 2.0, 1.0, 8)], "z double, y double, x double, k int")
    only = mapping.transform_points(pts, [affine])
    both = mapping.transform_points(pts, [affine, spline])
    assert tuple(only.first())[4:] == (33.0, 22.0, 11.0)
    assert both.collect()[1]["z_trfm"] is None and both.columns == only.columns
    near = spark.createDataFrame([(-29.0, -18.0, -4.0)], "z double, y double, x double")
    assert np.allclose(tuple(mapping.transform_points(near, [affine, spline]).first())[3:], tuple(spline(affine(np.array([[-4.0, -18, -29]])))[0][::-1]))
    with pytest.raises(ValueError):
        mapping.parse_parameters('(Transform "EulerTransform")\n(TransformParameters 1)\n')


def test_point_files(spark):
    assert mapping.points_text(iter([(3.0, 2.0, 1.0)])) == "index\n1\n1.0 2.0 3.0\n"
    text = spark.createDataFrame([("Point 0 ; OutputPoint = [ 1.5 2.0 -3 ] ; Deformation = [ 0 0 0 ]",), ("noise",)], "value string")
    assert [tuple(r) for r in mapping.parse_output_points(text).collect()] == [(-3.0, 2.0, 1.5)]


def test_region_lookup_rounds_half_to_even_and_marks_the_outside(spark):
    atlas = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 2, 6)], "z long, y long, x long, id long")
    pts = spark.createDataFrame([(0.0, 0.0, 0.5), (0.0, 0.0, 1.5), (0.0, 0.0, 1.0), (0.0, 0.0, 2.6), (0.0, 0.0, -0.6), (None, 0.0, 0.0)], "z double, y double, x double")
    got = sorted(((r["x"], r["z"] is None), r["id"]) for r in mapping.region_at(pts, atlas, (1, 1, 3), ("z", "y", "x")).collect())
    assert dict(got) == {(0.5, False): 5, (1.5, False): 6, (1.0, False): 0, (2.6, False): -1, (-0.6, False): -1, (0.0, True): -1}


def test_image_transform(spark):
    grid = spark.createDataFrame([(0, 0, x) for x in range(3)], "z long, y long, x long")
    image = spark.createDataFrame([(0, 0, 1, 9), (0, 0, 2, 8)], "z long, y long, x long, v long")
    move = mapping.Affine(np.eye(3), np.array([1.0, 0, 0]), np.zeros(3))
    assert [r["v"] for r in mapping.resample_voxels(grid, image, [move]).orderBy("x").collect()] == [9, 8, 0]


def test_specimens_by_hand(spark):
    o = onto(spark, [(1, None)])
    s1, s2 = (spark.createDataFrame(v, "id long, count long") for v in ([(1, 5)], [(1, 2), (99, 1)]))
    wide = {r["id"]: r for r in combine.wide_table(spark, o, {"s1": s1, "s2": s2}, ("count",)).collect()}
    assert set(wide) == {-1, 0, 1, 99}
    assert (wide[-1]["name"], wide[0]["name"], wide[1]["name"], wide[99]["name"]) == ("invalid", "universe", "region 1", None)
    assert [(r["s1__count"], r["s2__count"]) for r in (wide[1], wide[99], wide[0])] == [(5, 2), (None, 1), (None, None)]
