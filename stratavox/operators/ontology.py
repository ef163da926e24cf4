"""The region tree: flatten, closure, children, document form, and joins with it."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.plans.schema import ANNOTATIONS, INVALID, NO_LABEL, ONTOLOGY, UNIVERSE
from stratavox.runtime import read_text

_FIELDS = [f.split() for f in ONTOLOGY.split(", ")]


def flatten_document(spark: SparkSession, document: Mapping) -> DataFrame:
    """Rows of a nested ontology document {"msg": [node, ...]}, each node with `children`, in pre-order.

    Spark has no recursive schema, and an ontology has thousands of nodes at most, so the walk is on the driver.
    Missing fields are null; ids are 64-bit integers, not floating point.
    """
    rows, stack = [], list(reversed(document["msg"]))
    while stack:
        node = stack.pop()
        rows.append([None if node.get(n) is None else (int(float(node[n])) if t == "long" else str(node[n])) for n, t in _FIELDS])
        stack.extend(reversed(node.get("children") or []))
    return spark.createDataFrame(rows, ONTOLOGY)


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """An ontology JSON file, in any store that Spark reads."""
    return flatten_document(spark, json.loads(read_text(spark, path)))


def to_document(onto: DataFrame) -> dict:
    """The nested document of an ontology table: the inverse of flatten_document. Children keep graph order, then id."""
    rows = [r.asDict() for r in onto.collect()]
    nodes = {r["id"]: {k: r.get(k) for k, _ in _FIELDS} | {"children": []} for r in rows}
    key = lambda n: (n["graph_order"] is None, n["graph_order"] or 0, n["id"])
    roots = []
    for n in sorted(nodes.values(), key=key):
        parent = nodes.get(n["parent_structure_id"])
        (roots if parent is None else parent["children"]).append(n)
    return {"msg": roots}


def check_tree(onto: DataFrame) -> None:
    """Refuse an ontology with repeated ids, parents that don't exist, or cycles."""
    rows = [(r["id"], r["parent_structure_id"]) for r in onto.select("id", "parent_structure_id").collect()]
    up = dict(rows)
    if len(up) < len(rows):
        raise ValueError("ontology ids repeat")
    if orphans := sorted({p for _, p in rows if p is not None and p not in up}):
        raise ValueError(f"parents that are no regions: {orphans[:5]}")
    done: set[int] = set()
    for i in up:
        path: list[int] = []
        on_path: set[int] = set()
        while i is not None and i not in done:
            if i in on_path:
                raise ValueError(f"region {i} is its own ancestor")
            on_path.add(i)
            path.append(i)
            i = up[i]
        done.update(path)


def with_parents(onto: DataFrame) -> DataFrame:
    """parent_acronym by a self join."""
    parent = onto.select(F.col("id").alias("parent_structure_id"), F.col("acronym").alias("parent_acronym"))
    return onto.join(parent, "parent_structure_id", "left")


def with_children(onto: DataFrame) -> DataFrame:
    """children: sorted ids of the direct children, an empty array for leaves."""
    kids = onto.where("parent_structure_id is not null").groupBy(F.col("parent_structure_id").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("children"))
    return onto.join(kids, "id", "left").withColumn("children", F.coalesce("children", F.array().cast("array<bigint>")))


def closure(onto: DataFrame, max_depth: int = 100) -> DataFrame:
    """(ancestor, id, depth): every region with each of its ancestors and itself, by a recursive query."""
    spark = onto.sparkSession
    return spark.sql(
        f"""
        WITH RECURSIVE up(ancestor, id, depth) MAX RECURSION LEVEL {max_depth} AS (
          SELECT id, id, 0 FROM {{onto}}
          UNION ALL
          SELECT o.parent_structure_id, u.id, u.depth + 1 FROM up u JOIN {{onto}} o ON u.ancestor = o.id WHERE o.parent_structure_id IS NOT NULL
        ) SELECT ancestor, id, depth FROM up
        """,
        onto=onto.select("id", "parent_structure_id"),
    )


def with_paths(onto: DataFrame) -> DataFrame:
    """path: ids from the root to the region."""
    lines = closure(onto).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("k"), "ancestor"))), lambda s: s["ancestor"]).alias("path"))
    return onto.join(lines, "id")


def roll_up(own: DataFrame, onto: DataFrame, sums: tuple[str, ...], by: str | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Each region's own value plus those of all its descendants; ids that the ontology lacks keep their own.

    Two groupings, both combined on the map side: by region, then by ancestor. Regions without any value get 0. With `by`, a
    column such as the specimen, all its `groups` are rolled up at once, and each has a row for every region.
    """
    key = ["id"] if by is None else ["id", by]
    zero = {c: F.coalesce(c, F.lit(0)) for c in sums}
    lines = closure(onto)
    # an id without an ancestor, not even itself, is outside the ontology
    total = own.join(lines, "id", "left").groupBy(F.coalesce("ancestor", "id").alias("id"), *key[1:]).agg(*[F.sum(c).alias(c) for c in sums])
    every = onto.select("id") if by is None else onto.select("id", F.explode(F.array(*[F.lit(g) for g in groups]).cast("array<string>")).alias(by))
    return every.join(total, key, "full").select(*key, *sums).withColumns(zero)


def special_name(id_col: str = "id", name_col: str = "name") -> Column:
    """-1 is invalid, 0 the universe, a region without a name has no label; in this order."""
    return F.when(F.col(id_col) == INVALID[0], INVALID[1]).when(F.col(id_col) == UNIVERSE[0], UNIVERSE[1]).otherwise(F.coalesce(name_col, F.lit(NO_LABEL)))


def with_regions(cells: DataFrame, onto: DataFrame) -> DataFrame:
    """Cells with the columns of their region, special regions named."""
    return cells.join(onto, "id", "left").withColumn("name", special_name())


def group_cells(cells: DataFrame, onto: DataFrame, by: str | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Measures per region with roll-up, region columns, and iov = sum_intensity / volume (null if there is no volume).

    Cells without an id are left out; ids outside the ontology, -1 and 0 among them, keep rows of their own. With `by`, the
    same for each of the `groups` of that column, from one scan and one roll-up.
    """
    key = ["id"] if by is None else ["id", by]
    own = cells.where("id is not null").groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("count", "volume", "sum_intensity")])
    total = roll_up(own, onto, ("count", "volume", "sum_intensity"), by, groups)
    named = total.join(with_parents(onto).select("id", *ANNOTATIONS), "id", "left").withColumn("name", special_name())
    return named.select(*key, *ANNOTATIONS, "count", "volume", "sum_intensity", F.try_divide(F.col("sum_intensity").cast("double"), F.col("volume").cast("double")).alias("iov"))


def outer_with_ontology(values: DataFrame, onto: DataFrame) -> DataFrame:
    """Full outer join: regions without values, and values without a region, both stay."""
    return with_parents(onto).select("id", *ANNOTATIONS).join(values, "id", "full")
