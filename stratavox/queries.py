"""Every operator of the library as a query on the driver's tables, with the same query in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.functions import kernels as K
from stratavox.operators import combine, labels, mapping, objects, ontology, raster, resample, stencils
from stratavox.operators import volumes as V
from stratavox.plans import fixtures as X
from stratavox.plans.schema import COORDS
from stratavox.runtime import settle, shared_dir
from stratavox.sources import arrays
from stratavox.sources import volumes as S
from stratavox.streaming import components as merging
from stratavox.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- common table expressions of the SQL versions ---------------------------------------------------------------------

VOX = """vox AS (
  SELECT vec_id // 64 AS cz, vec_id // 8 % 8 AS cy, vec_id % 8 AS cx, vec_id,
    4 * (vec_id // 64) + i // 16 AS z, 4 * (vec_id // 8 % 8) + i // 4 % 4 AS y, 4 * (vec_id % 8) + i % 4 AS x,
    CAST(floor((CAST(e AS DOUBLE) + 1) * 1000) AS BIGINT) AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS i FROM embeddings)
)"""
FG = f"{VOX}, fg AS (SELECT * FROM vox WHERE v >= {X.FOREGROUND})"
_STEPS = "(VALUES (0,0,1),(0,1,0),(1,0,0),(0,0,-1),(0,-1,0),(-1,0,0)) d(dz,dy,dx)"
#: lab: labelled foreground, number in the chunk (by first voxel) plus vec_id times the budget of 33
LAB = f"""{FG}, step AS (
  SELECT a.vec_id, a.z, a.y, a.x, b.z AS z2, b.y AS y2, b.x AS x2 FROM fg a CROSS JOIN {_STEPS}
  JOIN fg b ON b.z = a.z + d.dz AND b.y = a.y + d.dy AND b.x = a.x + d.dx AND b.vec_id = a.vec_id
), reach(vec_id, z, y, x, z2, y2, x2) AS (
  SELECT vec_id, z, y, x, z, y, x FROM fg UNION
  SELECT r.vec_id, r.z, r.y, r.x, s.z2, s.y2, s.x2 FROM reach r JOIN step s ON s.z = r.z2 AND s.y = r.y2 AND s.x = r.x2
), first_voxel AS (
  SELECT vec_id, z, y, x, min((z2 * 1000 + y2) * 1000 + x2) AS f FROM reach GROUP BY ALL
), lab AS (
  SELECT v.*, vec_id * 33 + dense_rank() OVER (PARTITION BY vec_id ORDER BY f) AS label FROM first_voxel JOIN fg v USING (vec_id, z, y, x)
)"""
TOUCH = f"""{LAB}, touch AS (
  SELECT a.label AS a, b.label AS b FROM lab a CROSS JOIN (VALUES (0,0,1),(0,1,0),(1,0,0)) d(dz,dy,dx)
  JOIN lab b ON b.z = a.z + d.dz AND b.y = a.y + d.dy AND b.x = a.x + d.dx AND b.vec_id <> a.vec_id
)"""
COMP = f"""{TOUCH}, both_ways AS (SELECT a, b FROM touch UNION SELECT b, a FROM touch), linked(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT l.a, w.b FROM linked l JOIN both_ways w ON w.a = l.b
), root AS (
  SELECT label, least(label, coalesce(min(b), label)) AS root, n FROM (SELECT label, count(*) AS n FROM lab GROUP BY label) LEFT JOIN linked ON a = label GROUP BY label, n
), comp AS (SELECT label, root, n, CAST(sum(n) OVER (PARTITION BY root) AS BIGINT) AS size FROM root)"""
ONTO = """onto AS (
  SELECT CAST(1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_structure_id, 'root' AS name, 'ROO' AS acronym
  UNION ALL SELECT 10 + r_regionkey, 1, r_name, upper(substr(r_name, 1, 3)) FROM region
  UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, n_name, upper(substr(n_name, 1, 3)) FROM nation
), up(ancestor, id, depth) AS (
  SELECT id, id, 0 FROM onto UNION ALL SELECT o.parent_structure_id, u.id, u.depth + 1 FROM up u JOIN onto o ON u.ancestor = o.id WHERE o.parent_structure_id IS NOT NULL
)"""
CELLS = f"""{ONTO}, cell AS (
  SELECT 100 + c_nationkey AS id, l_returnflag AS specimen, CAST(l_quantity AS DECIMAL(18,2)) AS volume, CAST(l_extendedprice AS DECIMAL(18,2)) AS sum_intensity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""
POINTS = """pts AS (
  SELECT (l_orderkey % 330) / 10.0::DOUBLE - 0.5::DOUBLE AS z, (l_partkey % 330) / 10.0::DOUBLE - 0.5::DOUBLE AS y, (l_suppkey % 33) + l_linenumber * 0.25::DOUBLE AS x,
    l_orderkey AS key, l_partkey AS id, l_linenumber AS ord FROM lineitem
), grid AS (
  SELECT CAST(round_even(z, 0) AS BIGINT) AS z, CAST(round_even(y, 0) AS BIGINT) AS y, CAST(round_even(x, 0) AS BIGINT) AS x, key, id, ord FROM pts
)"""
_INSIDE = "z BETWEEN 0 AND 31 AND y BETWEEN 0 AND 31 AND x BETWEEN 0 AND 31"
ATLAS = """atlas AS (
  SELECT z, y, x, 100 + ((z // 8) * 16 + (y // 8) * 4 + x // 8) % 25 AS id FROM (SELECT i // 1024 AS z, i // 32 % 32 AS y, i % 32 AS x FROM range(32768) t(i)) WHERE (z + y + x) % 7 <> 0
)"""


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _doubles(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# ---- regions --------------------------------------------------------------------------------------------------------

_ROLLUP = f"""WITH RECURSIVE {CELLS}, own AS (
  SELECT id, count(*) AS count, sum(volume) AS volume, sum(sum_intensity) AS sum_intensity FROM cell GROUP BY id
), total AS (
  SELECT o.id, coalesce(CAST(sum(w.count) AS BIGINT), 0) AS count, coalesce(CAST(sum(w.volume) AS DOUBLE), 0) AS volume, coalesce(CAST(sum(w.sum_intensity) AS DOUBLE), 0) AS sum_intensity
  FROM onto o LEFT JOIN up ON up.ancestor = o.id LEFT JOIN own w ON w.id = up.id GROUP BY o.id
)
SELECT t.id, o.name, o.acronym, o.parent_structure_id, p.acronym AS parent_acronym, t.count, t.volume, t.sum_intensity, CASE WHEN t.volume <> 0 THEN t.sum_intensity / t.volume END AS iov
FROM total t JOIN onto o USING (id) LEFT JOIN onto p ON p.id = o.parent_structure_id"""


@query(_ROLLUP)
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every region with those of all its descendants, from joined tables to the ratio."""
    agg = ontology.group_cells(X.cells(spark, sf_dir), X.ontology(spark, sf_dir))
    return _doubles(agg.drop("color_hex_triplet"), "volume", "sum_intensity")


@query(f"WITH RECURSIVE {CELLS} SELECT CASE WHEN o.parent_structure_id IS NULL THEN 1 WHEN c.id IS NULL THEN o.parent_structure_id ELSE c.id END AS id, count(*) AS count, CAST(sum(volume) AS DOUBLE) AS volume FROM cell c JOIN onto o USING (id) GROUP BY ROLLUP (o.parent_structure_id, c.id)")
def region_rollup_fixed_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sums by SQL ROLLUP, which knows a fixed depth only: a cross-check."""
    both = X.cells(spark, sf_dir).join(X.ontology(spark, sf_dir).select("id", "parent_structure_id"), "id")
    rolled = both.rollup("parent_structure_id", "id").agg(F.sum("count").alias("count"), F.sum("volume").cast("double").alias("volume"))
    name = F.when(F.col("parent_structure_id").isNull(), 1).when(F.col("id").isNull(), F.col("parent_structure_id")).otherwise(F.col("id"))
    return rolled.select(name.alias("id"), "count", "volume")


@query(f"WITH RECURSIVE {ONTO} SELECT ancestor, id, CAST(depth AS BIGINT) AS depth FROM up")
def ontology_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.closure(X.ontology(spark, sf_dir)).withColumn("depth", F.col("depth").cast("long"))


@query(f"WITH RECURSIVE {ONTO} SELECT c.id, c.name, c.parent_structure_id, p.acronym AS parent_acronym FROM onto c LEFT JOIN onto p ON c.parent_structure_id = p.id")
def ontology_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.with_parents(X.ontology(spark, sf_dir)).select("id", "name", "parent_structure_id", "parent_acronym")


@query(f"WITH RECURSIVE {ONTO} SELECT p.id, CASE WHEN count(c.id) = 0 THEN '' ELSE string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.id) END AS children FROM onto p LEFT JOIN onto c ON c.parent_structure_id = p.id GROUP BY p.id")
def ontology_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    kids = ontology.with_children(X.ontology(spark, sf_dir))
    return kids.select("id", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"))


@query(f"WITH RECURSIVE {ONTO} SELECT id, string_agg(CAST(ancestor AS VARCHAR), '/' ORDER BY depth DESC) AS path FROM up GROUP BY id")
def ontology_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.with_paths(X.ontology(spark, sf_dir)).select("id", F.array_join(F.transform("path", lambda c: c.cast("string")), "/").alias("path"))


@query(f"WITH RECURSIVE {ONTO} SELECT id, name, acronym, parent_structure_id FROM onto")
def ontology_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table to nested document and back."""
    return ontology.flatten_document(spark, ontology.to_document(X.ontology(spark, sf_dir))).select("id", "name", "acronym", "parent_structure_id")


@query(f"WITH RECURSIVE {CELLS} SELECT c.id, name, acronym, parent_structure_id, count(*) AS count FROM cell c LEFT JOIN onto o USING (id) GROUP BY ALL")
def cells_with_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = ontology.with_regions(X.cells(spark, sf_dir), X.ontology(spark, sf_dir))
    return named.groupBy("id", "name", "acronym", "parent_structure_id").agg(F.sum("count").alias("count"))


_SPECIAL = "SELECT c_custkey AS cell, CASE WHEN c_custkey % 4 = 0 THEN -1 WHEN c_custkey % 4 = 1 THEN 0 WHEN c_custkey % 4 = 2 THEN 9999 ELSE 100 + c_nationkey END AS id FROM customer"


@query(f"WITH RECURSIVE {ONTO} SELECT cell, s.id, CASE WHEN s.id = -1 THEN 'invalid' WHEN s.id = 0 THEN 'universe' ELSE coalesce(name, 'no_label') END AS name FROM ({_SPECIAL}) s LEFT JOIN onto o ON o.id = s.id")
def special_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = X.table(spark, sf_dir, "customer").selectExpr("c_custkey AS cell", "CASE WHEN c_custkey % 4 = 0 THEN -1 WHEN c_custkey % 4 = 1 THEN 0 WHEN c_custkey % 4 = 2 THEN 9999 ELSE 100 + c_nationkey END AS id")
    return ontology.with_regions(made.withColumn("id", F.col("id").cast("long")), X.ontology(spark, sf_dir)).select("cell", "id", "name")


_OUTSIDE = "SELECT CASE WHEN n_nationkey % 3 = 0 THEN 9000 + n_nationkey ELSE 100 + n_nationkey END AS id, n_nationkey AS value FROM nation"


@query(f"WITH RECURSIVE {ONTO} SELECT coalesce(o.id, w.id) AS id, o.name, o.acronym, w.value FROM onto o FULL JOIN ({_OUTSIDE}) w ON o.id = w.id")
def agg_outer_unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = X.table(spark, sf_dir, "nation").selectExpr("CAST(CASE WHEN n_nationkey % 3 = 0 THEN 9000 + n_nationkey ELSE 100 + n_nationkey END AS BIGINT) AS id", "n_nationkey AS value")
    return ontology.outer_with_ontology(values, X.ontology(spark, sf_dir)).select("id", "name", "acronym", "value")


# ---- projections and filters on voxels ----------------------------------------------------------------------------------


@query(f"WITH {VOX} SELECT cz, cy, cx, z, y, x, v FROM vox")
def voxels_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.blocks_to_voxels(X.volume(spark, sf_dir))


@query(f"WITH {VOX} SELECT z // 8 AS cz, y // 6 AS cy, x // 5 AS cx, z, y, x, v FROM vox")
def rechunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume on another chunk grid; voxels of chunks that are absent don't appear."""
    new = V.blocks_to_voxels(V.rechunk(X.volume(spark, sf_dir), (8, 6, 5)))
    return new.where("v <> 0")


@query(f"WITH {VOX} SELECT z, y, x, v FROM vox")
def blocks_of_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = V.voxels_to_blocks(X.voxels(spark, sf_dir), (8, 8, 8), (1 << 20, 32, 32))
    return V.blocks_to_voxels(blocks, sparse=True).select(*COORDS, "v")


@query(f"WITH {VOX} SELECT z, y, x, CAST(v >= {X.FOREGROUND} AS INTEGER) AS m FROM vox")
def threshold_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.voxels(spark, sf_dir).select(*COORDS, V.threshold(X.FOREGROUND).alias("m"))


@query(f"WITH {VOX} SELECT z, y, x, CASE WHEN v < 900 THEN 0 WHEN v > 1200 THEN 1300 ELSE v END AS v FROM vox")
def intensity_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.voxels(spark, sf_dir).select(*COORDS, V.map_bounds(900, 0, 1200, 1300).alias("v"))


@query(f"WITH {VOX} SELECT z, y, x, least(greatest(v, 900), 1200) AS v FROM vox")
def intensity_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.voxels(spark, sf_dir).select(*COORDS, V.clamp(900, 1200).alias("v"))


@query(f"WITH {VOX} SELECT z, y, x, CAST(v > avg(CASE WHEN v > 0 THEN v::DOUBLE END) OVER w + 0.5 * stddev_pop(CASE WHEN v > 0 THEN v::DOUBLE END) OVER w AS INTEGER) AS m FROM vox WINDOW w AS (PARTITION BY vec_id)")
def adaptive_mean_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.blocks_to_voxels(stencils.mean_threshold(X.volume(spark, sf_dir), 0.5)).select(*COORDS, F.col("v").alias("m"))


@query(f"WITH {VOX} SELECT z, y, x, CAST(v > avg(v::DOUBLE) OVER (PARTITION BY vec_id) AS INTEGER) AS m FROM vox")
def adaptive_mean_threshold_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.mean_threshold(X.voxels(spark, sf_dir))


@query(f"WITH {VOX} SELECT z - 4 AS z, (y - 1) // 2 AS y, x AS x, v FROM vox WHERE z BETWEEN 4 AND 19 AND y >= 1 AND (y - 1) % 2 = 0 AND x < 24")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.crop(X.voxels(spark, sf_dir), (slice(4, 20), slice(1, None, 2), slice(0, -8)), (1 << 20, 32, 32)).select(*COORDS, "v")


@query(f"WITH {VOX} SELECT z // 3 AS z, y // 6 AS y, x // 6 AS x, v FROM vox WHERE z % 3 = 0 AND y % 6 = 0 AND x % 6 = 0")
def stride_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stride(X.voxels(spark, sf_dir), (3, 6, 6)).select(*COORDS, "v")


@query(f"WITH {VOX} SELECT z // 3 AS z, y // 6 AS y, x // 5 AS x, v FROM vox WHERE z % 3 = 0 AND y % 6 = 0 AND x % 5 = 0")
def stride_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same inside the blocks, with steps that don't divide a block."""
    return V.blocks_to_voxels(V.stride_blocks(X.volume(spark, sf_dir), (3, 6, 5))).select(*COORDS, "v")


@query(f"WITH {VOX} SELECT 31 - y AS z, z AS y, x, v FROM vox")
def reorient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reorient(X.voxels(spark, sf_dir), (-2, 1, 3), (1 << 20, 32, 32)).select(*COORDS, "v")


@query(f"WITH {VOX} SELECT z, y, x, greatest(v - 1000, 0) AS v FROM vox")
def relu_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.voxels(spark, sf_dir).select(*COORDS, V.relu(F.col("v") - 1000).alias("v"))


@query(f"WITH {VOX} SELECT z, y, x, CAST(trunc((v - 1000) / 7.0::DOUBLE) AS BIGINT) AS cut, v % 256 AS wrapped FROM vox")
def integer_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = ((F.col("v") - 1000).cast("double") / 7.0).cast("long")
    return X.voxels(spark, sf_dir).select(*COORDS, cut.alias("cut"), V.wrap(F.col("v"), 8).alias("wrapped"))


@query(f"WITH {VOX} SELECT v, count(*) AS n FROM vox GROUP BY v")
def voxel_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.voxels(spark, sf_dir).groupBy("v").agg(F.count("*").alias("n"))


@query(f"WITH {VOX} SELECT cz, cy, cx, count(*) AS n, min(v) AS low, max(v) AS high, CAST(sum(v) AS BIGINT) AS total FROM vox GROUP BY ALL")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.voxels(spark, sf_dir).groupBy("cz", "cy", "cx").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total"))


@query(f"WITH {VOX} SELECT z, y, x, CASE WHEN v >= {X.FOREGROUND} THEN v ELSE 0 END AS v FROM vox")
def mask_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = X.volume(spark, sf_dir)
    return V.blocks_to_voxels(stencils.mask_blocks(raw, stencils.threshold(raw, X.FOREGROUND))).select(*COORDS, "v")


@query(f"WITH {FG} SELECT z, y, x, v FROM vox WHERE EXISTS (SELECT 1 FROM fg WHERE fg.z = vox.z AND fg.y = vox.y AND fg.x = vox.x)")
def semi_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    vox = X.voxels(spark, sf_dir)
    return V.masked(vox, vox.where(F.col("v") >= X.FOREGROUND)).select(*COORDS, "v")


@query(f"WITH RECURSIVE {LAB} SELECT z, y, x, v FROM vox WHERE NOT EXISTS (SELECT 1 FROM lab WHERE lab.z = vox.z AND lab.y = vox.y AND lab.x = vox.x)")
def anti_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.voxels(spark, sf_dir).join(_labels(spark, sf_dir).select(*COORDS), [*COORDS], "left_anti").select(*COORDS, "v")


@query(f"WITH {VOX} SELECT z, y, x, CAST(least(greatest(v, 0), 65535) AS INTEGER) AS c0, CAST(v >= {X.FOREGROUND} AS INTEGER) AS c1, CAST(least(v * 60, 65535) AS INTEGER) AS c2 FROM vox")
def stack_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    vox = X.voxels(spark, sf_dir)
    out = V.stack_channels(vox, vox.withColumn("v", V.threshold(X.FOREGROUND)), vox.withColumn("v", F.col("v") * 60))
    return out.select(*COORDS, *[F.col("channels")[i].alias(f"c{i}") for i in range(3)])


# ---- stencils -------------------------------------------------------------------------------------------------------

#: neighbours of a voxel inside its chunk, mirrored at the chunk's edges
_FOLD = lambda c: f"(CASE WHEN a.{c} % 4 + d.d{c} < 0 THEN a.{c} WHEN a.{c} % 4 + d.d{c} > 3 THEN a.{c} ELSE a.{c} + d.d{c} END)"
_NEAR = f"JOIN vox b ON b.z = {_FOLD('z')} AND b.y = {_FOLD('y')} AND b.x = {_FOLD('x')}"
_BALL1 = "(VALUES (0,0,0),(0,0,1),(0,0,-1),(0,1,0),(0,-1,0),(1,0,0),(-1,0,0)) d(dz,dy,dx)"
_CUBE = "(SELECT a.i AS dz, b.i AS dy, c.i AS dx FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i)) d"


@query("SELECT a.i AS dz, b.i AS dy, c.i AS dx FROM range(-3, 4) a(i), range(-3, 4) b(i), range(-3, 4) c(i) WHERE a.i * a.i + b.i * b.i + c.i * c.i <= 9")
def footprint_r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.footprint(spark, 3)


@query("SELECT DISTINCT r.l_linenumber AS radius, a.i AS dz, b.i AS dy, c.i AS dx FROM (SELECT DISTINCT l_linenumber FROM lineitem) r, range(-9, 10) a(i), range(-9, 10) b(i), range(-9, 10) c(i) WHERE a.i * a.i + b.i * b.i + c.i * c.i <= r.l_linenumber * r.l_linenumber")
def footprint_of_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balls of all radii of a table."""
    return stencils.footprints(X.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("radius")).distinct())


@query(f"WITH {VOX} SELECT a.z, a.y, a.x, min(b.v) AS v FROM vox a CROSS JOIN {_BALL1} {_NEAR} GROUP BY ALL")
def erode_r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.blocks_to_voxels(stencils.erode(X.volume(spark, sf_dir), 1)).select(*COORDS, "v")


@query(f"WITH {VOX} SELECT a.z, a.y, a.x, max(b.v) AS v FROM vox a CROSS JOIN {_BALL1} {_NEAR} GROUP BY ALL")
def dilate_r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.blocks_to_voxels(stencils.dilate(X.volume(spark, sf_dir), 1)).select(*COORDS, "v")


@query(
    f"WITH {VOX}, low AS (SELECT a.z, a.y, a.x, min(b.v) AS v FROM vox a CROSS JOIN {_BALL1} {_NEAR} GROUP BY ALL), "
    f"opened AS (SELECT a.z, a.y, a.x, max(b.v) AS v FROM low a CROSS JOIN {_BALL1} {_NEAR.replace('JOIN vox b', 'JOIN low b')} GROUP BY ALL) "
    "SELECT z, y, x, greatest(vox.v - opened.v, 0) AS v FROM vox JOIN opened USING (z, y, x)"
)
def tophat_r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.blocks_to_voxels(stencils.tophat(X.volume(spark, sf_dir), 1)).select(*COORDS, "v")


@query(f"WITH {VOX} SELECT a.z, a.y, a.x, max(b.v) AS v FROM vox a CROSS JOIN {_BALL1} JOIN vox b ON b.z = a.z + d.dz AND b.y = a.y + d.dy AND b.x = a.x + d.dx GROUP BY ALL")
def dilate_halo_r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a halo the result doesn't depend on the chunk grid."""
    return V.blocks_to_voxels(stencils.dilate(X.volume(spark, sf_dir), 1, halo=1)).select(*COORDS, "v")


@query(f"WITH {VOX} SELECT a.z, a.y, a.x, CAST(sum(b.v * (2 - abs(dz)) * (2 - abs(dy)) * (2 - abs(dx))) AS BIGINT) AS v FROM vox a CROSS JOIN {_CUBE} {_NEAR} GROUP BY ALL")
def blur_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A separable kernel 1 2 1 in whole numbers."""
    return V.blocks_to_voxels(stencils.convolve(X.volume(spark, sf_dir), np.array([1, 2, 1]))).select(*COORDS, "v")


@query(f"WITH {VOX} SELECT a.z, a.y, a.x, greatest(CAST(sum(b.v * (27 * (2 - abs(dz)) * (2 - abs(dy)) * (2 - abs(dx)) - 64)) AS BIGINT), 0) AS v FROM vox a CROSS JOIN {_CUBE} {_NEAR} GROUP BY ALL")
def dog_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A difference of a narrow and a wide kernel in whole numbers, cut at 0."""
    narrow, wide = np.array([1, 2, 1]), np.array([1, 1, 1])
    diff = V.map_blocks(X.volume(spark, sf_dir), lambda b: np.maximum(27 * K.convolve_axes(b.astype(np.int64), narrow) - 64 * K.convolve_axes(b.astype(np.int64), wide), 0))
    return V.blocks_to_voxels(diff).select(*COORDS, "v")


@query(f"WITH {VOX} SELECT a.z, a.y, a.x FROM vox a CROSS JOIN {_BALL1} {_NEAR} GROUP BY a.z, a.y, a.x, a.v HAVING a.v = max(b.v)")
def local_maxima_r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.blocks_to_voxels(stencils.local_maxima(X.volume(spark, sf_dir), 1), sparse=True).select(*COORDS)


@query(f"WITH {VOX} SELECT a.z, a.y, a.x FROM vox a CROSS JOIN {_BALL1} {_NEAR} WHERE a.v >= {X.FOREGROUND} GROUP BY a.z, a.y, a.x, a.v HAVING a.v = max(b.v)")
def local_maxima_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = X.volume(spark, sf_dir)
    return V.blocks_to_voxels(stencils.local_maxima(raw, 1, stencils.threshold(raw, X.FOREGROUND)), sparse=True).select(*COORDS)


_FRAME = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_SIGNAL = "signal AS (SELECT user_id, ts, event_id, CAST(round(value * 100) AS BIGINT) AS v FROM events)"


@query(f"WITH {_SIGNAL}, low AS (SELECT *, min(v) OVER {_FRAME} AS low FROM signal) SELECT event_id, greatest(v - max(low) OVER {_FRAME}, 0) AS tophat FROM low")
def tophat_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.tophat_1d(X.signal(spark, sf_dir), 2, "user_id", ("ts", "event_id")).select("event_id", "tophat")


@query(f"WITH {_SIGNAL} SELECT event_id, v FROM (SELECT *, max(v) OVER {_FRAME} AS m FROM signal) WHERE v = m")
def maxima_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.maxima_1d(X.signal(spark, sf_dir), 2, "user_id", ("ts", "event_id")).select("event_id", "v")


#: rows of a Gaussian of width s along an axis of a chunk: weight of voxel j for voxel i, mirrored at both ends as often as need be
_GAUSS = lambda name, s: f"""{name} AS (  -- width {s}
  SELECT i, CASE WHEN m < 4 THEN m ELSE 7 - m END AS j, sum(w) AS w FROM (
    SELECT i, ((i + k) % 8 + 8) % 8 AS m, w FROM (SELECT k, exp(-0.5 * (k / {s}::DOUBLE) ** 2) / sum(exp(-0.5 * (k / {s}::DOUBLE) ** 2)) OVER () AS w FROM range(-{int(4 * s + 0.5)}, {int(4 * s + 0.5)} + 1) r(k)), range(4) v(i)
  ) GROUP BY ALL
)"""  # noqa: E731
_BLUR = lambda src, name: f"(SELECT a.vec_id, p.i AS iz, q.i AS iy, r.i AS ix, sum(a.v * p.w * q.w * r.w) AS g FROM {src} a JOIN {name} p ON p.j = a.z % 4 JOIN {name} q ON q.j = a.y % 4 JOIN {name} r ON r.j = a.x % 4 GROUP BY ALL)"
_AT = lambda t: f"{t}.vec_id = v.vec_id AND {t}.iz = v.z % 4 AND {t}.iy = v.y % 4 AND {t}.ix = v.x % 4"
_CUT = lambda e: f"CAST(floor(least(greatest({e}, 0), 65535)) AS BIGINT)"


@query(f"WITH {VOX}, {_GAUSS('g1', 1)}, {_GAUSS('g4', 4)} SELECT z, y, x, {_CUT('a.g - b.g')} AS v FROM vox v JOIN {_BLUR('vox', 'g1')} a ON {_AT('a')} JOIN {_BLUR('vox', 'g4')} b ON {_AT('b')}")
def gaussian_dog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In double precision here, so that SQL gives the same whole numbers."""
    return V.blocks_to_voxels(stencils.dog(X.volume(spark, sf_dir), 1, 4, dtype="f8")).select(*COORDS, "v")


@query(f"WITH {VOX}, {_GAUSS('g2', 2)} SELECT z, y, x, {_CUT('a.g')} AS v FROM vox v JOIN {_BLUR('vox', 'g2')} a ON {_AT('a')}")
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.blocks_to_voxels(stencils.gaussian_blur(X.volume(spark, sf_dir), 2, dtype="f8")).select(*COORDS, "v")


@query(f"WITH {VOX}, {_GAUSS('g101', 101)} SELECT z, y, x, {_CUT('v.v - a.g')} AS v FROM vox v JOIN {_BLUR('vox', 'g101')} a ON {_AT('a')}")
def gaussian_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.blocks_to_voxels(stencils.subtract_gaussian(X.volume(spark, sf_dir), 101, dtype="f8")).select(*COORDS, "v")


_BALL2 = "(SELECT a.i AS dz, b.i AS dy, c.i AS dx FROM range(-2, 3) a(i), range(-2, 3) b(i), range(-2, 3) c(i) WHERE a.i * a.i + b.i * b.i + c.i * c.i <= 4) d"
#: neighbours two voxels away lie inside the chunk or don't count: a mirrored voxel is nearer and in the ball as well
_WITHIN = "ON b.vec_id = a.vec_id AND b.z = a.z + d.dz AND b.y = a.y + d.dy AND b.x = a.x + d.dx"


@query(
    f"WITH {VOX}, low AS (SELECT a.vec_id, a.z, a.y, a.x, min(b.v) AS v FROM vox a CROSS JOIN {_BALL2} JOIN vox b {_WITHIN} GROUP BY ALL), "
    f"opened AS (SELECT a.vec_id, a.z, a.y, a.x, max(b.v) AS v FROM low a CROSS JOIN {_BALL2} JOIN low b {_WITHIN} GROUP BY ALL), "
    "top AS (SELECT vec_id, z, y, x, greatest(vox.v - opened.v, 0) AS v FROM vox JOIN opened USING (vec_id, z, y, x)), "
    f"{_GAUSS('g1', 1)}, {_GAUSS('g2', 2)}, {_GAUSS('g4', 4)}, "
    f"dog AS (SELECT v.vec_id, z, y, x, {_CUT('a.g - b.g')} AS v FROM top v JOIN {_BLUR('top', 'g1')} a ON {_AT('a')} JOIN {_BLUR('top', 'g2')} b ON {_AT('b')}) "
    f"SELECT z, y, x, CAST({_CUT('v.v - a.g')} >= 5 AS BIGINT) AS m FROM dog v JOIN {_BLUR('dog', 'g4')} a ON {_AT('a')}"
)
def detection_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four filters as one pass over the blocks."""
    return V.blocks_to_voxels(stencils.detection_front(X.volume(spark, sf_dir), 2, 1, 2, 4, 5, dtype="f8")).select(*COORDS, F.col("v").alias("m"))


#: rows of cubic-spline resampling of n samples to m: weight of sample j for the new one i. The coefficients of the spline are a
#: sum over the samples with powers of sqrt(3) - 2, mirrored at both ends; four of them meet at each new sample
_SPLINE = lambda name, n, m: f"""{name} AS (
  SELECT i, CASE WHEN f < n THEN f ELSE 2 * (n - 1) - f END AS j, sum(w) AS w FROM (
    SELECT i, n, ((c + k) % (2 * n - 2) + 2 * n - 2) % (2 * n - 2) AS f, sqrt(3) * (sqrt(3) - 2) ** abs(k) * b AS w FROM (
      SELECT i, n, c, CASE WHEN t < 1 THEN 2 / 3::DOUBLE - t * t + t * t * t / 2 ELSE (2 - t) ** 3 / 6 END AS b FROM (
        SELECT i, n, CAST(floor(p) AS BIGINT) + d AS c, abs(p - floor(p) - d) AS t FROM (SELECT i, {n} AS n, i * (({n} - 1) / ({m} - 1)::DOUBLE) AS p FROM range({m}) r(i)), range(-1, 3) s(d)
      ) WHERE t < 2
    ), range(-40, 41) u(k)
  ) GROUP BY ALL
)"""  # noqa: E731


@query(
    f"WITH {VOX}, {_SPLINE('s', 4, 3)} SELECT cz, cy, cx, CAST(round_even(round(sum(v * p.w * q.w), 6), 0) AS BIGINT) AS v FROM vox JOIN s p ON p.j = y % 4 JOIN s q ON q.j = x % 4 GROUP BY cz, cy, cx, z, p.i, q.i"
)
def zoom_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubic spline resampling, here of each chunk; sums a hair beside a half count as that half."""
    return V.blocks_to_voxels(V.map_blocks(X.volume(spark, sf_dir), lambda b: np.rint(np.round(K.zoom(b, (1.0, 0.75, 0.75)), 6)))).select("cz", "cy", "cx", "v")


@query(
    f"WITH {VOX}, depth AS (SELECT max(z) + 1 AS n FROM vox), {_SPLINE('down', '(SELECT n FROM depth)', '(SELECT n // 2 FROM depth)')}, {_SPLINE('across', 32, 24)}, "
    "by_z AS (SELECT i AS z, y, x, sum(v * w) AS v FROM vox JOIN down ON j = z GROUP BY ALL), by_y AS (SELECT z, i AS y, x, sum(v * w) AS v FROM by_z JOIN across ON j = y GROUP BY ALL), "
    "by_x AS (SELECT z, y, i AS x, sum(v * w) AS v FROM by_y JOIN across ON j = x GROUP BY ALL) SELECT z, y, x, CAST(floor(v * 1000000 + 0.5) AS BIGINT) AS v_micro FROM by_x"
)
def zoom_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubic spline resampling of the whole volume in slabs; voxels of chunks that aren't there are 0, and layers that read none
    that is there have no row."""
    vox = X.voxels(spark, sf_dir)
    shape = (vox.agg(F.max("z")).first()[0] + 1, X.SHAPE[1], X.SHAPE[2])
    blocks = V.fill_blocks(V.voxels_to_blocks(vox, (8, 8, 8), shape, "float64"), (8, 8, 8), shape, 2 * resample.REACH_SQL)
    slabs = resample.zoom(blocks, shape, (0.5, 0.75, 0.75), (8, 8, 8), gaps=True)
    out = V.blocks_to_voxels(V.map_blocks(slabs, lambda b: np.floor(b * 1e6 + 0.5).astype(np.int64)))
    there = X.table(spark, sf_dir, "embeddings").selectExpr(f"vec_id div {X.GRID**2} * {X.SIDE} AS first").selectExpr("first", f"first + {X.SIDE - 1} AS last")
    layers = resample.reached_layers(there, shape[0], resample.zoomed(shape[0], 0.5))
    return out.join(layers, "z", "left_semi").select(*COORDS, F.col("v").alias("v_micro"))


#: as `s`, but with the spline read at i * step + start
_READ = lambda name, n, m, step, start: _SPLINE(name, n, m).replace(f"i * (({n} - 1) / ({m} - 1)::DOUBLE)", f"i * {step}::DOUBLE + {start}")


@query(
    f"WITH {VOX}, {_READ('a', 28, 16, 0.8, 1.5)}, {_READ('b', 32, 20, 1.25, 0.4)}, {_READ('c', 32, 24, 0.9, 3.3)}, "
    "by_z AS (SELECT i AS z, y, x, sum(v * w) AS v FROM vox JOIN a ON j = z WHERE z < 28 GROUP BY ALL), by_y AS (SELECT z, i AS y, x, sum(v * w) AS v FROM by_z JOIN b ON j = y GROUP BY ALL), "
    "by_x AS (SELECT z, y, i AS x, sum(v * w) AS v FROM by_y JOIN c ON j = x GROUP BY ALL) SELECT z, y, x, CAST(floor(v * 1000000 + 0.5) AS BIGINT) AS v_micro FROM by_x"
)
def image_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image transform by cubic splines: another grid laid over the first 28 layers."""
    vox, shape = X.voxels(spark, sf_dir).where("z < 28"), (28, *X.SHAPE[1:])
    move = mapping.Affine(np.diag([0.9, 1.25, 0.8]), np.array([3.3, 0.4, 1.5]), np.zeros(3))
    blocks = V.fill_blocks(V.voxels_to_blocks(vox, (7, 8, 16), shape, "float64"), (7, 8, 16), shape, shape[0])
    made = resample.transform_volume(blocks, shape, (16, 20, 24), [move], (10, 12, 16))
    return V.blocks_to_voxels(V.map_blocks(made, lambda b: np.floor(b * 1e6 + 0.5).astype(np.int64))).select(*COORDS, F.col("v").alias("v_micro"))


# ---- labels -----------------------------------------------------------------------------------------------------------


def _label_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_blocks(X.volume(spark, sf_dir), X.CHUNK_SHAPE, (1 << 20, X.GRID, X.GRID), partial(K.threshold, value=X.FOREGROUND))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.labelled_voxels(_label_blocks(spark, sf_dir))


@query(f"WITH RECURSIVE {LAB} SELECT z, y, x, label FROM lab")
def label_in_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select(*COORDS, "label")


@query("SELECT vec_id // 64 AS cz, vec_id // 8 % 8 AS cy, vec_id % 8 AS cx, vec_id * 33 AS first_label FROM embeddings")
def label_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = X.table(spark, sf_dir, "embeddings").selectExpr("vec_id div 64 AS cz", "vec_id div 8 % 8 AS cy", "vec_id % 8 AS cx")
    flat = (F.col("cz") * X.GRID + F.col("cy")) * X.GRID + F.col("cx")
    return chunks.withColumn("first_label", flat * labels.label_budget(X.CHUNK_SHAPE))


@query(f"WITH RECURSIVE {TOUCH} SELECT a, b, count(*) AS n FROM touch GROUP BY a, b")
def halo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = labels.face_voxels(_labels(spark, sf_dir), X.CHUNK_SHAPE)
    return labels.neighbour_edges(faces, X.CHUNK_SHAPE).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {TOUCH} SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi FROM touch")
def boundary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.boundary_pairs(_labels(spark, sf_dir), X.CHUNK_SHAPE)


@query(f"WITH RECURSIVE {LAB} SELECT label, count(*) AS n FROM lab GROUP BY label")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_sizes(_labels(spark, sf_dir))


@query(f"WITH RECURSIVE {COMP} SELECT label, root, n, size FROM comp")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.block_component_table(_label_blocks(spark, sf_dir), X.CHUNK_SHAPE)


@query(f"WITH RECURSIVE {COMP} SELECT label, root, n, size FROM comp")
def component_sizes_of_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table of labelled voxels."""
    return labels.component_table(_labels(spark, sf_dir), X.CHUNK_SHAPE)


@query(f"WITH RECURSIVE {COMP} SELECT z, y, x, size FROM lab JOIN comp USING (label) WHERE size BETWEEN 3 AND 20")
def component_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.filter_sizes(labels.component_volumes(_labels(spark, sf_dir), X.CHUNK_SHAPE), 3, 20).select(*COORDS, "size")


@query(f"WITH RECURSIVE {COMP} SELECT z, y, x, size FROM lab JOIN comp USING (label)")
def component_volume_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes written back into dense blocks."""
    blocks = _label_blocks(spark, sf_dir)
    table = labels.block_component_table(blocks, X.CHUNK_SHAPE)
    return V.blocks_to_voxels(labels.scatter_volumes(blocks, table), sparse=True).select(*COORDS, F.col("v").alias("size"))


@query(f"WITH RECURSIVE {LAB} SELECT z, y, x, count(*) OVER (PARTITION BY label) AS size FROM lab")
def block_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.block_volumes(_labels(spark, sf_dir)).select(*COORDS, "size")


@query(f"WITH RECURSIVE {LAB} SELECT z, y, x, CASE WHEN label % 2 = 0 THEN label * 10 ELSE 0 END AS value FROM lab")
def map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = _labels(spark, sf_dir)
    table = labels.label_sizes(lab).where("label % 2 = 0").selectExpr("label AS id", "label * 10 AS value")
    return labels.map_values(lab, table, "id", "value", "value").select(*COORDS, "value")


@query(f"WITH RECURSIVE {TOUCH}, pairs AS (SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi FROM touch) SELECT lo, hi FROM pairs WHERE lo % 2 = 0 INTERSECT SELECT lo, hi FROM pairs WHERE hi % 3 = 0")
def pairs_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = boundary_pairs(spark, sf_dir)
    return pairs.where("lo % 2 = 0").intersect(pairs.where("hi % 3 = 0"))


@query(f"WITH RECURSIVE {TOUCH}, pairs AS (SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi FROM touch) SELECT lo, hi FROM pairs EXCEPT SELECT lo, hi FROM pairs WHERE hi % 3 = 0")
def pairs_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = boundary_pairs(spark, sf_dir)
    return pairs.exceptAll(pairs.where("hi % 3 = 0"))


@query(f"WITH {VOX} SELECT z, y, x, v FROM vox WHERE v >= 1200 UNION ALL SELECT z, y, x, v FROM vox WHERE v < 800")
def union_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vox = X.voxels(spark, sf_dir).select(*COORDS, "v")
    return vox.where("v >= 1200").unionByName(vox.where("v < 800"))


# ---- objects ----------------------------------------------------------------------------------------------------------


@query(
    f"WITH RECURSIVE {COMP}, first AS (SELECT label, min((z * 1000 + y) * 1000 + x) AS f, CAST(sum(v) AS DOUBLE) AS sum_intensity FROM lab GROUP BY label) "
    "SELECT label, f // 1000000 AS z, f // 1000 % 1000 AS y, f % 1000 AS x, CAST(1 AS BIGINT) AS count, size AS volume, sum_intensity FROM first JOIN comp USING (label)"
)
def cells_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreground components as both maxima and regions, with sizes across chunks."""
    lab = settle(_label_blocks(spark, sf_dir), "labels")
    sizes = labels.scatter_volumes(lab, labels.block_component_table(lab, X.CHUNK_SHAPE))
    return objects.extract_from_blocks(X.volume(spark, sf_dir), lab, lab, sizes)


@query(
    f"WITH RECURSIVE {COMP}, first AS (SELECT label, min((z * 1000 + y) * 1000 + x) AS f, CAST(sum(v) AS DOUBLE) AS sum_intensity FROM lab GROUP BY label) "
    "SELECT label, f // 1000000 AS z, f // 1000 % 1000 AS y, f % 1000 AS x, CAST(1 AS BIGINT) AS count, size AS volume, sum_intensity FROM first JOIN comp USING (label)"
)
def cells_extract_of_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from tables of voxels, by joins on the coordinates."""
    lab = _labels(spark, sf_dir)
    return objects.extract_cells(X.voxels(spark, sf_dir), lab, labels.component_volumes(lab, X.CHUNK_SHAPE))


@query(
    f"WITH RECURSIVE {COMP}, parts AS (SELECT root, min(label) AS label, min((z * 1000 + y) * 1000 + x) AS f, CAST(sum(v) AS DOUBLE) AS sum_intensity, count(*) AS volume FROM lab JOIN comp USING (label) GROUP BY root) "
    "SELECT label, f // 1000000 AS z, f // 1000 % 1000 AS y, f % 1000 AS x, CAST(1 AS BIGINT) AS count, volume, sum_intensity FROM parts"
)
def cells_extract_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per component, however many chunks it crosses."""
    lab = _labels(spark, sf_dir)
    table = labels.component_table(lab, X.CHUNK_SHAPE).select("label", "root", "size")
    return objects.extract_cells(X.voxels(spark, sf_dir), lab, lab.join(table, "label"), merge_cells=True)


@query(f"WITH {VOX} SELECT z + 10 AS z, y AS y, x + 5 AS x, v FROM vox")
def tuning_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.shift(X.voxels(spark, sf_dir).select(*COORDS, "v"), (10, 0, 5))


#: labelled maxima inside the foreground: as `lab`, with the maxima in place of the foreground
_MAXIMA = LAB.replace(f"fg AS (SELECT * FROM vox WHERE v >= {X.FOREGROUND})", f"fg AS (SELECT a.* FROM vox a CROSS JOIN {_BALL1} {_NEAR} WHERE a.v >= {X.FOREGROUND} GROUP BY ALL HAVING a.v = max(b.v))")
#: one voxel of each chunk in turn leaves the queue and hands its label to its free neighbours, places 0 to 63
_FLOOD = """chunk AS (
  SELECT vec_id, list(v ORDER BY p) AS vs, list(inside ORDER BY p) AS ms, list(label ORDER BY p) AS lab, coalesce(list({'k': -v, 'n': n, 'i': p}) FILTER (label > 0), []) AS q
  FROM (SELECT vox.vec_id, vox.v, __INSIDE__ AS inside, z % 4 * 16 + y % 4 * 4 + x % 4 AS p, coalesce(label, 0) AS label, count(label) OVER (PARTITION BY vox.vec_id ORDER BY z, y, x) AS n FROM vox LEFT JOIN lab USING (vec_id, z, y, x)) GROUP BY vec_id
), flood(vec_id, vs, ms, lab, q, n) AS (
  SELECT vec_id, vs, ms, lab, q, 100 FROM chunk UNION ALL
  SELECT vec_id, vs, ms, [CASE WHEN list_contains(nb, j) THEN lab[t + 1] ELSE lab[j + 1] END for j in range(64)],
    list_concat(q[2:], [{'k': -vs[j + 1], 'n': n + list_position(nb, j), 'i': j} for j in nb]), n + len(nb)
  FROM (
    SELECT *, [j for j in [CASE WHEN t >= 16 THEN t - 16 END, CASE WHEN t // 4 % 4 > 0 THEN t - 4 END, CASE WHEN t % 4 > 0 THEN t - 1 END, CASE WHEN t % 4 < 3 THEN t + 1 END, CASE WHEN t // 4 % 4 < 3 THEN t + 4 END, CASE WHEN t < 48 THEN t + 16 END] if j IS NOT NULL AND ms[j + 1] AND lab[j + 1] = 0] AS nb
    FROM (SELECT vec_id, vs, ms, lab, list_sort(q) AS q, n, list_sort(q)[1].i AS t FROM flood WHERE len(q) > 0)
  )
)"""


@query(
    f"WITH RECURSIVE {_MAXIMA}, {_FLOOD.replace('__INSIDE__', f'vox.v >= {X.FOREGROUND}')} SELECT 4 * (vec_id // 64) + p // 16 AS z, 4 * (vec_id // 8 % 8) + p // 4 % 4 AS y, 4 * (vec_id % 8) + p % 4 AS x, label "
    "FROM (SELECT vec_id, unnest(lab) AS label, unnest(range(64)) AS p FROM flood WHERE len(q) = 0) WHERE label > 0"
)
def watershed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = X.volume(spark, sf_dir)
    mask = stencils.threshold(raw, X.FOREGROUND)
    markers = labels.label_blocks(stencils.local_maxima(raw, 1, mask), X.CHUNK_SHAPE, (1 << 20, X.GRID, X.GRID))
    return labels.labelled_voxels(stencils.watershed(raw, markers, mask)).select(*COORDS, "label")


@query()
def detect_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the raw volume to objects: filters, threshold, components, size filter, maxima, watershed, extraction. Each table that
    is written takes one pass over its blocks, so a task holds one Python process."""
    raw = settle(X.volume(spark, sf_dir), "raw")
    grid = (1 << 20, X.GRID, X.GRID)
    lab = settle(labels.label_blocks(raw, X.CHUNK_SHAPE, grid, K.chain(partial(K.tophat, radius=2), partial(K.threshold, value=60))), "labels")
    table = labels.block_component_table(lab, X.CHUNK_SHAPE)
    kept = settle(labels.scatter_volumes(lab, table, kernel=lambda b: ((b >= 1) & (b <= 1000)).astype(np.uint8)), "kept")
    maxima = settle(labels.label_blocks(raw, X.CHUNK_SHAPE, grid, lambda b, m: K.local_maxima(b, 1, m), [kept]), "maxima")
    regions = settle(stencils.watershed(raw, maxima, kept), "regions")
    sizes = settle(labels.scatter_volumes(regions, labels.block_component_table(regions, X.CHUNK_SHAPE)), "sizes")
    return objects.extract_from_blocks(raw, maxima, regions, sizes)


# ---- coordinates --------------------------------------------------------------------------------------------------------


@query(f"WITH {POINTS} SELECT key, z / 3::DOUBLE * 1::DOUBLE - 1::DOUBLE AS z, y / 6::DOUBLE * 0.6::DOUBLE - 0::DOUBLE AS y, x / 6::DOUBLE * 0.6::DOUBLE - 2::DOUBLE AS x FROM pts")
def scale_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.scale_coords(X.points(spark, sf_dir), (3, 6, 6), (1.0, 0.6, 0.6), (1, None, 2)).select("key", *COORDS)


@query(f"WITH {POINTS} SELECT key, z, y, x FROM grid WHERE {_INSIDE}")
def bounds_and_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.on_grid(X.points(spark, sf_dir), X.SHAPE).select("key", *COORDS)


@query(f"WITH {POINTS} SELECT key, 0.0::DOUBLE + z * 0.5::DOUBLE + y * 0.25::DOUBLE + x * 0::DOUBLE + 3::DOUBLE AS z, 0.0::DOUBLE + z * -0.25::DOUBLE + y * 1::DOUBLE + x * 0::DOUBLE + 1.5::DOUBLE AS y, 0.0::DOUBLE + z * 0::DOUBLE + y * 0::DOUBLE + x * 2::DOUBLE - 4::DOUBLE AS x FROM pts")
def affine_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = mapping.affine_columns([[0.5, 0.25, 0], [-0.25, 1, 0], [0, 0, 2]], [3, 1.5, -4])
    return X.points(spark, sf_dir).select("key", *[c.alias(n) for c, n in zip(cols, COORDS, strict=True)])


@query()
def bspline_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An affine transform, then a cubic B-spline over a control grid."""
    grid = np.random.default_rng(5).normal(0, 0.5, (3, 12, 12, 12))
    steps = [mapping.Affine(np.eye(3) * 0.9, np.array([1.0, 0, -1]), np.full(3, 16.0)), mapping.BSpline((12, 12, 12), np.full(3, 4.0), np.full(3, -6.0), grid)]
    return mapping.transform_points(X.points(spark, sf_dir), steps).select("key", "z_trfm", "y_trfm", "x_trfm")


_B3 = lambda t: f"(CASE WHEN abs({t}) < 1 THEN 2 / 3::DOUBLE - ({t}) ** 2 + abs({t}) ** 3 / 2 WHEN abs({t}) < 2 THEN (2 - abs({t})) ** 3 / 6 ELSE 0 END)"
_PLACE = lambda c, a: f"{c} + coalesce(sum(((k * 3 + j * 5 + i * 7 + {a} * 11) % 13 - 6) / 10::DOUBLE * w), 0)"


@query(
    f"WITH {POINTS}, moved AS (SELECT row_number() OVER () AS n, key, 0.9::DOUBLE * (z - 16) + 15 AS z, 0.9::DOUBLE * (y - 16) + 16 AS y, 0.9::DOUBLE * (x - 16) + 17 AS x FROM pts), "
    "placed AS (SELECT *, (z + 6) / 4 AS w, (y + 6) / 4 AS v, (x + 6) / 4 AS u FROM moved), near AS ("
    f"SELECT n, k, j, i, {_B3('w - k')} * {_B3('v - j')} * {_B3('u - i')} AS w FROM (SELECT *, floor(w) - 1 + c.r AS k, floor(v) - 1 + b.r AS j, floor(u) - 1 + a.r AS i FROM placed, range(4) a(r), range(4) b(r), range(4) c(r) "
    "WHERE floor(w) BETWEEN 1 AND 9 AND floor(v) BETWEEN 1 AND 9 AND floor(u) BETWEEN 1 AND 9)) "
    f"SELECT key, CAST(floor(1000000 * ({_PLACE('any_value(z)', 2)}) + 0.5) AS BIGINT) AS z_micro, CAST(floor(1000000 * ({_PLACE('any_value(y)', 1)}) + 0.5) AS BIGINT) AS y_micro, CAST(floor(1000000 * ({_PLACE('any_value(x)', 0)}) + 0.5) AS BIGINT) AS x_micro "
    "FROM moved LEFT JOIN near USING (n) GROUP BY n, key"
)
def bspline_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same kind of chain with control points by a formula, in millionths of a voxel."""
    z, y, x = np.indices((12, 12, 12))
    grid = np.stack([((z * 3 + y * 5 + x * 7 + a * 11) % 13 - 6) / 10 for a in range(3)])
    steps = [mapping.Affine(np.eye(3) * 0.9, np.array([1.0, 0, -1]), np.full(3, 16.0)), mapping.BSpline((12, 12, 12), np.full(3, 4.0), np.full(3, -6.0), grid)]
    moved = mapping.transform_points(X.points(spark, sf_dir), steps)
    return moved.select("key", *[F.floor(F.col(f"{c}_trfm") * 1e6 + 0.5).cast("long").alias(f"{c}_micro") for c in COORDS])


@query(f"WITH {POINTS}, {ATLAS} SELECT key, CASE WHEN g.z BETWEEN 0 AND 31 AND g.y BETWEEN 0 AND 31 AND g.x BETWEEN 0 AND 31 THEN coalesce(a.id, 0) ELSE -1 END AS id FROM grid g LEFT JOIN atlas a ON a.z = g.z AND a.y = g.y AND a.x = g.x")
def grid_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.region_at(X.points(spark, sf_dir).drop("id"), X.atlas(spark), X.SHAPE, COORDS).select("key", "id")


_ATLAS_AGG = f"""WITH RECURSIVE {ONTO}, {POINTS}, {ATLAS}, cell AS (
  SELECT CASE WHEN g.z BETWEEN 0 AND 31 AND g.y BETWEEN 0 AND 31 AND g.x BETWEEN 0 AND 31 THEN coalesce(a.id, 0) ELSE -1 END AS id, g.ord AS volume FROM grid g LEFT JOIN atlas a ON a.z = g.z AND a.y = g.y AND a.x = g.x
), own AS (SELECT id, count(*) AS count, CAST(sum(volume) AS BIGINT) AS volume FROM cell GROUP BY id), total AS (
  SELECT o.id, coalesce(CAST(sum(w.count) AS BIGINT), 0) AS count, coalesce(CAST(sum(w.volume) AS BIGINT), 0) AS volume FROM onto o LEFT JOIN up ON up.ancestor = o.id LEFT JOIN own w ON w.id = up.id GROUP BY o.id
  UNION ALL SELECT id, count, volume FROM own WHERE id NOT IN (SELECT id FROM onto)
)
SELECT t.id, CASE WHEN t.id = -1 THEN 'invalid' WHEN t.id = 0 THEN 'universe' ELSE coalesce(name, 'no_label') END AS name, count, volume FROM total t LEFT JOIN onto o USING (id)"""


@query(_ATLAS_AGG)
def atlas_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points through the atlas to rolled-up regions; invalid points and the universe keep rows of their own."""
    pts = X.points(spark, sf_dir).select(*COORDS, F.lit(1).cast("long").alias("count"), F.col("ord").cast("long").alias("volume"), F.lit(0).cast("long").alias("sum_intensity"))
    onto = X.ontology(spark, sf_dir)
    named = ontology.with_regions(mapping.region_at(pts, X.atlas(spark), X.SHAPE, COORDS), onto)
    return ontology.group_cells(named, onto).select("id", "name", "count", "volume")


@query(f"WITH {POINTS} SELECT z, y, x, count(*) AS n FROM grid WHERE {_INSIDE} GROUP BY ALL")
def raster_points_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.count_points(X.points(spark, sf_dir), X.SHAPE)


@query(f"WITH {POINTS} SELECT z // 8 AS z, y // 8 AS y, x // 8 AS x, count(*) % 256 AS n FROM grid WHERE {_INSIDE} GROUP BY 1, 2, 3")
def raster_points_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as 8-bit integers, on coarse voxels so that they wrap."""
    coarse = raster.on_grid(X.points(spark, sf_dir), X.SHAPE).selectExpr("z div 8 AS z", "y div 8 AS y", "x div 8 AS x")
    return raster.count_points(coarse, (4, 4, 4), bits=8)


@query(f"WITH {POINTS} SELECT DISTINCT z, y, x, 1 AS n FROM grid WHERE {_INSIDE}")
def raster_points_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.mark_points(X.points(spark, sf_dir), X.SHAPE)


@query(f"WITH {POINTS}, o AS (SELECT * FROM {_BALL1}) SELECT * FROM (SELECT z + dz AS z, y + dy AS y, x + dx AS x, count(*) AS n FROM grid CROSS JOIN o GROUP BY 1, 2, 3) WHERE {_INSIDE}")
def raster_spheres_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.count_spheres(X.points(spark, sf_dir), X.SHAPE, 1)


@query(
    f"WITH {POINTS}, o AS (SELECT a.i AS dz, b.i AS dy, c.i AS dx FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i) WHERE a.i * a.i + b.i * b.i + c.i * c.i < 4) "
    f"SELECT * FROM (SELECT z + dz AS z, y + dy AS y, x + dx AS x, count(*) AS n FROM (SELECT DISTINCT z, y, x FROM grid) CROSS JOIN o GROUP BY 1, 2, 3) WHERE {_INSIDE}"
)
def raster_spheres_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.mark_spheres(X.points(spark, sf_dir), X.SHAPE, 2)


@query(f"WITH {POINTS} SELECT z, y, x, CAST(max(CAST(ord AS BIGINT) * 1000000000 + id) % 1000000000 AS BIGINT) AS id FROM grid WHERE {_INSIDE} GROUP BY z, y, x")
def raster_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.mark_regions(X.points(spark, sf_dir), X.SHAPE, "ord")


# ---- specimens --------------------------------------------------------------------------------------------------------

_SPECIMENS = ("A", "N", "R")
_BY_SPECIMEN = f"""{CELLS}, own AS (SELECT specimen, id, count(*) AS count, sum(volume) AS volume FROM cell GROUP BY ALL), agg AS (
  SELECT s.specimen, o.id, coalesce(CAST(sum(w.count) AS DOUBLE), 0) AS count, coalesce(CAST(sum(w.volume) AS DOUBLE), 0) AS volume
  FROM onto o CROSS JOIN (VALUES ('A'), ('N'), ('R')) s(specimen) LEFT JOIN up ON up.ancestor = o.id LEFT JOIN own w ON w.id = up.id AND w.specimen = s.specimen GROUP BY ALL
)"""


def _specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All specimens from one scan and one roll-up."""
    return ontology.group_cells(X.cells(spark, sf_dir), X.ontology(spark, sf_dir), "specimen", _SPECIMENS)


@query(f"WITH RECURSIVE {_BY_SPECIMEN} SELECT id, specimen, 'count' AS measure, count AS value FROM agg UNION ALL SELECT id, specimen, 'volume', volume FROM agg")
def specimen_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.long_table(_specimens(spark, sf_dir), ("count", "volume"))


@query(
    f"WITH RECURSIVE {_BY_SPECIMEN}, wide AS (SELECT id, " + ", ".join(f"max({m}) FILTER (specimen = '{s}') AS {s}__{m}" for s in _SPECIMENS for m in ("count", "volume")) + " FROM agg GROUP BY id), "
    "base AS (SELECT c.id, c.name, c.acronym, p.acronym AS parent_acronym FROM onto c LEFT JOIN onto p ON p.id = c.parent_structure_id UNION ALL VALUES (-1, 'invalid', NULL, NULL), (0, 'universe', NULL, NULL)) "
    "SELECT * FROM base LEFT JOIN wide USING (id)"
)
def specimen_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = combine.wide_table(spark, X.ontology(spark, sf_dir), _specimens(spark, sf_dir), ("count", "volume"), _SPECIMENS)
    return wide.drop("color_hex_triplet", "parent_structure_id")


# ---- scalars, sorting, files, streams -----------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("SELECT name, row_number() OVER (ORDER BY regexp_extract(name, '^(\\D*)', 1), CAST(regexp_extract(name, '(\\d+)', 1) AS BIGINT)) AS place FROM (SELECT DISTINCT 'img' || (p_partkey % 120) || '.tif' AS name FROM part)")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img2 before img10. Names of one volume are few; they are ranked where the reader ranks them, by the same key."""
    from pyspark.sql import Window

    names = X.table(spark, sf_dir, "part").select(F.concat(F.lit("img"), (F.col("p_partkey") % 120).cast("string"), F.lit(".tif")).alias("name")).distinct()
    key = [F.regexp_extract("name", r"^(\D*)", 1), F.regexp_extract("name", r"(\d+)", 1).cast("long")]
    return names.select("name", F.row_number().over(Window.orderBy(*key)).cast("long").alias("place"))


@query(f"WITH RECURSIVE {CELLS} SELECT id, count(*) AS count, CAST(sum(volume) AS DOUBLE) AS volume FROM cell GROUP BY id")
def region_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregate that the stream keeps, in batch form."""
    return _doubles(live.region_totals(X.cells(spark, sf_dir)), "volume").select("id", "count", "volume")


@query("SELECT event_type AS id, count(*) AS count, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS volume FROM events GROUP BY event_type")
def streaming_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums over a stream of all files, read to its end."""
    import uuid

    stream = live.stream_table(spark, f"{sf_dir}/events.parquet")
    cells = stream.selectExpr("event_type AS id", "CAST(1 AS BIGINT) AS count", "CAST(round(value * 100) AS BIGINT) AS volume", "CAST(0 AS BIGINT) AS sum_intensity")
    return live.run_to_end(live.region_totals(cells), f"totals_{uuid.uuid4().hex}").select("id", "count", "volume")


# ---- files ------------------------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    import uuid

    return f"{shared_dir(spark)}/stratavox/{name}-{uuid.uuid4().hex}"


def _shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    n = X.table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    return (X.SIDE * (n // X.GRID**2 + 1), X.SHAPE[1], X.SHAPE[2])


@query(f"WITH {VOX} SELECT z, y, x, v FROM vox WHERE z BETWEEN 5 AND 18 AND y BETWEEN 3 AND 28 AND x BETWEEN 9 AND 20")
def tiff_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume as one TIFF file written by all tasks, and a box read back from it."""
    path, shape = _scratch(spark, "volume") + ".tif", _shape(spark, sf_dir)
    S.write_big_tiff(X.volume(spark, sf_dir), path, shape, "int32")
    near = S.read_big_tiff(spark, path, (6, 10, 7), ((5, 3, 9), (19, 29, 21)))
    return V.blocks_to_voxels(near).where("z between 5 and 18 and y between 3 and 28 and x between 9 and 20").select(*COORDS, "v")


@query(f"WITH {VOX} SELECT z, y, x, v FROM vox WHERE v <> 0")
def zarr_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume as a chunked array on disk, a file for each chunk, and all of it read back."""
    path = _scratch(spark, "volume") + ".zarr"
    S.write_zarr(X.volume(spark, sf_dir), path, _shape(spark, sf_dir), X.CHUNK_SHAPE, "int32")
    return V.blocks_to_voxels(S.read_volume(spark, path, X.CHUNK_SHAPE), sparse=True).select(*COORDS, "v")


@query(f"WITH RECURSIVE {CELLS} SELECT id, count(*) AS count, CAST(sum(volume) AS DOUBLE) AS volume FROM cell GROUP BY id")
def csv_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regional totals as the text table that users open elsewhere, read back."""
    path = _scratch(spark, "totals")
    _doubles(live.region_totals(X.cells(spark, sf_dir)), "volume").select("id", "count", "volume").orderBy("id").coalesce(1).write.csv(path, header=True)  # a row per region
    return spark.read.csv(path, header=True, schema="id long, count long, volume double")


@query("SELECT date_trunc('day', ts) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in daily windows of a stream that is read to its end; windows stay open as long as nothing later has come."""
    import uuid

    events = live.stream_table(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    counts = live.windowed_counts(events, "ts", "kind", "1 day", "10000 days")
    return live.run_to_end(counts, f"windows_{uuid.uuid4().hex}").select(F.col("w.start").cast("timestamp_ntz").alias("day"), "kind", "n")


@query(
    f"WITH RECURSIVE {LAB} SELECT label, min((z * 1000 + y) * 1000 + x) // 1000000 AS z, min((z * 1000 + y) * 1000 + x) // 1000 % 1000 AS y, min((z * 1000 + y) * 1000 + x) % 1000 AS x, count(*) AS volume, CAST(sum(v) AS DOUBLE) AS sum_intensity FROM lab GROUP BY label"
)
def streaming_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of the chunks of a stream, appended batch by batch."""
    path = _scratch(spark, "objects")
    stream = live.stream_table(spark, f"{sf_dir}/embeddings.parquet")
    blocks = lambda batch: arrays.blocks_of_arrays(batch, "vec_id", "embedding", X.CHUNK_SHAPE, (X.GRID, X.GRID), 1, 1000)
    live.append_cells(stream, lambda batch: objects.threshold_objects(blocks(batch), X.FOREGROUND, X.CHUNK_SHAPE, (1, X.GRID, X.GRID)), path, f"{path}-checkpoint").awaitTermination()
    return spark.read.parquet(path).select("label", *COORDS, "volume", "sum_intensity")


@query(f"WITH RECURSIVE {COMP} SELECT label, root, n, size FROM comp")
def streaming_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components across the chunks of a stream, merged batch by batch."""
    path = _scratch(spark, "components")

    def label(batch: DataFrame) -> DataFrame:
        blocks = arrays.blocks_of_arrays(batch, "vec_id", "embedding", X.CHUNK_SHAPE, (X.GRID, X.GRID), 1, 1000)
        return labels.label_blocks(stencils.threshold(blocks, X.FOREGROUND), X.CHUNK_SHAPE, (1 << 20, X.GRID, X.GRID))

    merging.merge_arrivals(live.stream_table(spark, f"{sf_dir}/embeddings.parquet"), label, f"{path}/state", f"{path}/checkpoint", X.CHUNK_SHAPE).awaitTermination()
    return merging.component_table(spark, f"{path}/state")


def entry(spark: SparkSession) -> DataFrame:
    return region_rollup(spark, "/root/testdata/sf0.001")
