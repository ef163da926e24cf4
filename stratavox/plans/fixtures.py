"""Volumes, regions, objects and points derived from the driver's tables.

volume: chunk = one embedding as 4 x 4 x 4 voxels, chunks laid out 8 x 8 along y and x; v = floor((e + 1) * 1000).
ontology: root 1, regions 10 + r_regionkey, nations 100 + n_nationkey. cells: one per lineitem, in its customer's nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.plans.schema import ONTOLOGY
from stratavox.sources import arrays

SIDE, GRID = 4, 8
CHUNK_SHAPE = (SIDE, SIDE, SIDE)
FOREGROUND = 1100
SHAPE = (32, 32, 32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived volume as blocks of 32-bit integers."""
    return arrays.blocks_of_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", CHUNK_SHAPE, (GRID, GRID), 1, 1000)


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived volume as voxels (cz, cy, cx, z, y, x, v): expressions on the scan alone."""
    each = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    c = each.selectExpr("cast(vec_id div 64 as int) cz", "cast(vec_id div 8 % 8 as int) cy", "cast(vec_id % 8 as int) cx", "i", "cast(floor((cast(e as double) + 1) * 1000) as int) v")
    return c.selectExpr("cz", "cy", "cx", "cast(4 * cz + i div 16 as bigint) z", "cast(4 * cy + i div 4 % 4 as bigint) y", "cast(4 * cx + i % 4 as bigint) x", "v")


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    acronym = lambda c: F.upper(F.substring(c, 1, 3))
    root = spark.range(1).select(F.lit(1).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_structure_id"), F.lit("root").alias("name"), F.lit("ROO").alias("acronym"))
    regions = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 10).cast("long"), F.lit(1).cast("long"), "r_name", acronym("r_name"))
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long"), (F.col("n_regionkey") + 10).cast("long"), "n_name", acronym("n_name"))
    onto = root.union(regions).union(nations)
    return onto.select(*[(F.col(n) if n in onto.columns else F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in ONTOLOGY.split(", "))])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, count, volume, sum_intensity, specimen): decimals, so sums don't depend on their order."""
    line = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_returnflag specimen", "cast(l_quantity as decimal(18,2)) volume", "cast(l_extendedprice as decimal(18,2)) sum_intensity")
    # lines meet their order as one row per order and specimen: less to shuffle, the same sums
    line = line.groupBy("l_orderkey", "specimen").agg(F.count("*").alias("count"), F.sum("volume").alias("volume"), F.sum("sum_intensity").alias("sum_intensity"))
    who = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return line.join(who, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("c_nationkey") + 100).cast("long").alias("id"), "count", "volume", "sum_intensity", "specimen")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x, key, weight): one point per lineitem, some outside the 32 x 32 x 32 volume."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "(l_orderkey % 330) / 10.0D - 0.5D AS z", "(l_partkey % 330) / 10.0D - 0.5D AS y", "(l_suppkey % 33) + l_linenumber * 0.25D AS x", "l_orderkey AS key", "l_partkey AS id", "l_linenumber AS ord"
    )


def atlas(spark: SparkSession) -> DataFrame:
    """Region ids on the 32 x 32 x 32 grid, without a row where z + y + x is a multiple of 7."""
    grid = spark.range(32 * 32 * 32).selectExpr("id div 1024 AS z", "id div 32 % 32 AS y", "id % 32 AS x")
    return grid.where("(z + y + x) % 7 <> 0").selectExpr("z", "y", "x", "100 + ((z div 8) * 16 + (y div 8) * 4 + x div 8) % 25 AS id")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id", "ts", "event_id", "cast(round(value * 100) as bigint) AS v")
