"""Points back to voxels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.operators.stencils import footprint
from stratavox.plans.schema import COORDS


def rounded(c: str) -> Column:
    """Half to even."""
    return F.rint(F.col(c).cast("double")).cast("long")


def in_bounds(shape: Sequence[int], coords: Sequence[str] = COORDS) -> Column:
    ok = F.lit(True)
    for c, n in zip(coords, shape, strict=True):
        ok = ok & F.col(c).between(0, n - 1)
    return ok


def on_grid(points: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Points rounded to voxels, those outside the volume left out."""
    return points.withColumns({c: rounded(c) for c in COORDS}).where(in_bounds(shape))


def count_points(points: DataFrame, shape: Sequence[int], bits: int | None = None) -> DataFrame:
    """(z, y, x, n): points per voxel; with bits, what an unsigned integer of so many bits holds."""
    n = on_grid(points, shape).groupBy(*COORDS).agg(F.count("*").alias("n"))
    return n if bits is None else n.withColumn("n", F.pmod("n", F.lit(1 << bits)))


def mark_points(points: DataFrame, shape: Sequence[int]) -> DataFrame:
    """(z, y, x, n): 1 where there is any point."""
    return on_grid(points, shape).select(*COORDS).distinct().withColumn("n", F.lit(1).cast("long"))


def _spread(points: DataFrame, radius: int, closed: bool) -> DataFrame:
    """Points with a ball's offsets: the offsets follow the radius alone, so they are an array expression, not a join."""
    offsets = F.explode(F.array(*[F.struct(*[F.lit(int(v)).cast("long").alias(k) for v, k in zip(o, ("dz", "dy", "dx"), strict=True)]) for o in _ball(radius, closed)]))
    return points.withColumn("_o", offsets)


def _ball(radius: int, closed: bool):
    from stratavox.functions.kernels import ball

    return ball(radius, closed)


def count_spheres(points: DataFrame, shape: Sequence[int], radius: int) -> DataFrame:
    """(z, y, x, n): spheres over each voxel, the shell included. Equal points are counted first and carry their number."""
    own = points.groupBy(*[rounded(c).alias(c) for c in COORDS]).agg(F.count("*").alias("k"))
    if radius > 8:  # a large ball is a table, not a literal; its size follows the radius
        wide = own.crossJoin(F.broadcast(footprint(points.sparkSession, radius)))
    else:
        wide = _spread(own, radius, True).select("*", "_o.*")
    moved = wide.select(*[(F.col(c) + F.col("d" + c)).alias(c) for c in COORDS], "k").where(in_bounds(shape))
    return moved.groupBy(*COORDS).agg(F.sum("k").alias("n"))


def mark_spheres(points: DataFrame, shape: Sequence[int], radius: int) -> DataFrame:
    """(z, y, x, n): how many offsets of the open ball reach each voxel from any point; equal points count once."""
    own = points.select(*[rounded(c).alias(c) for c in COORDS]).distinct()
    if radius > 8:
        wide = own.crossJoin(F.broadcast(footprint(points.sparkSession, radius, closed=False)))
    else:
        wide = _spread(own, radius, False).select("*", "_o.*")
    moved = wide.select(*[(F.col(c) + F.col("d" + c)).alias(c) for c in COORDS]).where(in_bounds(shape))
    return moved.groupBy(*COORDS).agg(F.count("*").alias("n"))


def mark_regions(points: DataFrame, shape: Sequence[int], order: str) -> DataFrame:
    """(z, y, x, id): the region id of the point with the highest order at each voxel, the larger id among equals."""
    return on_grid(points, shape).groupBy(*COORDS).agg(F.max(F.struct(order, "id")).alias("top")).select(*COORDS, F.col("top.id").alias("id"))
