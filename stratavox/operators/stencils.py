"""Neighbourhood filters: block plans by default, SQL plans for one-dimensional signals."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavox.functions import kernels as K
from stratavox.operators.volumes import map_aligned, map_blocks, map_overlap


def _apply(blocks: DataFrame, fn, halo: int) -> DataFrame:
    return map_overlap(blocks, fn, halo) if halo else map_blocks(blocks, fn)


def tophat(blocks: DataFrame, radius: int = 10, halo: int = 0) -> DataFrame:
    """White top-hat of each chunk; a halo of 2 * radius makes the result independent of the chunk grid."""
    return _apply(blocks, partial(K.tophat, radius=radius), halo)


def dog(blocks: DataFrame, sigma1: float = 1, sigma2: float = 4, halo: int = 0, dtype: str = "f4") -> DataFrame:
    """Difference of Gaussians, in single precision unless `dtype` says otherwise, as all filters with Gaussians."""
    return _apply(blocks, partial(K.dog, sigma1=sigma1, sigma2=sigma2, dtype=dtype), halo)


def gaussian_blur(blocks: DataFrame, sigma: float, halo: int = 0, dtype: str = "f4") -> DataFrame:
    return _apply(blocks, partial(K.gaussian_blur, sigma=sigma, dtype=dtype), halo)


def subtract_gaussian(blocks: DataFrame, sigma: float = 101, halo: int = 0, dtype: str = "f4") -> DataFrame:
    return _apply(blocks, partial(K.subtract_gaussian, sigma=sigma, dtype=dtype), halo)


def erode(blocks: DataFrame, radius: int, halo: int = 0) -> DataFrame:
    return _apply(blocks, partial(K.erode, radius=radius), halo)


def dilate(blocks: DataFrame, radius: int, halo: int = 0) -> DataFrame:
    return _apply(blocks, partial(K.dilate, radius=radius), halo)


def convolve(blocks: DataFrame, weights: np.ndarray, halo: int = 0) -> DataFrame:
    """A symmetric kernel along each axis in turn, in the kernel's own number type."""
    return _apply(blocks, lambda b: K.convolve_axes(b.astype(weights.dtype), weights), halo)


def threshold(blocks: DataFrame, value: float) -> DataFrame:
    return map_blocks(blocks, partial(K.threshold, value=value))


def mean_threshold(blocks: DataFrame, offset_sd: float = 0.0) -> DataFrame:
    return map_blocks(blocks, partial(K.mean_threshold, offset_sd=offset_sd))


def local_maxima(blocks: DataFrame, radius: int, mask: DataFrame | None = None) -> DataFrame:
    if mask is None:
        return map_blocks(blocks, partial(K.local_maxima, radius=radius))
    return map_aligned(lambda b, m: K.local_maxima(b, radius, m), blocks, mask)


def watershed(blocks: DataFrame, markers: DataFrame, mask: DataFrame) -> DataFrame:
    """Labels flooded from markers inside the mask, chunk by chunk."""
    return map_aligned(K.watershed, blocks, markers, mask)


def mask_blocks(blocks: DataFrame, mask: DataFrame) -> DataFrame:
    return map_aligned(lambda b, m: np.where(m > 0, b, 0).astype(b.dtype), blocks, mask)


def detection_front(blocks: DataFrame, radius: int = 10, sigma1: float = 1, sigma2: float = 4, sigma_mean: float = 101, value: float = 100, dtype: str = "f4") -> DataFrame:
    """Top-hat, difference of Gaussians, subtraction of the local mean and threshold as one pass over the blocks."""
    return map_blocks(blocks, K.chain(partial(K.tophat, radius=radius), partial(K.dog, sigma1=sigma1, sigma2=sigma2, dtype=dtype), partial(K.subtract_gaussian, sigma=sigma_mean, dtype=dtype), partial(K.threshold, value=value)))


def footprint(spark, radius: int, closed: bool = True) -> DataFrame:
    """(dz, dy, dx) of a ball, from three sequences; its size follows the radius alone."""
    r = spark.range(-radius, radius + 1)
    cube = r.toDF("dz").crossJoin(r.toDF("dy")).crossJoin(r.toDF("dx"))
    d = F.col("dz") * F.col("dz") + F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    return cube.where(d <= radius * radius if closed else d < radius * radius)


def footprints(radii: DataFrame) -> DataFrame:
    """(radius, dz, dy, dx) of the closed ball of each radius of a table: sequences of the row itself, no cross join."""
    span = lambda c: F.explode(F.sequence(-F.col("radius"), F.col("radius"))).alias(c)
    cube = radii.select("radius", span("dz")).select("*", span("dy")).select("*", span("dx"))
    return cube.where("dz * dz + dy * dy + dx * dx <= radius * radius")


def _frame(radius: int, by: str, *order: str):
    return Window.partitionBy(by).orderBy(*order).rowsBetween(-radius, radius)


def maxima_1d(signal: DataFrame, radius: int, by: str, order: tuple[str, ...], v: str = "v") -> DataFrame:
    """Rows of each signal that are the maximum of their frame."""
    return signal.withColumn("_m", F.max(v).over(_frame(radius, by, *order))).where(F.col(v) == F.col("_m")).drop("_m")


def tophat_1d(signal: DataFrame, radius: int, by: str, order: tuple[str, ...], v: str = "v", name: str = "tophat") -> DataFrame:
    w = _frame(radius, by, *order)
    opened: Column = F.max("_low").over(w)
    return signal.withColumn("_low", F.min(v).over(w)).withColumn(name, F.greatest(F.col(v) - opened, F.lit(0))).drop("_low")
