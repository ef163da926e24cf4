"""Aggregates of many specimens in one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.operators.ontology import with_parents
from stratavox.plans.schema import ANNOTATIONS, INVALID, MEASURES, UNIVERSE


def annotation_base(spark: SparkSession, onto: DataFrame) -> DataFrame:
    """The ontology's columns of the combined table, with rows for the invalid region and the universe."""
    extra = spark.createDataFrame([INVALID, UNIVERSE], "id long, name string")
    return with_parents(onto).select("id", *ANNOTATIONS).unionByName(extra, allowMissingColumns=True)


def together(specimens: Mapping[str, DataFrame], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Aggregates of specimens that have a table each as one table with a column `specimen`."""
    out = None
    for name, agg in specimens.items():
        row = agg.select("id", F.lit(name).alias("specimen"), *measures)
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no specimen")
    return out


def long_table(specimens: Mapping[str, DataFrame] | DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """(id, specimen, measure, value) of aggregates: a table for each specimen, or one with a column `specimen`."""
    agg = together(specimens, measures) if isinstance(specimens, Mapping) else specimens
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
    return agg.select("id", "specimen", each.alias("m")).select("id", "specimen", "m.*")


def wide_table(spark: SparkSession, onto: DataFrame, specimens: Mapping[str, DataFrame] | DataFrame, measures: Sequence[str] = MEASURES, names: Sequence[str] = ()) -> DataFrame:
    """One row per region id of the ontology or of any specimen, columns <specimen>__<measure>. One table of all specimens needs
    their `names`.

    One grouping of the aggregates instead of a chain of full outer joins; the annotation joins once.
    """
    keys = [f"{s}__{m}" for s in names or specimens for m in measures]
    table = long_table(specimens, measures).withColumn("key", F.concat_ws("__", "specimen", "measure"))
    pivoted = table.groupBy("id").pivot("key", keys).agg(F.first("value"))
    return annotation_base(spark, onto).join(pivoted, "id", "full").select("id", *ANNOTATIONS, *[F.col(f"`{k}`") for k in keys])


def check_same_atlas(configs: Mapping[str, Mapping]) -> None:
    """All specimens must have been mapped to the same reference; the names that differ are in the error."""
    seen: dict[tuple, list[str]] = {}
    for name, ref in configs.items():
        seen.setdefault(tuple(sorted((k, str(v)) for k, v in ref.items())), []).append(name)
    if len(seen) > 1:
        raise ValueError("specimens use different atlases: " + "; ".join(", ".join(v) for v in seen.values()))
