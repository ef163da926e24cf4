"""Regional report of a collection of specimens, all in one plan: counts, sizes and densities rolled up a region tree.

python -m jobs.collection_report --input DIR --output DIR [--settings FILE]

The objects are texts here. A source is a specimen, a language a region with the marks of its texts (good, poor, unmarked) below it, the
volume of an object its words and the intensity its characters, so that iov is characters per word.

    objects/specimen=S      each object with its region and measures, or with the reason why it can't be placed
    report/specimen=S       each region of the tree with the sums of all below it, as for volumes of images
    quarantine/reason=R     objects that can't be placed
    specimens               objects, those placed, and whether the specimen is in the report

One object that can't be read doesn't stop its specimen, and one specimen that is mostly unreadable doesn't stop the others: it
is set aside. Texts are read once; all else comes from the objects. A run replaces the whole output, so running again gives the
same, also after a failure.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from stratavox.operators.ontology import group_cells
from stratavox.runtime import counted, restored, seen

#: Words of a text, as the text operators count them.
WORDS = r"[^\x20\x09-\x0D]+"
NO_SPECIMEN = "unassigned"


def measured(docs: DataFrame, marks: DataFrame, s: Mapping[str, Any]) -> DataFrame:
    """(object, specimen, region, leaf, count, volume, sum_intensity, reason): one row per object, reason null if it can be placed."""
    text, region, key = F.col("text"), F.col("region"), F.col("object")
    rows = docs.select(F.col(s["id"]).alias("object"), F.col(s["text"]).alias("text"), F.col(s["specimen"]).alias("specimen"), F.col(s["region"]).alias("region"))
    # a row per object on this side, so objects are not multiplied
    mark = marks.where(F.col(s["id"]).isNotNull()).groupBy(F.col(s["id"]).alias("object")).agg(F.max(s["mark"]).alias("mark"))
    reason = F.when(key.isNull(), "no id").when(F.col("specimen").isNull(), "no specimen").when(region.isNull(), "no region").when(F.coalesce(F.length(text), F.lit(0)) == 0, "no text")
    words = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))).cast("long")
    rows = rows.select("object", F.coalesce("specimen", F.lit(NO_SPECIMEN)).alias("specimen"), "region", F.lit(1).cast("long").alias("count"), words.alias("volume"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("sum_intensity"), reason.alias("reason"))
    named = F.lit(None).cast("string")
    for value, name in s["mark_names"].items():
        named = F.when(F.col("mark") == value, name).otherwise(named)
    leaf = F.concat_ws("/", "region", F.coalesce(named, F.lit(s["unmarked"])))
    return rows.join(mark, "object", "left").select("object", "specimen", "region", leaf.alias("leaf"), "count", "volume", "sum_intensity", "reason")


def region_tree(objects: DataFrame) -> DataFrame:
    """The tree as an ontology table: all, the regions, and their leaves; ids are hashes of the names."""
    leaf = objects.where("reason is null").select("region", "leaf").distinct()
    levels = leaf.select(F.explode(F.array(F.struct(F.lit("all").alias("name"), F.lit(None).cast("string").alias("parent")), F.struct(F.col("region").alias("name"), F.lit("all").alias("parent")), F.struct(F.col("leaf").alias("name"), F.col("region").alias("parent")))).alias("n"))
    tree = levels.select("n.*").distinct()
    return tree.select(_id("name"), F.col("name"), F.col("name").alias("acronym"), F.lit(None).cast("string").alias("color_hex_triplet"), _id("parent", "parent_structure_id"))


def _id(name: str, alias: str = "id") -> Column:
    return F.when(F.col(name).isNotNull(), F.xxhash64(name)).alias(alias)


def run(spark: SparkSession, source: str, output: str, s: Mapping[str, Any]) -> dict[str, int]:
    """Read, measure, roll up and write; returns what was read and written."""
    with restored(spark):
        docs, marks = (spark.read.parquet(f"{source.rstrip('/')}/{s[t]}") for t in ("table", "marks"))
        rows, read = counted(measured(docs, marks, s), unplaced=F.col("reason").isNotNull().cast("long"))
        # large specimens are spread over several files, small ones share a task
        rows.hint("rebalance", F.col("specimen")).write.mode("overwrite").partitionBy("specimen").parquet(f"{output}/objects")
        schema = "object long, region string, leaf string, count long, volume long, sum_intensity long, reason string, specimen string"
        objects = spark.read.schema(schema).parquet(f"{output}/objects")

        share = F.col("objects") - F.col("placed")
        status = objects.groupBy("specimen").agg(F.count("*").alias("objects"), F.count(F.when(F.col("reason").isNull(), 1)).alias("placed"))
        status = status.withColumn("status", F.when(share > F.col("objects") * F.lit(float(s["most_unplaced"])), "set aside").otherwise("complete"))
        status.write.mode("overwrite").parquet(f"{output}/specimens")
        status = spark.read.parquet(f"{output}/specimens")
        names = sorted(r["specimen"] for r in status.where("status = 'complete'").select("specimen").collect())  # a name per specimen

        placed = objects.where("reason is null").join(status.where("status = 'complete'"), "specimen", "left_semi")
        cells = placed.select(_id("leaf"), "specimen", "count", "volume", "sum_intensity")
        agg = group_cells(cells, region_tree(placed), "specimen", names)
        report, wrote = counted(agg.select(F.col("name").alias("region"), F.col("parent_acronym").alias("parent"), "count", "volume", "sum_intensity", "iov", "specimen"))
        report.hint("rebalance", F.col("specimen")).write.mode("overwrite").partitionBy("specimen").parquet(f"{output}/report")

        bad, kept = counted(objects.where("reason is not null").select("object", "specimen", "region", "reason"))
        bad.write.mode("overwrite").partitionBy("reason").parquet(f"{output}/quarantine")
    done = {"read": seen(read, "rows"), "unplaced": seen(read, "unplaced"), "specimens": len(names), "report": seen(wrote, "rows"), "quarantine": seen(kept, "rows")}
    log.info("read %(read)s objects, %(unplaced)s of them without a place; wrote %(report)s rows of %(specimens)s specimens and %(quarantine)s in quarantine", done)
    return done


def read_output(spark: SparkSession, output: str) -> DataFrame:
    """The report, each row with what its specimen holds; specimens that were set aside have one row without a region."""
    report = spark.read.schema("region string, parent string, count long, volume long, sum_intensity long, iov double, specimen string").parquet(f"{output}/report")
    return spark.read.parquet(f"{output}/specimens").join(report, "specimen", "left")


if __name__ == "__main__":
    command_line(__file__, __doc__, lambda spark, args, s: run(spark, args.input, args.output, s))
