"""python -m stratavox make-project DIR | run DIR [--raw PATH] [--tuning] [--steps A,B] [--overwrite] | combine ROOT OUT | batch ROOT OUT"""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import SparkSession

from stratavox.operators.mapping import parse_files
from stratavox.plans.config import Config
from stratavox.plans.engine import Engine, cells2csv, combine_batch, combine_projects, run_projects
from stratavox.runtime import read_text


def make_project(folder: str) -> str:
    """A project folder with the default configuration; an existing configuration is kept."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "config.yaml")
    if not os.path.exists(path):
        Config().write(path)
    return path


def load_transforms(spark: SparkSession, folder: str) -> list:
    """The transforms of TransformParameters.*.txt files of a folder, as a chain or in natural order of their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "TransformParameters.*.txt").load(folder).select("path").collect()
    return parse_files({r["path"]: read_text(spark, r["path"]) for r in files})


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="stratavox", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("make-project").add_argument("folder")
    run = sub.add_parser("run")
    run.add_argument("folder")
    run.add_argument("--raw")
    run.add_argument("--tuning", action="store_true")
    run.add_argument("--steps")
    run.add_argument("--overwrite", action="store_true")
    join = sub.add_parser("combine")
    join.add_argument("root")
    join.add_argument("out")
    batch = sub.add_parser("batch", help="all steps of all projects, then one report; failures are set aside")
    batch.add_argument("root")
    batch.add_argument("out")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    if args.command == "make-project":
        print(make_project(args.folder))
        return
    spark = SparkSession.builder.appName("stratavox").getOrCreate()
    if args.command == "combine":
        combine_projects(spark, args.root, args.out)
        return
    if args.command == "batch":
        run_projects(spark, args.root)
        combine_batch(spark, args.root, args.out)
        return
    config = Config.parse(read_text(spark, f"{args.folder}/config.yaml"))
    found = f"{args.folder.rstrip('/')}/registration/parameters"
    engine = Engine(spark, args.folder, config, args.tuning)
    if args.raw:
        engine.ingest(args.raw)
    try:
        engine.transforms = load_transforms(spark, found)
    except Exception as e:
        logging.getLogger("stratavox").warning("no transforms in %s: coordinates stay as scaled (%s)", found, type(e).__name__)
    ran = engine.run(args.steps.split(",") if args.steps else None, args.overwrite)
    if "group_cells" in ran:
        cells2csv(engine)
    print("\n".join(ran))


if __name__ == "__main__":
    main()
