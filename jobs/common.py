"""What the jobs share: settings, the command line, tables that may not be there yet."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from stratavox.runtime import path_exists, read_text

log = logging.getLogger("stratavox.jobs")


def defaults(job_file: str) -> dict[str, Any]:
    """The settings beside a job's file, under the same name with the ending .yaml."""
    return yaml.safe_load(Path(job_file).with_suffix(".yaml").read_text())


def settings(spark: SparkSession, job_file: str, path: str | None) -> dict[str, Any]:
    """The defaults with what a settings file, in any store, says instead; names that no default has are errors."""
    own = defaults(job_file)
    given = yaml.safe_load(read_text(spark, path)) if path else {}
    if unknown := set(given or {}) - set(own):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return own | (given or {})


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table that may not have been written yet."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def command_line(job_file: str, doc: str, job: Callable[[SparkSession, argparse.Namespace, Mapping[str, Any]], Any], *options: str) -> None:
    """Parse the arguments, open a session, run the job and close the session again."""
    parser = argparse.ArgumentParser(description=doc)
    for o in ("input", "output", *options):
        parser.add_argument(f"--{o}", required=True)
    parser.add_argument("--settings", help="a YAML file; what it leaves out is as in the file beside the job")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(Path(job_file).stem).getOrCreate()
    try:
        job(spark, args, settings(spark, job_file, args.settings))
    finally:
        spark.stop()
