"""Where the tables of a project lie, in any store that Spark reads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Artefact -> folder; those marked with a star have a twin for the tuning crop.
FOLDERS = {
    "raw": "*raw", "bgrm": "*cellcount", "dog": "*cellcount", "adaptv": "*cellcount", "threshd": "*cellcount", "threshd_labels": "*cellcount", "threshd_volumes": "*cellcount", "threshd_filt": "*cellcount",
    "maxima": "*cellcount", "maxima_labels": "*cellcount", "wshed_labels": "*cellcount", "wshed_volumes": "*cellcount", "wshed_filt": "*cellcount",
    "cells_raw": "*analysis", "cells_trfm": "*analysis", "cells": "*analysis", "cells_agg": "*analysis", "cells_agg_csv": "*analysis",
    "ref": "registration", "annot": "registration", "onto": "registration", "transforms": "registration", "downsmpl1": "registration", "downsmpl2": "registration", "trimmed": "registration", "bounded": "registration", "regresult": "registration",
    "log": "*log",
    "points_raw": "*visual", "heatmap_raw": "*visual", "points_trfm": "*visual", "heatmap_trfm": "*visual", "comb_reg": "visual", "comb_cellc": "*visual", "comb_heatmap": "*visual",
}


@dataclass(frozen=True)
class Catalog:
    """Paths under one project folder; a table counts as present once it is complete."""

    spark: SparkSession
    root: str
    tuning: bool = False

    def path(self, name: str) -> str:
        folder = FOLDERS[name]
        twin = "_tuning" if self.tuning and folder.startswith("*") else ""
        return f"{self.root.rstrip('/')}/{folder.lstrip('*')}{twin}/{name}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p, jvm

    def exists(self, name: str) -> bool:
        """Whether the table was written to its end: a partial one doesn't count."""
        fs, _, jvm = self._fs(self.path(name))
        return fs.exists(jvm.org.apache.hadoop.fs.Path(self.path(name) + "/_SUCCESS"))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> None:
        df.coalesce(1).write.mode("append").parquet(self.path(name))

    def write_csv(self, name: str, df: DataFrame) -> None:
        """One file with a header; only for aggregates, whose rows are bounded by the ontology."""
        df.coalesce(1).write.mode("overwrite").csv(self.path(name), header=True)

    def drop(self, name: str) -> bool:
        """Remove a table; nothing happens if there is none."""
        fs, p, _ = self._fs(self.path(name))
        return bool(fs.delete(p, True)) if fs.exists(p) else False

    def clean(self) -> None:
        """Remove the cell counting tables, those of the tuning crop too."""
        for tuning in (False, True):
            twin = Catalog(self.spark, self.root, tuning)
            for name, folder in FOLDERS.items():
                if folder == "*cellcount":
                    twin.drop(name)

    def missing(self, names: Sequence[str]) -> list[str]:
        return [n for n in names if not self.exists(n)]


def natural_order(names: Sequence[str]) -> list[str]:
    from stratavox.operators.mapping import natural_key

    return sorted(names, key=natural_key)


def discover_projects(spark: SparkSession, root: str, marker: str = "config.yaml") -> list[str]:
    """Names of the subfolders with a configuration file, in natural order."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), marker))]
    return natural_order(found)
