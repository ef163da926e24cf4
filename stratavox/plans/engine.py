"""The pipeline as steps from table to table, with the names and order of a project run."""

from __future__ import annotations

import logging
import time
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.operators import combine, labels, mapping, objects, ontology, raster, resample, stencils
from stratavox.operators import volumes as V
from stratavox.plans.catalog import Catalog, discover_projects
from stratavox.plans.config import Config
from stratavox.plans.schema import CHUNK, COORDS, MEASURES
from stratavox.runtime import counted, read_text, seen, settle
from stratavox.sources.volumes import read_volume

log = logging.getLogger("stratavox")
LOG = "step string, table string, rows long, bytes long, seconds double, ended timestamp"


@dataclass(frozen=True)
class Step:
    name: str
    reads: tuple[str, ...]
    writes: tuple[str, ...]
    run: Callable[[Engine], Mapping[str, DataFrame]]


STEPS: dict[str, Step] = {}


def step(reads: Sequence[str], writes: Sequence[str]):
    def add(fn):
        STEPS[fn.__name__] = Step(fn.__name__, tuple(reads), tuple(writes), fn)
        return fn

    return add


@dataclass
class Engine:
    """A project: configuration, tables, and the transforms that registration gave."""

    spark: SparkSession
    root: str
    config: Config = field(default_factory=Config)
    tuning: bool = False
    transforms: Sequence[mapping.Affine | mapping.BSpline] = ()

    @property
    def catalog(self) -> Catalog:
        return Catalog(self.spark, self.root, self.tuning)

    def read(self, name: str) -> DataFrame:
        return self.catalog.read(name)

    def run(self, steps: Sequence[str] | None = None, overwrite: bool = False) -> list[str]:
        """Run steps in order and return those that ran. A step whose tables are all complete is skipped unless
        overwrite is set; a step without its inputs is an error."""
        ran = []
        for name in steps or [*STEPS]:
            s = STEPS[name]
            if not overwrite and s.writes and not self.catalog.missing(s.writes):
                log.info("step=%s skipped", name)
                continue
            if gone := self.catalog.missing(s.reads):
                raise FileNotFoundError(f"{name} needs {', '.join(gone)}")
            for out, df in s.run(self).items():
                began = time.monotonic()
                rows, by = counted(df, bytes=F.length("data") if "data" in df.columns else F.lit(0))
                self.catalog.write(out, rows)
                self._note(name, out, seen(by), seen(by, "bytes"), time.monotonic() - began)
            ran.append(name)
        return ran

    def _note(self, step: str, table: str, rows: int, size: int, seconds: float) -> None:
        """A row of the log table, of what went by while the table was written."""
        log.info("step=%s tuning=%s table=%s rows=%s bytes=%s seconds=%.2f", step, self.tuning, table, rows, size, seconds)
        self.catalog.append("log", self.spark.createDataFrame([(step, table, rows, size, seconds, datetime.now())], LOG))

    def log_table(self) -> DataFrame:
        """(step, table, rows, bytes, seconds, ended) of the tables written so far: rows are blocks where a table has blocks, of so
        many bytes."""
        return self.read("log")

    # ---- volume facts -------------------------------------------------------------------------------------------

    def grid(self, name: str = "raw") -> tuple[int, int, int]:
        """Chunks along each axis; an aggregate over stored origins."""
        r = self.read(name).agg(*[F.max(c).alias(c) for c in CHUNK]).first()
        return tuple(int(r[c]) + 1 for c in CHUNK)

    def shape(self, name: str = "raw") -> tuple[int, int, int]:
        r = self.read(name).agg(*[F.max(F.col(o) + F.col(n)).alias(c) for c, o, n in zip(COORDS, ("z0", "y0", "x0"), ("nz", "ny", "nx"), strict=True)]).first()
        return tuple(int(r[c]) for c in COORDS)

    def offset(self) -> tuple[int, int, int]:
        """Where the tuning crop starts in the whole volume."""
        return tuple(s.start or 0 for s in self.config.tuning_trim.slices()) if self.tuning else (0, 0, 0)

    # ---- ingest -------------------------------------------------------------------------------------------------

    def ingest(self, path: str) -> DataFrame:
        """Raw volume from files."""
        return self.catalog.write("raw", read_volume(self.spark, path, self.config.chunks.shape()))

    def make_tuning(self) -> None:
        """The raw volume of the tuning twin: whole blocks outside the crop are never read."""
        whole = Catalog(self.spark, self.root, False).read("raw")
        s = self.config.tuning_trim.slices()
        shape = Engine(self.spark, self.root, self.config).shape()
        at = [x.indices(n) for x, n in zip(s, shape, strict=True)]
        near = V.prune_blocks(whole, [a for a, _, _ in at], [z for _, z, _ in at])
        vox = V.crop(V.blocks_to_voxels(near), s, shape)
        size = [len(range(*a)) for a in at]
        Catalog(self.spark, self.root, True).write("raw", V.voxels_to_blocks(vox, self.config.chunks.shape(), size, "uint16"))

    def set_ontology(self, onto: DataFrame) -> None:
        ontology.check_tree(onto)
        self.catalog.write("onto", onto)


def rechunk_raw(e: Engine) -> bool:
    """Bring the raw volume to the configured chunks; nothing happens if it has them."""
    want = e.config.chunks.shape()
    first = e.read("raw").agg(*[F.max(n).alias(n) for n in ("nz", "ny", "nx")]).first()
    if tuple(first) == tuple(min(a, b) for a, b in zip(want, e.shape(), strict=True)):
        return False
    e.catalog.write("raw", settle(V.rechunk(e.read("raw"), want), "rechunk"))
    return True


# ---- registration: all but the optimisation itself, whose parameters are an input ------------------------------------


def prepare_reference(e: Engine, ref: DataFrame, annot: DataFrame, shape: Sequence[int]) -> None:
    """Atlas voxels in the orientation and crop of the project."""
    r = e.config.registration
    for name, vox in (("ref", ref), ("annot", annot)):
        turned = V.reorient(vox, r.ref_orientation, shape)
        new_shape = [shape[abs(o) - 1] for o in r.ref_orientation]
        e.catalog.write(name, V.crop(turned, r.ref_trim.slices(), new_shape))


@step(["raw"], ["downsmpl1"])
def reg_img_rough(e: Engine) -> dict:
    return {"downsmpl1": V.blocks_to_voxels(V.stride_blocks(e.read("raw"), e.config.registration.downsample_rough)).select(*COORDS, "v")}


@step(["downsmpl1"], ["downsmpl2"])
def reg_img_fine(e: Engine) -> dict:
    shape = [int(n) + 1 for n in e.read("downsmpl1").agg(*[F.max(c) for c in COORDS]).first()]
    slabs = V.voxels_to_blocks(e.read("downsmpl1"), resample.SLAB, shape, "float64")
    fine = V.map_blocks(resample.zoom(slabs, shape, e.config.registration.downsample_fine), np.rint)
    return {"downsmpl2": V.blocks_to_voxels(fine).select(*COORDS, "v")}


@step(["downsmpl2"], ["trimmed"])
def reg_img_trim(e: Engine) -> dict:
    shape = [int(n) + 1 for n in e.read("downsmpl2").agg(*[F.max(c) for c in COORDS]).first()]
    return {"trimmed": V.crop(e.read("downsmpl2"), e.config.registration.reg_trim.slices(), shape)}


@step(["trimmed"], ["bounded"])
def reg_img_bound(e: Engine) -> dict:
    r = e.config.registration
    return {"bounded": e.read("trimmed").withColumn("v", V.map_bounds(r.lower_bound, r.lower_bound_mapto, r.upper_bound, r.upper_bound_mapto))}


# ---- detection --------------------------------------------------------------------------------------------------------


@step(["raw"], ["bgrm"])
def tophat_filter(e: Engine) -> dict:
    return {"bgrm": stencils.tophat(e.read("raw"), e.config.cell_counting.tophat_radius)}


@step(["bgrm"], ["dog"])
def dog_filter(e: Engine) -> dict:
    c = e.config.cell_counting
    return {"dog": stencils.dog(e.read("bgrm"), c.dog_sigma1, c.dog_sigma2)}


@step(["dog"], ["adaptv"])
def adaptive_threshold_prep(e: Engine) -> dict:
    return {"adaptv": stencils.subtract_gaussian(e.read("dog"), e.config.cell_counting.large_gauss_radius)}


@step(["adaptv"], ["threshd"])
def threshold(e: Engine) -> dict:
    return {"threshd": stencils.threshold(e.read("adaptv"), e.config.cell_counting.threshd_value)}


@step(["threshd"], ["threshd_labels"])
def label_thresholded(e: Engine) -> dict:
    return {"threshd_labels": labels.label_blocks(e.read("threshd"), e.config.chunks.shape(), e.grid())}


def _volumes(e: Engine, name: str) -> DataFrame:
    blocks = e.read(name)
    table = labels.block_component_table(blocks, e.config.chunks.shape())
    return labels.scatter_volumes(blocks, table)


@step(["threshd_labels"], ["threshd_volumes"])
def compute_thresholded_volumes(e: Engine) -> dict:
    return {"threshd_volumes": _volumes(e, "threshd_labels")}


def _between(low: int, high: int):
    return lambda b: ((b >= low) & (b <= high)) * b


@step(["threshd_volumes"], ["threshd_filt"])
def filter_thresholded(e: Engine) -> dict:
    c = e.config.cell_counting
    return {"threshd_filt": V.map_blocks(e.read("threshd_volumes"), _between(c.min_threshd_size, c.max_threshd_size))}


@step(["adaptv", "threshd_filt"], ["maxima"])
def detect_maxima(e: Engine) -> dict:
    return {"maxima": stencils.local_maxima(e.read("adaptv"), e.config.cell_counting.maxima_radius, e.read("threshd_filt"))}


@step(["maxima"], ["maxima_labels"])
def label_maxima(e: Engine) -> dict:
    return {"maxima_labels": labels.label_blocks(e.read("maxima"), e.config.chunks.shape(), e.grid())}


@step(["adaptv", "maxima_labels", "threshd_filt"], ["wshed_labels"])
def watershed(e: Engine) -> dict:
    return {"wshed_labels": stencils.watershed(e.read("adaptv"), e.read("maxima_labels"), e.read("threshd_filt"))}


@step(["wshed_labels"], ["wshed_volumes"])
def compute_watershed_volumes(e: Engine) -> dict:
    return {"wshed_volumes": _volumes(e, "wshed_labels")}


@step(["wshed_volumes"], ["wshed_filt"])
def filter_watershed(e: Engine) -> dict:
    c = e.config.cell_counting
    return {"wshed_filt": V.map_blocks(e.read("wshed_volumes"), _between(c.min_wshed_size, c.max_wshed_size))}


@step(["raw", "maxima_labels", "wshed_labels", "wshed_filt"], ["cells_raw"])
def save_cells_table(e: Engine) -> dict:
    cells = objects.extract_from_blocks(*[e.read(n) for n in ("raw", "maxima_labels", "wshed_labels", "wshed_filt")])
    return {"cells_raw": objects.shift(cells, e.offset())}


# ---- mapping ----------------------------------------------------------------------------------------------------------


@step(["cells_raw"], ["cells_trfm"])
def transform_coords(e: Engine) -> dict:
    r = e.config.registration
    cells = e.read("cells_raw")
    kept = cells.select("*", *[F.col(c).alias(f"_{c}") for c in COORDS])  # places in the raw volume stay beside the new ones
    scaled = mapping.scale_coords(kept, r.downsample_rough, r.downsample_fine, [s.start for s in r.reg_trim.slices()])
    moved = mapping.transform_points(scaled, e.transforms)
    return {"cells_trfm": moved.withColumns({c: F.col(f"_{c}") for c in COORDS}).select(*cells.columns, "z_trfm", "y_trfm", "x_trfm")}


def atlas_shape(e: Engine) -> tuple[int, int, int]:
    return tuple(int(n) + 1 for n in e.read("annot").agg(*[F.max(c) for c in COORDS]).first())


@step(["cells_trfm", "annot", "onto"], ["cells"])
def cell_mapping(e: Engine) -> dict:
    atlas = e.read("annot")
    named = mapping.region_at(e.read("cells_trfm"), atlas.select(*COORDS, F.col("v").alias("id")), atlas_shape(e))
    return {"cells": ontology.with_regions(named, e.read("onto"))}


@step(["cells", "onto"], ["cells_agg"])
def group_cells(e: Engine) -> dict:
    return {"cells_agg": ontology.group_cells(e.read("cells"), e.read("onto"))}


def cells2csv(e: Engine) -> str:
    e.catalog.write_csv("cells_agg_csv", e.read("cells_agg").orderBy("id"))
    return e.catalog.path("cells_agg_csv")


# ---- visual checks ----------------------------------------------------------------------------------------------------


def _trfm_points(e: Engine) -> DataFrame:
    return e.read("cells_trfm").select(*[F.col(f"{c}_trfm").alias(c) for c in COORDS])


def coords2points_raw(e: Engine) -> DataFrame:
    return e.catalog.write("points_raw", raster.count_points(e.read("cells_raw"), e.shape()))


def coords2heatmap_raw(e: Engine) -> DataFrame:
    return e.catalog.write("heatmap_raw", raster.count_spheres(e.read("cells_raw"), e.shape(), e.config.visual_check.heatmap_raw_radius))


def coords2points_trfm(e: Engine) -> DataFrame:
    return e.catalog.write("points_trfm", raster.mark_points(_trfm_points(e), atlas_shape(e)))


def coords2heatmap_trfm(e: Engine) -> DataFrame:
    return e.catalog.write("heatmap_trfm", raster.mark_spheres(_trfm_points(e), atlas_shape(e), e.config.visual_check.heatmap_trfm_radius))


def combine_reg(e: Engine) -> DataFrame:
    return e.catalog.write("comb_reg", V.stack_channels(*[e.read(n) for n in ("trimmed", "bounded", "regresult")]))


def combine_cellc(e: Engine) -> DataFrame:
    """Raw and both filtered volumes side by side, on the check crop unless the project is a tuning twin."""
    parts = [e.read(n) for n in ("raw", "threshd_filt", "wshed_filt")]
    s, shape = e.config.visual_check.cellcount_trim.slices(), e.shape()
    if not e.tuning:
        at = [x.indices(n) for x, n in zip(s, shape, strict=True)]
        parts = [V.prune_blocks(p, [a for a, _, _ in at], [z for _, z, _ in at]) for p in parts]
    vox = [V.blocks_to_voxels(p) for p in parts]
    return e.catalog.write("comb_cellc", V.stack_channels(*(vox if e.tuning else [V.crop(v, s, shape) for v in vox])))


def combine_heatmap_trfm(e: Engine) -> DataFrame:
    heat = e.read("heatmap_trfm").withColumnRenamed("n", "v")
    return e.catalog.write("comb_heatmap", V.stack_channels(e.read("ref"), e.read("annot"), heat))


# ---- projects ---------------------------------------------------------------------------------------------------------


def combine_projects(spark: SparkSession, root: str, out: str) -> DataFrame:
    """The aggregates of all projects under a folder as one wide table, written as Parquet and CSV.

    Projects mapped to different atlases are refused.
    """
    names = discover_projects(spark, root)
    if not names:
        raise FileNotFoundError(f"no project under {root}")
    configs = {}
    for n in names:
        configs[n] = Config.parse(read_text(spark, f"{root}/{n}/config.yaml")).to_dict()["reference"]
    combine.check_same_atlas(configs)
    tables = {n: Catalog(spark, f"{root}/{n}").read("cells_agg") for n in names}
    onto = Catalog(spark, f"{root}/{names[0]}").read("onto")
    wide = combine.wide_table(spark, onto, tables, MEASURES)
    wide.write.mode("overwrite").parquet(f"{out}/combined")
    done = spark.read.parquet(f"{out}/combined")
    done.orderBy("id").coalesce(1).write.mode("overwrite").csv(f"{out}/combined_csv", header=True)
    return done


QUARANTINE = "specimen string, stage string, reason string"


def run_projects(spark: SparkSession, root: str, steps: Sequence[str] | None = None, overwrite: bool = False, transforms: Mapping[str, Sequence] | None = None) -> DataFrame:
    """The steps of every project under a folder; one that fails leaves the others alone. Returns (specimen, stage, reason) of the
    failures, which also go to the table `quarantine` under the folder."""
    failed = []
    for name in discover_projects(spark, root):
        stage = "configuration"
        try:
            e = Engine(spark, f"{root}/{name}", Config.parse(read_text(spark, f"{root}/{name}/config.yaml")), transforms=(transforms or {}).get(name, ()))
            for stage in steps or [*STEPS]:  # noqa: B007
                e.run([stage], overwrite)
        except Exception as e:
            log.exception("specimen=%s stage=%s failed", name, stage)
            failed.append((name, stage, f"{type(e).__name__}: {e}"[:500]))
    spark.createDataFrame(failed, QUARANTINE).coalesce(1).write.mode("overwrite").parquet(f"{root}/quarantine")
    return spark.read.schema(QUARANTINE).parquet(f"{root}/quarantine")


def _usable(spark: SparkSession, root: str, name: str) -> tuple[str, str, dict]:
    """The path of a project's mapped cells, why they can't be used (or nothing), and the reference they were mapped to."""
    table = Catalog(spark, f"{root}/{name}")
    try:
        reference = Config.parse(read_text(spark, f"{root}/{name}/config.yaml")).to_dict()["reference"]
    except Exception as e:
        return table.path("cells"), f"configuration: {e}"[:500], {}
    if not table.exists("cells"):
        return table.path("cells"), "its cells are not complete", reference
    try:
        lacking = {"id", *MEASURES[:3]} - set(table.read("cells").columns)
    except Exception as e:
        return table.path("cells"), f"its cells can't be read: {e}"[:500], reference
    return table.path("cells"), f"columns lacking: {', '.join(sorted(lacking))}" if lacking else "", reference


def combine_batch(spark: SparkSession, root: str, out: str) -> DataFrame:
    """The cells of all projects under a folder as one report, from one scan and one roll-up keyed by specimen.

    Projects without a valid configuration, without complete and readable cells, or mapped to another atlas than most, are rows
    of the table `quarantine`; the others are complete in `report`, partitioned by specimen. Returns the report.
    """
    names = discover_projects(spark, root)
    found = {n: _usable(spark, root, n) for n in names}
    key = lambda reference: tuple(sorted((k, str(v)) for k, v in reference.items()))
    votes = Counter(key(ref) for _, why, ref in found.values() if not why)
    common = votes.most_common(1)[0][0] if votes else None
    reason = {n: why or ("" if key(ref) == common else "mapped to another atlas than most") for n, (_, why, ref) in found.items()}
    spark.createDataFrame([(n, "combine", why) for n, why in reason.items() if why], QUARANTINE).coalesce(1).write.mode("overwrite").parquet(f"{out}/quarantine")
    good = [n for n in names if not reason[n]]
    if not good:
        raise FileNotFoundError(f"no usable project under {root}")
    place = F.url_decode(F.replace(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+/cells/[^/]+$", 1), F.lit("+"), F.lit("%2B")))
    read = spark.read.parquet(*[found[n][0] for n in good]).select(place.alias("specimen"), "id", *MEASURES[:3])
    cells, by = counted(read)
    agg = ontology.group_cells(cells, Catalog(spark, f"{root}/{good[0]}").read("onto"), "specimen", good)
    agg.write.mode("overwrite").partitionBy("specimen").parquet(f"{out}/report")
    log.info("read %s cells of %s specimens, %s set aside", seen(by), len(good), len(names) - len(good))
    return spark.read.parquet(f"{out}/report")


def update_config(path: str, new: str) -> Config:
    """Validate a configuration file, then make it the project's."""
    config = Config.read(new)
    config.write(path)
    return config
