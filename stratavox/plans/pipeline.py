"""A project object with one method per step, for scripts that run steps by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from stratavox.operators import mapping, ontology
from stratavox.operators import volumes as V
from stratavox.plans import engine as E
from stratavox.plans.catalog import Catalog
from stratavox.plans.config import Config
from stratavox.plans.schema import COORDS
from stratavox.runtime import read_text
from stratavox.sources import tiff
from stratavox.sources.volumes import read_single

#: Where an atlas folder keeps its files (fixed values).
ATLAS_FILES = {"ref": "reference/{ref_version}.tif", "annot": "annotation/{annot_version}.tif", "map": "region_mapping/{map_version}.json"}


class Pipeline:
    """A project folder. Every step takes overwrite=False: a step whose results are complete does nothing without it.

    The configuration is read again at each use, so changes to the file count at once.
    """

    def __init__(self, proj_dir: str, *, tuning: bool = False, spark: SparkSession | None = None, transforms: Sequence[mapping.Affine | mapping.BSpline] = ()):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.proj_dir, self.tuning, self.transforms = str(proj_dir), tuning, list(transforms)

    @property
    def config(self) -> Config:
        return Config.parse(read_text(self.spark, f"{self.proj_dir}/config.yaml"))

    @property
    def engine(self) -> E.Engine:
        return E.Engine(self.spark, self.proj_dir, self.config, self.tuning, self.transforms)

    @property
    def catalog(self) -> Catalog:
        return Catalog(self.spark, self.proj_dir, self.tuning)

    @staticmethod
    def update_config(proj_dir: str, new: str) -> Config:
        return E.update_config(f"{proj_dir}/config.yaml", new)

    def run(self, steps: Sequence[str] | None = None, overwrite: bool = False) -> list[str]:
        return self.engine.run(steps, overwrite)

    # ---- ingest and registration ----------------------------------------------------------------------------------

    def tiff2zarr(self, in_fp: str, *, overwrite: bool = False) -> None:
        """Raw blocks from a folder of .tif files, one large .tif, or a .zarr folder."""
        if overwrite or not self.catalog.exists("raw"):
            self.engine.ingest(in_fp)

    def rechunk_raw(self, *, overwrite: bool = False) -> None:
        E.rechunk_raw(self.engine)

    def reg_ref_prepare(self, *, overwrite: bool = False) -> None:
        """Reference, annotation and region tree from the atlas folder, turned and cropped as configured."""
        if not overwrite and not self.catalog.missing(("ref", "annot", "onto")):
            return
        ref = self.config.reference
        at = {k: f"{ref.atlas_dir}/" + v.format(ref_version=ref.ref_version, annot_version=ref.annot_version, map_version=ref.map_version) for k, v in ATLAS_FILES.items()}
        vox, shape = {}, None
        for name in ("ref", "annot"):
            blocks = read_single(self.spark, at[name], (64, 64, 64), tiff.from_bytes)
            self.catalog.write(name, V.blocks_to_voxels(blocks, sparse=name == "annot").select(*COORDS, "v"))
            vox[name] = E.settle(self.catalog.read(name), name)
            if shape is None:
                shape = [int(n) + 1 for n in vox[name].agg({"z": "max", "y": "max", "x": "max"}).select("max(z)", "max(y)", "max(x)").first()]
        E.prepare_reference(self.engine, vox["ref"], vox["annot"], shape)
        self.engine.set_ontology(ontology.read_ontology(self.spark, at["map"]))

    def reg_elastix(self, *, overwrite: bool = False) -> None:
        raise NotImplementedError("image registration is outside this engine: give its parameter files with load_transforms()")

    def load_transforms(self, files: Sequence[str]) -> None:
        """Transform parameter files for transform_coords, as a chain or in natural order of their names."""
        self.transforms = mapping.parse_files({f: read_text(self.spark, f) for f in files})

    def make_tuning_arr(self, *, overwrite: bool = False) -> None:
        if overwrite or not Catalog(self.spark, self.proj_dir, True).exists("raw"):
            self.engine.make_tuning()

    # ---- results ----------------------------------------------------------------------------------------------------

    def cells2csv(self, *, overwrite: bool = False) -> str:
        return E.cells2csv(self.engine)

    @staticmethod
    def combine(spark: SparkSession, root_dir: str, out_dir: str) -> DataFrame:
        return E.combine_projects(spark, root_dir, out_dir)

    def clean_proj(self) -> None:
        self.catalog.clean()


def _step(name: str):
    def method(self: Pipeline, *, overwrite: bool = False) -> None:
        self.engine.run([name], overwrite)

    method.__name__, method.__doc__ = name, E.STEPS[name].run.__doc__
    return method


def _check(name: str, writes: str):
    def method(self: Pipeline, *, overwrite: bool = False) -> None:
        if overwrite or not self.catalog.exists(writes):
            getattr(E, name)(self.engine)

    method.__name__, method.__doc__ = name, getattr(E, name).__doc__
    return method


for _name in E.STEPS:
    setattr(Pipeline, _name, _step(_name))
for _name, _writes in {
    "coords2points_raw": "points_raw", "coords2heatmap_raw": "heatmap_raw", "coords2points_trfm": "points_trfm", "coords2heatmap_trfm": "heatmap_trfm",
    "combine_reg": "comb_reg", "combine_cellc": "comb_cellc", "combine_heatmap_trfm": "comb_heatmap",
}.items():
    setattr(Pipeline, _name, _check(_name, _writes))
