"""Project configuration: frozen, validated, read from and written to YAML."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any


def _positive(**values: int) -> None:
    for name, v in values.items():
        if isinstance(v, bool) or not isinstance(v, int) or v < 1:
            raise ValueError(f"{name} must be a positive whole number, not {v!r}")


@dataclass(frozen=True)
class Span:
    """start, stop and step along one axis; missing values don't bind."""

    start: int | None = None
    stop: int | None = None
    step: int | None = None

    def slice(self) -> slice:
        return slice(self.start, self.stop, self.step)


@dataclass(frozen=True)
class Box:
    z: Span = Span()
    y: Span = Span()
    x: Span = Span()

    def slices(self) -> tuple[slice, slice, slice]:
        return self.z.slice(), self.y.slice(), self.x.slice()


@dataclass(frozen=True)
class Chunks:
    z: int = 500
    y: int = 500
    x: int = 500

    def __post_init__(self) -> None:
        _positive(z=self.z, y=self.y, x=self.x)

    def shape(self) -> tuple[int, int, int]:
        return self.z, self.y, self.x


@dataclass(frozen=True)
class Cluster:
    heavy_n_workers: int = 2
    heavy_threads_per_worker: int = 1
    busy_n_workers: int = 6
    busy_threads_per_worker: int = 2

    def __post_init__(self) -> None:
        _positive(**asdict(self))


@dataclass(frozen=True)
class Reference:
    """Which atlas files belong to the project."""

    atlas_dir: str = "atlas"
    ref_version: str = "average_template_25"
    annot_version: str = "ccf_2016_25"
    map_version: str = "ABA_annotations"


@dataclass(frozen=True)
class Registration:
    ref_orientation: tuple[int, int, int] = (1, 2, 3)
    ref_trim: Box = Box()
    downsample_rough: tuple[int, int, int] = (3, 6, 6)
    downsample_fine: tuple[float, float, float] = (1.0, 0.6, 0.6)
    reg_trim: Box = Box()
    lower_bound: int = 100
    lower_bound_mapto: int = 0
    upper_bound: int = 5000
    upper_bound_mapto: int = 5000

    def __post_init__(self) -> None:
        if sorted(abs(v) for v in self.ref_orientation) != [1, 2, 3]:
            raise ValueError("ref_orientation must be a signed permutation of 1, 2, 3")
        _positive(**{f"downsample_rough[{i}]": v for i, v in enumerate(self.downsample_rough)})
        if not all(0 < v <= 1 for v in self.downsample_fine):
            raise ValueError("downsample_fine must lie in (0, 1] on each axis")
        if not self.lower_bound_mapto <= self.lower_bound <= self.upper_bound <= self.upper_bound_mapto:
            raise ValueError("bounds must obey lower_bound_mapto <= lower_bound <= upper_bound <= upper_bound_mapto")
        for axis, span in (("z", self.reg_trim.z), ("y", self.reg_trim.y), ("x", self.reg_trim.x)):
            if (span.start or 0) < 0 or span.step not in (None, 1):
                raise ValueError(f"reg_trim.{axis}: a negative start or a step can't be mapped back to coordinates")


@dataclass(frozen=True)
class CellCounting:
    tophat_radius: int = 10
    dog_sigma1: int = 1
    dog_sigma2: int = 4
    large_gauss_radius: int = 101
    threshd_value: int = 100
    min_threshd_size: int = 1
    max_threshd_size: int = 15_000
    maxima_radius: int = 5
    min_wshed_size: int = 1
    max_wshed_size: int = 1_000

    def __post_init__(self) -> None:
        _positive(**asdict(self))
        for low, high in (("dog_sigma1", "dog_sigma2"), ("min_threshd_size", "max_threshd_size"), ("min_wshed_size", "max_wshed_size")):
            if getattr(self, low) >= getattr(self, high):
                raise ValueError(f"{low} must be less than {high}")


@dataclass(frozen=True)
class VisualCheck:
    heatmap_raw_radius: int = 5
    heatmap_trfm_radius: int = 3
    cellcount_trim: Box = Box(z=Span(500, 510))

    def __post_init__(self) -> None:
        _positive(heatmap_raw_radius=self.heatmap_raw_radius, heatmap_trfm_radius=self.heatmap_trfm_radius)


@dataclass(frozen=True)
class Config:
    chunks: Chunks = Chunks()
    tuning_trim: Box = Box(z=Span(0, 100), y=Span(0, 2000), x=Span(0, 2000))
    cluster: Cluster = Cluster()
    reference: Reference = Reference()
    registration: Registration = field(default_factory=Registration)
    cell_counting: CellCounting = field(default_factory=CellCounting)
    visual_check: VisualCheck = field(default_factory=VisualCheck)

    @staticmethod
    def from_dict(values: Mapping[str, Any] | None) -> Config:
        """Unknown keys are ignored, missing ones take their defaults, all are validated."""
        return _build(Config, values or {})

    def to_dict(self) -> dict[str, Any]:
        plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else dict(zip("zyx", v, strict=True)) if isinstance(v, tuple) else v
        return plain(asdict(self))

    @staticmethod
    def parse(text: str) -> Config:
        import yaml

        return Config.from_dict(yaml.safe_load(text))

    @staticmethod
    def read(path: str) -> Config:
        with open(path) as f:
            return Config.parse(f.read())

    def write(self, path: str) -> None:
        import yaml

        with open(path, "w") as f:
            yaml.safe_dump(self.to_dict(), f, sort_keys=False)


_PARTS = {"chunks": Chunks, "tuning_trim": Box, "cluster": Cluster, "reference": Reference, "registration": Registration, "cell_counting": CellCounting, "visual_check": VisualCheck, "ref_trim": Box, "reg_trim": Box, "cellcount_trim": Box}
#: One value per axis, as a mapping of z, y, x or as a list in this order.
_TRIPLES = ("ref_orientation", "downsample_rough", "downsample_fine")


def _build(cls: type, values: Any) -> Any:
    if is_dataclass(values):
        return values
    if not isinstance(values, Mapping):
        raise ValueError(f"{cls.__name__}: expected a mapping, not {values!r}")
    made = {}
    for f in fields(cls):
        if f.name in values and values[f.name] is not None:
            v = values[f.name]
            part = Span if cls is Box else _PARTS.get(f.name)
            if f.name in _TRIPLES:
                made[f.name] = tuple(v[a] for a in "zyx") if isinstance(v, Mapping) else tuple(v)
            else:
                made[f.name] = _build(part, v) if part else v
    return cls(**made)
