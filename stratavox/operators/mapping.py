"""Object coordinates into the atlas, and atlas regions onto objects."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions.kernels import bspline3
from stratavox.operators.raster import in_bounds, rounded
from stratavox.plans.schema import COORDS, INVALID
from stratavox.runtime import arrow_batches


def scale_coords(points: DataFrame, rough: Sequence[float], fine: Sequence[float], trim_start: Sequence[int | None], out: Sequence[str] = COORDS) -> DataFrame:
    """c / rough * fine - start of the crop along each axis; a missing start is 0."""
    new = {o: F.col(c).cast("double") / F.lit(float(r)) * F.lit(float(f)) - F.lit(float(s or 0)) for o, c, r, f, s in zip(out, COORDS, rough, fine, trim_start, strict=True)}
    return points.withColumns(new)


def affine_columns(matrix: Sequence[Sequence[float]], shift: Sequence[float], coords: Sequence[str] = COORDS) -> list[Column]:
    """matrix @ coordinates + shift as column arithmetic."""
    return [sum((F.col(c).cast("double") * F.lit(float(m)) for c, m in zip(coords, row, strict=True)), F.lit(0.0)) + F.lit(float(t)) for row, t in zip(matrix, shift, strict=True)]


@dataclass(frozen=True)
class Affine:
    """y = matrix (x - center) + shift + center, axes in x, y, z order as parameter files have them."""

    matrix: np.ndarray
    shift: np.ndarray
    center: np.ndarray

    def __call__(self, xyz: np.ndarray) -> np.ndarray:
        return (xyz - self.center) @ self.matrix.T + self.shift + self.center


@dataclass(frozen=True)
class BSpline:
    """y = x + cubic B-spline over a grid of control points; points outside the grid's support stay."""

    size: tuple[int, int, int]
    spacing: np.ndarray
    origin: np.ndarray
    coefficients: np.ndarray  # (3, nz, ny, nx), displacements along x, y, z

    def __call__(self, xyz: np.ndarray) -> np.ndarray:
        u = (xyz - self.origin) / self.spacing
        first = np.floor(u).astype(int) - 1
        inside = np.all((first >= 0) & (first + 3 <= np.array(self.size) - 1), axis=1)
        out = xyz.copy()
        if inside.any():
            f, v = first[inside], u[inside]
            w = [bspline3(v[:, a, None] - (f[:, a, None] + np.arange(4))) for a in range(3)]
            i = [f[:, a, None] + np.arange(4) for a in range(3)]
            local = self.coefficients[:, i[2][:, :, None, None], i[1][:, None, :, None], i[0][:, None, None, :]]
            out[inside] += np.einsum("cnzyx,nz,ny,nx->nc", local, w[2], w[1], w[0])
        return out


@dataclass(frozen=True)
class Chain:
    """A transform after another: second(first(x)), or with `add` the sum of both displacements."""

    first: Affine | BSpline | Chain
    second: Affine | BSpline | Chain
    add: bool = False

    def __call__(self, xyz: np.ndarray) -> np.ndarray:
        moved = self.first(xyz)
        return moved + self.second(xyz) - xyz if self.add else self.second(moved)


def _fields(text: str) -> dict[str, list[str]]:
    return {m[1]: re.findall(r'"[^"]*"|[^\s"]+', m[2]) for m in re.finditer(r"^\s*\((\w+)\s+(.*?)\)\s*(?://.*)?$", text, re.M)}


def _turn(axis: int, angle: float) -> np.ndarray:
    """Rotation about the x, y or z axis."""
    c, s = np.cos(angle), np.sin(angle)
    m, (i, j) = np.eye(3), ((1, 2), (2, 0), (0, 1))[axis]
    m[i, i] = m[j, j] = c
    m[i, j], m[j, i] = -s, s
    return m


def _versor(v: np.ndarray) -> np.ndarray:
    """Rotation of a unit quaternion with the vector part v and a real part that is not negative."""
    x, y, z = v
    w = np.sqrt(max(0.0, 1 - v @ v))
    cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + 2 * w * cross + 2 * cross @ cross


def parse_parameters(text: str) -> Affine | BSpline:
    """A transform parameter file of lines "(Name value ...)", without the one it may start from: translation, Euler, similarity,
    affine and cubic B-spline transforms in three dimensions."""
    found = _fields(text)
    number = lambda k: np.array([float(v) for v in found[k]])
    kind = found.get("Transform", [""])[0].strip('"')
    values = number("TransformParameters")
    if len(values) != {"TranslationTransform": 3, "EulerTransform": 6, "SimilarityTransform": 7, "AffineTransform": 12}.get(kind, len(values)):
        raise ValueError(f"{len(values)} parameters are no {kind}")
    if kind == "TranslationTransform":
        return Affine(np.eye(3), values[:3], np.zeros(3))
    if kind == "EulerTransform":
        x, y, z = (_turn(a, values[a]) for a in range(3))
        late = found.get("ComputeZYX", ["false"])[0].strip('"') == "true"
        return Affine(z @ y @ x if late else z @ x @ y, values[3:6], number("CenterOfRotationPoint"))
    if kind == "SimilarityTransform":
        return Affine(values[6] * _versor(values[:3]), values[3:6], number("CenterOfRotationPoint"))
    if kind == "AffineTransform":
        return Affine(values[:9].reshape(3, 3), values[9:12], number("CenterOfRotationPoint"))
    if kind == "BSplineTransform":
        size = tuple(int(v) for v in number("GridSize"))
        return BSpline(size, number("GridSpacing"), number("GridOrigin"), values.reshape(3, size[2], size[1], size[0]))
    raise ValueError(f"no support for transform {kind!r}")


def parse_chain(read: Callable[[str], str], name: str) -> Affine | BSpline | Chain:
    """The transform of a parameter file with those it starts from: each file names the one before it, or none, and says how
    both combine. `read` gives the text of a file by the name that another file has for it; a circle is an error."""
    steps: list[tuple[Affine | BSpline, bool]] = []
    seen: set[str] = set()
    at: str | None = name
    while at is not None:
        if at in seen:
            raise ValueError(f"{at} starts from itself")
        seen.add(at)
        text = read(at)
        found = _fields(text)
        steps.append((parse_parameters(text), found.get("HowToCombineTransforms", ["Compose"])[0].strip('"') == "Add"))
        before = [found[k][0].strip('"') for k in ("InitialTransformParameterFileName", "InitialTransformParametersFileName") if k in found]
        at = before[0] if before and before[0] != "NoInitialTransform" else None
    whole: Affine | BSpline | Chain = steps[-1][0]
    for step, add in reversed(steps[:-1]):
        whole = Chain(whole, step, add)
    return whole


def parse_files(texts: Mapping[str, str]) -> list[Affine | BSpline | Chain]:
    """Transforms to be applied in order, from parameter files by name. Files that name the one they start from are one chain,
    which ends in the file that no other names; files without such names are taken in natural order."""
    by = {name.rsplit("/", 1)[-1]: text for name, text in texts.items()}
    links = {n: [found[k][0].strip('"').rsplit("/", 1)[-1] for k in ("InitialTransformParameterFileName", "InitialTransformParametersFileName") if k in found] for n, found in ((n, _fields(t)) for n, t in by.items())}
    named = {x for to in links.values() for x in to[:1] if x != "NoInitialTransform"}
    if not named:
        return [parse_parameters(by[n]) for n in sorted(by, key=natural_key)]
    ends = sorted(set(by) - named, key=natural_key)
    if len(ends) != 1 or named - set(by):
        raise ValueError(f"the files {sorted(by)} are not one chain: ends {ends}, missing {sorted(named - set(by))}")
    return [parse_chain(lambda n: by[n.rsplit("/", 1)[-1]], ends[0])]


def natural_key(name: str) -> list:
    """Sort key with numbers as numbers: img2 before img10."""
    return [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", name)]


def transform_points(points: DataFrame, transforms: Sequence[Affine | BSpline | Chain], out: Sequence[str] = ("z_trfm", "y_trfm", "x_trfm")) -> DataFrame:
    """Points with transformed coordinates beside their own: the transforms in order, all on one Arrow batch at a time.

    A chain of affine transforms alone is plain column arithmetic. Rows with a null coordinate get nulls.
    """
    if all(isinstance(t, Affine) for t in transforms):
        m, s = np.eye(3), np.zeros(3)
        for t in transforms:
            m, s = t.matrix @ m, t.matrix @ (s - t.center) + t.shift + t.center
        flip = np.eye(3)[::-1]
        cols = affine_columns((flip @ m @ flip).tolist(), (flip @ s).tolist())
        return points.withColumns(dict(zip(out, cols, strict=True)))
    arrow_batches(points.sparkSession)
    names, kinds = points.columns, ", ".join(f"`{n}` {t}" for n, t in points.dtypes)
    shared = points.sparkSession.sparkContext.broadcast(list(transforms))  # control grids: bounded by the atlas

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zyx = [b.column(names.index(c)).cast(pa.float64()) for c in COORDS]
            ok = np.ones(b.num_rows, bool)
            for c in zyx:
                ok &= np.asarray(c.is_valid())
            xyz = np.stack([np.asarray(c.fill_null(0.0)) for c in reversed(zyx)], axis=1)
            for t in shared.value:
                xyz = t(xyz)
            new = [pa.array(xyz[:, a], mask=~ok) for a in (2, 1, 0)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*names, *out])

    return points.mapInArrow(run, kinds + "".join(f", {o} double" for o in out))


def points_text(rows: Iterator[tuple[float, float, float]]) -> str:
    """The exchange format of point transforms: index, number of points, then x y z rows of (z, y, x) points."""
    lines = [f"{x} {y} {z}" for z, y, x in rows]
    return "\n".join(["index", str(len(lines)), *lines]) + "\n"


def parse_output_points(text: DataFrame, column: str = "value") -> DataFrame:
    """(z, y, x) from lines that hold "OutputPoint = [ x y z ]"; other lines give no row."""
    body = F.regexp_extract(column, r"OutputPoint\s*=\s*\[\s*([^\]]*?)\s*\]", 1)
    part = F.split(body, r"\s+")
    return text.where(body != "").select(*[F.element_at(part, i).cast("double").alias(c) for c, i in zip(COORDS, (3, 2, 1), strict=True)])


def region_at(points: DataFrame, atlas: DataFrame, shape: Sequence[int], coords: Sequence[str] = ("z_trfm", "y_trfm", "x_trfm")) -> DataFrame:
    """Points with the id of the atlas voxel they round to; outside the volume the id is -1.

    atlas: sparse voxels (z, y, x, id); a voxel without a row is 0, the universe. The join is on the voxel, and
    Spark broadcasts the atlas only if it is small.
    """
    key = {f"_{c}": rounded(k) for c, k in zip(COORDS, coords, strict=True)}
    placed = points.withColumns(key)
    vox = atlas.select(*[F.col(c).alias("_" + c) for c in COORDS], F.col("id").cast("long").alias("_id"))
    inside = in_bounds(shape, [f"_{c}" for c in COORDS])
    found = placed.join(vox, ["_z", "_y", "_x"], "left")
    return found.withColumn("id", F.when(F.coalesce(inside, F.lit(False)), F.coalesce("_id", F.lit(0))).otherwise(INVALID[0]).cast("long")).drop("_z", "_y", "_x", "_id")


def resample_voxels(fixed: DataFrame, moving: DataFrame, transforms: Sequence[Affine | BSpline | Chain], missing: int = 0) -> DataFrame:
    """Image transform, nearest voxel: each fixed voxel takes the value of moving where the transform sends it."""
    sent = transform_points(fixed.select(*COORDS), transforms, ("tz", "ty", "tx"))
    keyed = sent.select(*COORDS, *[rounded(f"t{c}").alias(f"_{c}") for c in COORDS])
    src = moving.select(*[F.col(c).alias("_" + c) for c in COORDS], "v")
    return keyed.join(src, ["_z", "_y", "_x"], "left").select(*COORDS, F.coalesce("v", F.lit(missing)).alias("v"))
