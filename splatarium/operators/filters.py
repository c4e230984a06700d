"""Row filters: shapes, thresholds, and their algebra, all as Columns.

Thresholds are moved into the space of the data (logit, log), so the data
columns stay bare and comparisons reach the Parquet scan. Round and rotated
shapes also say in which axis-parallel box they lie, for the same reason.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rotation as rot
from ..functions import scalar as sc
from ..plans.values import INF, FilterValues
from ..scene_format import OPACITY, POS, SCALE, SceneFormat, cols


def _every(parts) -> Column:
    return functools.reduce(operator.and_, parts) if parts else F.lit(True)


def _within_box(lo, hi) -> list[Column]:
    """Comparisons of bare columns; sides at infinity are left out."""
    out = []
    for c, a, b in zip(cols(POS), lo, hi):
        out += [c >= float(a)] if a > -INF else []
        out += [c <= float(b)] if b < INF else []
    return out


def _local(center, rotation) -> list[Column]:
    """Positions in the axes of a shape: the inverse of its rotation."""
    moved = [c - float(m) if m else c for c, m in zip(cols(POS), center)]
    return moved if rotation is None else rot.linear(rot.axis_angle_to_rotation_matrix(rotation).T, moved)


def _hull(center, reach) -> list[Column]:
    """A box that surely holds the shape: a little wider than it has to be."""
    reach = np.asarray(reach, float) * (1 + 1e-9) + 1e-9 * (1 + np.abs(center))
    return _within_box(np.asarray(center, float) - reach, np.asarray(center, float) + reach)


def _reach(half, rotation) -> np.ndarray:
    half = np.asarray(half, float)
    return half if rotation is None else np.abs(rot.axis_angle_to_rotation_matrix(rotation)) @ half


def sphere(center, radius: float) -> Column:
    """Inside or on the sphere."""
    d = [c - float(m) if m else c for c, m in zip(cols(POS), center)]
    return _every([*_hull(center, [radius] * 3), d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= float(radius) * float(radius)])


def box(lo, hi, rotation=None) -> Column:
    """Inside or on the box; with a rotation it turns about its middle."""
    if rotation is None:
        return _every(_within_box(lo, hi))
    center, half = (np.asarray(lo, float) + hi) / 2, (np.asarray(hi, float) - lo) / 2
    return _every([*_hull(center, _reach(half, rotation)), *(F.abs(p) <= float(h) for p, h in zip(_local(center, rotation), half))])


def ellipsoid(center, radii, rotation=None) -> Column:
    radii = np.maximum(np.asarray(radii, float), 1e-7)
    parts = [p / float(r) for p, r in zip(_local(center, rotation), radii)]
    return _every([*_hull(center, np.full(3, radii.max()) if rotation is not None else radii), parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2] <= 1.0])


def frustum(position=(0.0, 0.0, 0.0), rotation=None, fov: float = 1.047, aspect: float = 1.0, near: float = 0.1, far: float = 100.0) -> Column:
    """Seen by a camera that looks along -z: strictly between the planes, and
    inside or on the sides. fov is the whole vertical angle in radians."""
    ty = math.tan(fov / 2)
    tx = ty * aspect
    x, y, z = _local(position, rotation)
    reach = far * math.sqrt(1 + tx * tx + ty * ty)
    return _every([*_hull(position, [reach] * 3), z < -float(near), z > -float(far), F.abs(x) <= -z * tx, F.abs(y) <= -z * ty])


def largest_scale() -> Column:
    return F.greatest(*cols(SCALE))


def opacity_threshold(value: float, fmt: SceneFormat) -> float:
    return sc.logit_number(value) if fmt.logit_opacity else float(value)


def scale_threshold(value: float, fmt: SceneFormat) -> float:
    return sc.log_number(value) if fmt.log_scale else float(value)


def predicate(v: FilterValues, fmt: SceneFormat = SceneFormat()) -> Column:
    """All of a FilterValues but `invert`.

    Linear opacities and scales are held against their limits even where these
    are neutral; in log spaces a neutral limit is no limit.
    """
    parts = []
    if fmt.logit_opacity:
        # of two spaces, the one of the data: with the published guard in the denominator
        to = lambda p: math.log(p / (1 - p + 1e-7))
        parts += [F.col(OPACITY) >= to(v.min_opacity)] if v.min_opacity > 0 else []
        parts += [F.col(OPACITY) <= to(v.max_opacity)] if v.max_opacity < 1 else []
    else:
        parts += [F.col(OPACITY) >= float(v.min_opacity), F.col(OPACITY) <= float(v.max_opacity)]
    if fmt.log_scale:
        parts += [largest_scale() >= math.log(v.min_scale)] if v.min_scale > 0 else []
        parts += [s <= math.log(v.max_scale) for s in cols(SCALE)] if v.max_scale < 100 else []
    else:
        # the largest is at most m where all are: three comparisons that can be pushed down
        parts += [largest_scale() >= float(v.min_scale), *(s <= float(v.max_scale) for s in cols(SCALE))]
    if v.sphere_radius < INF:
        parts.append(sphere(v.sphere_center, v.sphere_radius))
    if v.box_min is not None and v.box_max is not None:
        parts.append(box(v.box_min, v.box_max, v.box_rot))
    if v.ellipsoid_radii is not None:
        parts.append(ellipsoid(v.ellipsoid_center or (0.0, 0.0, 0.0), v.ellipsoid_radii, v.ellipsoid_rot))
    if v.frustum_pos is not None:
        parts.append(frustum(v.frustum_pos, v.frustum_rot, v.frustum_fov, v.frustum_aspect, v.frustum_near, v.frustum_far))
    return _every(parts)


def negate(c: Column) -> Column:
    """Two-valued not: what is neither true nor false was not selected."""
    return ~F.coalesce(c, F.lit(False))


def apply_filter(df: DataFrame, v: FilterValues, fmt: SceneFormat = SceneFormat()) -> DataFrame:
    """The rows that v selects; all rows if v is neutral."""
    if v.is_neutral():
        return df
    p = predicate(v, fmt)
    return df.filter(negate(p) if v.invert else p)


# --------------------------------------------------------- checked geometries


@dataclass(frozen=True)
class SphereFilter:
    center: tuple = (0.0, 0.0, 0.0)
    radius: float = 1.0

    def __post_init__(self):
        if self.radius <= 0:
            raise ValueError(f"radius has to be positive, not {self.radius}")

    def to_column(self) -> Column:
        return sphere(self.center, self.radius)


@dataclass(frozen=True)
class BoxFilter:
    center: tuple = (0.0, 0.0, 0.0)
    size: tuple = (1.0, 1.0, 1.0)
    rotation: tuple | None = None

    def __post_init__(self):
        if min(self.size) <= 0:
            raise ValueError(f"sizes have to be positive, not {self.size}")

    def to_column(self) -> Column:
        half = np.asarray(self.size, float) / 2
        return box(np.asarray(self.center) - half, np.asarray(self.center) + half, self.rotation)


@dataclass(frozen=True)
class EllipsoidFilter:
    center: tuple = (0.0, 0.0, 0.0)
    radii: tuple = (1.0, 1.0, 1.0)
    rotation: tuple | None = None

    def __post_init__(self):
        if min(self.radii) <= 0:
            raise ValueError(f"radii have to be positive, not {self.radii}")

    def to_column(self) -> Column:
        return ellipsoid(self.center, self.radii, self.rotation)


@dataclass(frozen=True)
class FrustumFilter:
    position: tuple = (0.0, 0.0, 0.0)
    rotation: tuple | None = None
    fov: float = 1.047
    aspect: float = 1.0
    near: float = 0.1
    far: float = 100.0

    def __post_init__(self):
        if not 0 < self.fov < 3.14159 or self.aspect <= 0 or self.near <= 0 or self.far <= self.near:
            raise ValueError(f"not a frustum: {self}")

    def to_column(self) -> Column:
        return frustum(self.position, self.rotation, self.fov, self.aspect, self.near, self.far)


@dataclass(frozen=True)
class QualityFilter:
    min_opacity: float = 0.0
    max_scale: float = 10.0

    def __post_init__(self):
        if not 0 <= self.min_opacity <= 1 or self.max_scale < 0:
            raise ValueError(f"out of range: {self}")

    def to_column(self, fmt: SceneFormat = SceneFormat()) -> Column:
        parts = [F.col(OPACITY) >= opacity_threshold(self.min_opacity, fmt)] * (self.min_opacity > 0)
        return _every(parts + [largest_scale() <= scale_threshold(self.max_scale, fmt)] * (self.max_scale < 10))


def geometry_filter(df: DataFrame, geometry, quality: QualityFilter | None = None, fmt: SceneFormat = SceneFormat()) -> DataFrame:
    if not hasattr(geometry, "to_column"):
        raise TypeError(f"not a geometry: {type(geometry).__name__}")
    df = df.filter(geometry.to_column())
    return df if quality is None else df.filter(quality.to_column(fmt))


# ------------------------------------------------------------------- algebra


class Filter:
    """A predicate that combines with &, | and ~, all of them exact.

    `merged_with` is the other conjunction, by which the stricter value wins.
    """

    def __init__(self, make: Callable[[SceneFormat], Column], values: FilterValues | None = None, text: str = ""):
        self.make, self.values, self.text = make, values, text

    @classmethod
    def from_values(cls, v: FilterValues) -> Filter:
        return cls(lambda fmt: negate(predicate(v, fmt)) if v.invert else predicate(v, fmt), v, f"{'not ' * v.invert}values")

    @classmethod
    def of(cls, **kw) -> Filter:
        return replace_text(cls.from_values(FilterValues(**kw)), ", ".join(f"{k}={x}" for k, x in kw.items()))

    min_opacity = classmethod(lambda cls, t: cls.of(min_opacity=t))
    max_opacity = classmethod(lambda cls, t: cls.of(max_opacity=t))
    min_scale = classmethod(lambda cls, t: cls.of(min_scale=t))
    max_scale = classmethod(lambda cls, t: cls.of(max_scale=t))

    @classmethod
    def sphere(cls, radius: float, center=(0.0, 0.0, 0.0)) -> Filter:
        return cls.of(sphere_radius=radius, sphere_center=tuple(center))

    @classmethod
    def box(cls, lo, hi, rotation=None) -> Filter:
        return cls.of(box_min=tuple(lo), box_max=tuple(hi), box_rot=rotation)

    @classmethod
    def ellipsoid(cls, center, radii, rotation=None) -> Filter:
        return cls.of(ellipsoid_center=tuple(center), ellipsoid_radii=tuple(radii), ellipsoid_rot=rotation)

    @classmethod
    def frustum(cls, position, rotation, fov, aspect, near, far) -> Filter:
        return cls.of(frustum_pos=tuple(position), frustum_rot=rotation, frustum_fov=fov, frustum_aspect=aspect, frustum_near=near, frustum_far=far)

    outside_sphere = classmethod(lambda cls, *a, **k: ~cls.sphere(*a, **k))
    outside_box = classmethod(lambda cls, *a, **k: ~cls.box(*a, **k))
    outside_ellipsoid = classmethod(lambda cls, *a, **k: ~cls.ellipsoid(*a, **k))
    outside_frustum = classmethod(lambda cls, *a, **k: ~cls.frustum(*a, **k))

    def __and__(self, other: Filter) -> Filter:
        return Filter(lambda f: self.make(f) & other.make(f), text=f"({self.text} and {other.text})")

    def __or__(self, other: Filter) -> Filter:
        return Filter(lambda f: self.make(f) | other.make(f), text=f"({self.text} or {other.text})")

    def __invert__(self) -> Filter:
        return Filter(lambda f: negate(self.make(f)), text=f"not {self.text}")

    def merged_with(self, other: Filter) -> Filter:
        return Filter.from_values(self.to_values() + other.to_values())

    @property
    def is_values(self) -> bool:
        return self.values is not None

    def to_values(self) -> FilterValues:
        if self.values is None:
            raise ValueError(f"no single record says {self.text}")
        return self.values

    def mask(self, df: DataFrame, name: str = "mask", fmt: SceneFormat = SceneFormat()) -> DataFrame:
        return df.withColumn(name, F.coalesce(self.make(fmt), F.lit(False)))

    def __call__(self, df: DataFrame, fmt: SceneFormat = SceneFormat()) -> DataFrame:
        return df.filter(self.make(fmt))

    def __repr__(self) -> str:
        return f"Filter({self.text})"


def replace_text(f: Filter, text: str) -> Filter:
    f.text = text
    return f


# ------------------------------------------------------------ lists of tests

_OPPOSITE = {"within": "outside", "outside": "within", "min": "max", "max": "min", "near": "far", "far": "near"}


@dataclass(frozen=True)
class Tests:
    """A list of tests that hold all together, or of which one holds.

    Each method gives a new list. `complement` turns every test into its
    opposite and keeps the way they are combined; see `operators.filters.Filter`
    for the exact complement.
    """

    ops: tuple = ()
    __test__ = False  # no test class of pytest

    def _with(self, name: str, *args) -> Tests:
        return replace(self, ops=(*self.ops, (name, args)))

    def within_sphere(self, center=(0.0, 0.0, 0.0), radius: float = 1.0):
        return self._with("within_sphere", center, radius)

    def outside_sphere(self, center=(0.0, 0.0, 0.0), radius: float = 1.0):
        return self._with("outside_sphere", center, radius)

    def within_box(self, lo, hi):
        return self._with("within_box", lo, hi)

    def outside_box(self, lo, hi):
        return self._with("outside_box", lo, hi)

    def within_rotated_box(self, center, size, rotation=None):
        return self._with("within_rotated_box", center, size, rotation)

    def outside_rotated_box(self, center, size, rotation=None):
        return self._with("outside_rotated_box", center, size, rotation)

    def within_ellipsoid(self, center=(0.0, 0.0, 0.0), radii=(1.0, 1.0, 1.0), rotation=None):
        return self._with("within_ellipsoid", center, radii, rotation)

    def outside_ellipsoid(self, center=(0.0, 0.0, 0.0), radii=(1.0, 1.0, 1.0), rotation=None):
        return self._with("outside_ellipsoid", center, radii, rotation)

    def within_frustum(self, position=(0.0, 0.0, 0.0), rotation=None, fov=1.047, aspect=1.0, near=0.1, far=100.0):
        return self._with("within_frustum", position, rotation, fov, aspect, near, far)

    def outside_frustum(self, position=(0.0, 0.0, 0.0), rotation=None, fov=1.047, aspect=1.0, near=0.1, far=100.0):
        return self._with("outside_frustum", position, rotation, fov, aspect, near, far)

    def min_opacity(self, threshold: float = 0.1):
        return self._with("min_opacity", threshold)

    def max_opacity(self, threshold: float = 0.99):
        return self._with("max_opacity", threshold)

    def min_scale(self, threshold: float = 0.001):
        return self._with("min_scale", threshold)

    def max_scale(self, threshold: float = 0.1):
        return self._with("max_scale", threshold)

    def near_plane(self, distance: float = 0.1, axis: str = "z"):
        return self._with("near_plane", distance, axis)

    def far_plane(self, distance: float = 10.0, axis: str = "z"):
        return self._with("far_plane", distance, axis)

    def complement(self) -> Tests:
        out = []
        for name, args in self.ops:
            side, _, what = name.partition("_")
            if side in ("min", "near"):  # from >= t to < t, as <= a little less
                args = (args[0] - 1e-6, *args[1:])
            elif side in ("max", "far"):
                args = (args[0] + 1e-6, *args[1:])
            out.append((f"{_OPPOSITE[side]}_{what}", args))
        return Tests(tuple(out))

    def _column(self, name: str, args: tuple, fmt: SceneFormat) -> Column:
        side, _, what = name.partition("_")
        if what == "rotated_box":
            center, size, rotation = args
            half = np.asarray(size, float) / 2
            inside = box(np.asarray(center) - half, np.asarray(center) + half, rotation)
        elif side in ("within", "outside"):
            inside = {"sphere": sphere, "box": box, "ellipsoid": ellipsoid, "frustum": frustum}[what](*args)
        if side == "within":
            return inside
        if side == "outside":
            return negate(inside)
        c = {"opacity": F.col(OPACITY), "scale": largest_scale(), "plane": F.col(args[-1]) if what == "plane" else None}[what]
        t = {"opacity": opacity_threshold, "scale": scale_threshold}.get(what, lambda v, _: float(v))(args[0], fmt)
        # a NaN passes neither test, though Spark orders it above all numbers
        return (c >= t) & ~F.isnan(c) if side in ("min", "near") else c <= t

    def column(self, mode: str = "and", fmt: SceneFormat = SceneFormat()) -> Column:
        if mode not in ("and", "or"):
            raise ValueError(f"mode is 'and' or 'or', not {mode!r}")
        parts = [self._column(*op, fmt) for op in self.ops]
        return functools.reduce(operator.and_ if mode == "and" else operator.or_, parts) if parts else F.lit(True)

    def mask(self, df: DataFrame, name: str = "mask", mode: str = "and", fmt: SceneFormat = SceneFormat()) -> DataFrame:
        return df.withColumn(name, F.coalesce(self.column(mode, fmt), F.lit(False)))

    def __call__(self, df: DataFrame, mode: str = "and", fmt: SceneFormat = SceneFormat()) -> DataFrame:
        return df.filter(self.column(mode, fmt)) if self.ops else df


def split_by(df: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where it is true, all others)."""
    return df.filter(where), df.filter(negate(where))


def soft_weight(
    opacity: float = 0.0, opacity_sharpness: float = 10.0, scale: float = 100.0, scale_sharpness: float = 10.0, shape: str = "none",
    center=(0.0, 0.0, 0.0), radius: float = INF, radii=(1.0, 1.0, 1.0), rotation=None, sharpness: float = 10.0,
) -> Column:
    """A weight from 0 to 1 instead of a decision: a product of sigmoids."""
    out = F.lit(1.0)
    if opacity > 0:
        out = out * sc.sigmoid((F.col(OPACITY) - opacity) * opacity_sharpness)
    if scale < 100:
        out = out * sc.sigmoid((scale - largest_scale()) * scale_sharpness)
    p = _local(center, rotation)
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    if shape == "sphere" and radius < INF:
        out = out * sc.sigmoid((radius - norm(p)) * sharpness)
    elif shape == "ellipsoid":
        out = out * sc.sigmoid((1 - norm([a / float(r) for a, r in zip(p, radii)])) * sharpness)
    elif shape == "box":
        out = out * sc.sigmoid((1 - F.greatest(*[F.abs(a) / float(r) for a, r in zip(p, radii)])) * sharpness)
    elif shape not in ("none", "sphere"):
        raise ValueError(f"no shape {shape!r}")
    return out
