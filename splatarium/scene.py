"""A scene: a DataFrame and its format. Every method gives a new scene with a
longer plan; nothing runs until rows are asked for."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scene_format as sf
from .operators import colour, compose, filters, opacity, stats, transform
from .plans.values import ColorValues, FilterValues, HistogramConfig, OpacityValues, TransformValues
from .scene_format import SceneFormat


@dataclass(frozen=True)
class Scene:
    df: DataFrame
    format: SceneFormat = SceneFormat()

    def _df(self, df: DataFrame) -> Scene:
        return replace(self, df=df)

    def _both(self, pair: tuple[DataFrame, SceneFormat]) -> Scene:
        return Scene(*pair)

    # colour
    def color(self, v: ColorValues) -> Scene:
        return self._df(colour.apply_color(self.df, v, self.format))

    def adjust(self, **fields: float) -> Scene:
        """One or more fields of ColorValues by name."""
        return self.color(ColorValues(**fields))

    def color_preset(self, name: str, strength: float = 1.0) -> Scene:
        return Scene(colour.ColorSteps().preset(name, strength)(self.df, self.format), replace(self.format, rgb=True))

    def to_rgb(self) -> Scene:
        return self._both(sf.to_rgb(self.df, self.format))

    def to_sh(self) -> Scene:
        return self._both(sf.to_sh(self.df, self.format))

    def to_linear(self) -> Scene:
        return self._both(sf.to_linear(self.df, self.format))

    def to_log(self) -> Scene:
        return self._both(sf.to_log(self.df, self.format))

    def opacity(self, v: OpacityValues) -> Scene:
        return self._df(opacity.apply_opacity(self.df, v, self.format))

    # the smooth forms, in any order and number
    def smooth_color(self, v: ColorValues) -> Scene:
        return self._df(colour.learnable_color(self.df, v))

    def soft_filter(self, **how) -> Scene:
        """Linear opacities times a weight from 0 to 1; see `filters.soft_weight`."""
        return self._df(self.df.withColumn(sf.OPACITY, F.col(sf.OPACITY) * filters.soft_weight(**how)))

    # rows
    def filter(self, v: FilterValues | filters.Filter | filters.Tests) -> Scene:
        if isinstance(v, FilterValues):
            return self._df(filters.apply_filter(self.df, v, self.format))
        return self._df(v(self.df, fmt=self.format))

    def filter_min_opacity(self, t: float) -> Scene:
        return self.filter(FilterValues(min_opacity=t))

    def filter_max_opacity(self, t: float) -> Scene:
        return self.filter(FilterValues(max_opacity=t))

    def filter_min_scale(self, t: float) -> Scene:
        return self.filter(FilterValues(min_scale=t))

    def filter_max_scale(self, t: float) -> Scene:
        return self.filter(FilterValues(max_scale=t))

    def filter_within_sphere(self, radius: float, center=(0.0, 0.0, 0.0), invert: bool = False) -> Scene:
        return self.filter(FilterValues(sphere_radius=radius, sphere_center=tuple(center), invert=invert))

    def filter_within_box(self, lo, hi, rotation=None, invert: bool = False) -> Scene:
        return self.filter(FilterValues(box_min=tuple(lo), box_max=tuple(hi), box_rot=rotation, invert=invert))

    def filter_within_ellipsoid(self, center, radii, rotation=None, invert: bool = False) -> Scene:
        return self.filter(FilterValues(ellipsoid_center=tuple(center), ellipsoid_radii=tuple(radii), ellipsoid_rot=rotation, invert=invert))

    def filter_within_frustum(self, position, rotation, fov, aspect, near, far, invert: bool = False) -> Scene:
        return self.filter(FilterValues(frustum_pos=tuple(position), frustum_rot=rotation, frustum_fov=fov, frustum_aspect=aspect, frustum_near=near, frustum_far=far, invert=invert))

    def filter_outside_sphere(self, radius: float, center=(0.0, 0.0, 0.0)) -> Scene:
        return self.filter_within_sphere(radius, center, True)

    def filter_outside_box(self, lo, hi, rotation=None) -> Scene:
        return self.filter_within_box(lo, hi, rotation, True)

    def filter_outside_ellipsoid(self, center, radii, rotation=None) -> Scene:
        return self.filter_within_ellipsoid(center, radii, rotation, True)

    def filter_outside_frustum(self, position, rotation, fov, aspect, near, far) -> Scene:
        return self.filter_within_frustum(position, rotation, fov, aspect, near, far, True)

    def mask(self, name: str, v: FilterValues | filters.Filter) -> Scene:
        f = filters.Filter.from_values(v) if isinstance(v, FilterValues) else v
        return self._df(f.mask(self.df, f"mask_{name}", self.format))

    def split(self, where) -> tuple[Scene, Scene]:
        return tuple(map(self._df, filters.split_by(self.df, where)))

    # geometry; angles in degrees
    def transform(self, v: TransformValues) -> Scene:
        return self._df(transform.apply_transform(self.df, v, self.format))

    def translate(self, vector) -> Scene:
        return self.transform(TransformValues.from_translation(*vector))

    def scale_uniform(self, factor: float) -> Scene:
        return self.transform(TransformValues.from_scale(factor))

    def scale_nonuniform(self, factors) -> Scene:
        return self.transform(TransformValues.from_scale(factors))

    def rotate_quaternion(self, q) -> Scene:
        return self._df(transform.rotate_quaternion(self.df, q, self.format))

    def rotate_euler(self, angles) -> Scene:
        return self.transform(TransformValues.from_rotation_euler(*angles))

    def rotate_axis_angle(self, axis, angle: float) -> Scene:
        return self.transform(TransformValues.from_rotation_axis_angle(axis, angle))

    def transform_matrix(self, matrix, exact: bool = False) -> Scene:
        return self._df(transform.apply_matrix(self.df, matrix, self.format, exact))

    def center_at_origin(self) -> Scene:
        return self._df(stats.center_at_origin(self.df))

    def normalize_scale(self, target_size: float = 2.0) -> Scene:
        return self._df(stats.normalize_scale(self.df, target_size, self.format))

    # numbers
    def bounds(self) -> DataFrame:
        return stats.bounds(self.df)

    def centroid(self) -> DataFrame:
        return stats.centroid(self.df)

    def recommended_max_scale(self, percentile: float = 99.5) -> DataFrame:
        return stats.recommended_max_scale(self.df, percentile)

    def histogram_colors(self, config: HistogramConfig = HistogramConfig()) -> DataFrame:
        return stats.histogram(self.df, stats.colour_values(), config)

    def histogram_opacity(self, config: HistogramConfig = HistogramConfig()) -> DataFrame:
        return stats.histogram(self.df, stats.opacity_values(), config)

    def histogram_scales(self, config: HistogramConfig = HistogramConfig()) -> DataFrame:
        return stats.histogram(self.df, stats.scale_values(), config)

    def histogram_positions(self, config: HistogramConfig = HistogramConfig(), axis: str | None = None) -> DataFrame:
        return stats.histogram(self.df, stats.position_values(axis), config)

    def deduplicate(self, threshold: float = 1e-6, method: str = "first") -> Scene:
        return self._df(compose.deduplicate(self.df, threshold, method))


def process(scene: Scene, color: ColorValues | None = None, transform: TransformValues | None = None, filter: FilterValues | None = None, opacity: OpacityValues | None = None) -> Scene:
    """Whatever is given, in this order: filter, transform, colour, opacity."""
    for step, v in (("filter", filter), ("transform", transform), ("color", color), ("opacity", opacity)):
        if v is not None:
            scene = getattr(scene, step)(v)
    return scene
