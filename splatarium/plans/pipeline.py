"""Deferred lists of scene operations.

`Pipeline` keeps the order and merges neighbours of one kind by their `+`, as the
records do; `merge=False` applies each by itself, which is the exact sequence.
`GroupedPipeline` runs all filters, transforms and colours as three groups, in
the order in which the kinds first appear.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace
from typing import Protocol, runtime_checkable

import numpy as np

from ..operators.colour import ColorSteps
from ..operators.filters import Filter, Tests
from ..operators.transform import Transform
from ..scene import Scene
from .values import ColorValues, FilterValues, OpacityValues, TransformValues


@runtime_checkable
class Stage(Protocol):
    """Anything that turns a scene into a scene."""

    def __call__(self, scene: Scene) -> Scene: ...


_MERGED = {"color": ColorValues, "transform": TransformValues, "filter": FilterValues}


@dataclass(frozen=True)
class Pipeline:
    ops: tuple = ()
    merge: bool = True

    def _with(self, name: str, *args) -> Pipeline:
        return replace(self, ops=(*self.ops, (name, args)))

    def color(self, v: ColorValues) -> Pipeline:
        return self._with("color", v)

    def _colour(self, field: str, value: float) -> Pipeline:
        return self.color(ColorValues(**{field: value}))

    def transform(self, v: TransformValues) -> Pipeline:
        return self._with("transform", v)

    def translate(self, vector) -> Pipeline:
        return self.transform(TransformValues.from_translation(*vector))

    def scale(self, factor) -> Pipeline:
        """A number merges with other transforms; three factors stand by themselves."""
        return self.transform(TransformValues.from_scale(factor)) if np.isscalar(factor) else self._with("scale_nonuniform", tuple(factor))

    def rotate_quaternion(self, q) -> Pipeline:
        return self.transform(TransformValues(rotation=tuple(q)))

    def rotate_euler(self, angles) -> Pipeline:
        return self.transform(TransformValues.from_rotation_euler(*angles))

    def rotate_axis_angle(self, axis, angle: float) -> Pipeline:
        return self.transform(TransformValues.from_rotation_axis_angle(axis, angle))

    def center_at_origin(self) -> Pipeline:
        return self._with("center_at_origin")

    def normalize_scale(self, target_size: float = 2.0) -> Pipeline:
        return self._with("normalize_scale", target_size)

    def opacity(self, v: OpacityValues) -> Pipeline:
        return self._with("opacity", v)

    def filter(self, v: FilterValues | Filter) -> Pipeline:
        return self._with("filter", v)

    def _threshold(self, field: str, value: float) -> Pipeline:
        return self.filter(FilterValues(**{field: value}))

    def within_sphere(self, radius: float, center=(0.0, 0.0, 0.0)) -> Pipeline:
        return self.filter(FilterValues(sphere_radius=radius, sphere_center=tuple(center)))

    def outside_sphere(self, radius: float, center=(0.0, 0.0, 0.0)) -> Pipeline:
        return self.filter(FilterValues(sphere_radius=radius, sphere_center=tuple(center), invert=True))

    def within_box(self, lo, hi, rotation=None) -> Pipeline:
        return self.filter(FilterValues(box_min=tuple(lo), box_max=tuple(hi), box_rot=rotation))

    def outside_box(self, lo, hi, rotation=None) -> Pipeline:
        return self.filter(FilterValues(box_min=tuple(lo), box_max=tuple(hi), box_rot=rotation, invert=True))

    def merged(self) -> tuple:
        """The operations after merging neighbours."""
        out: list = []
        for name, args in self.ops:
            kind = _MERGED.get(name)
            if self.merge and out and out[-1][0] == name and kind and isinstance(args[0], kind) and isinstance(out[-1][1][0], kind):
                out[-1] = (name, (out[-1][1][0] + args[0],))
            else:
                out.append((name, args))
        return tuple(out)

    def __call__(self, scene: Scene) -> Scene:
        return functools.reduce(lambda s, op: getattr(s, op[0])(*op[1]), self.merged(), scene)


for _f in ("brightness", "contrast", "saturation", "gamma", "temperature", "vibrance", "hue_shift", "shadows", "highlights", "tint", "fade"):
    setattr(Pipeline, _f, functools.partialmethod(Pipeline._colour, _f))
for _f in ("min_opacity", "max_opacity", "min_scale", "max_scale"):
    setattr(Pipeline, _f, functools.partialmethod(Pipeline._threshold, _f))


@dataclass(frozen=True)
class GroupedPipeline:
    """Operations by kind. Angles are radians, as in the lists it is made of;
    centering and normalising end a run of transforms."""

    order: tuple[str, ...] = ()
    tests: Tests = Tests()
    moves: tuple = ()
    steps: ColorSteps = ColorSteps()

    def _kind(self, kind: str, **change) -> GroupedPipeline:
        return replace(self, order=self.order if kind in self.order else (*self.order, kind), **change)

    def _color(self, op: str, *value: float) -> GroupedPipeline:
        return self._kind("color", steps=self.steps._with(op, *value))

    def color_preset(self, name: str, strength: float = 1.0) -> GroupedPipeline:
        return self._kind("color", steps=self.steps.preset(name, strength))

    def _filter(self, name: str, *args, **kw) -> GroupedPipeline:
        return self._kind("filter", tests=getattr(self.tests, name)(*args, **kw))

    def _move(self, name: str, *args) -> GroupedPipeline:
        return self._kind("transform", moves=(*self.moves, (name, args)))

    def _moved(self, scene: Scene) -> Scene:
        run = Transform()
        flush = lambda s, r: replace(s, df=r(s.df, s.format))
        for name, args in self.moves:
            if name in ("center_at_origin", "normalize_scale"):
                scene, run = getattr(flush(scene, run), name)(*args), Transform()
            else:
                run = getattr(run, name)(*args)
        return flush(scene, run)

    def __call__(self, scene: Scene, filter_mode: str = "and") -> Scene:
        for kind in self.order:
            if kind == "filter":
                scene = replace(scene, df=self.tests(scene.df, filter_mode, scene.format))
            elif kind == "transform":
                scene = self._moved(scene)
            else:
                scene = Scene(self.steps(scene.df, scene.format), replace(scene.format, rgb=True))
        return scene


for _f in ("brightness", "contrast", "saturation", "gamma", "temperature", "vibrance", "hue_shift", "shadows", "highlights", "tint", "fade", "shadow_tint", "highlight_tint"):
    setattr(GroupedPipeline, _f, functools.partialmethod(GroupedPipeline._color, _f))
for _f in ("within_sphere", "outside_sphere", "within_box", "outside_box", "within_rotated_box", "within_ellipsoid", "within_frustum", "min_opacity", "max_opacity", "min_scale", "max_scale", "near_plane", "far_plane"):
    setattr(GroupedPipeline, _f, functools.partialmethod(GroupedPipeline._filter, _f))
for _f, _g in (("translate", "translate"), ("scale", "scale"), ("rotate_quaternion", "rotate_quat"), ("rotate_euler", "rotate_euler"), ("rotate_axis_angle", "rotate_axis_angle"), ("transform_matrix", "matrix"), ("center_at_origin",) * 2, ("normalize_scale",) * 2):
    setattr(GroupedPipeline, _f, functools.partialmethod(GroupedPipeline._move, _g))
