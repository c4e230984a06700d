"""What stages of a pipeline have to offer, checkable at run time with isinstance.

Pipelines here are values: a method gives a new one, so an empty value takes the place of
a reset, and calling one takes the place of applying it in place.
"""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame

from ..scene_format import SceneFormat


@runtime_checkable
class PipelineStage(Protocol):
    """Applied by calling it on rows; knows whether it would change any."""

    def __call__(self, df: DataFrame, fmt: SceneFormat = ...) -> DataFrame: ...

    def is_identity(self) -> bool: ...


@runtime_checkable
class ColorProcessor(Protocol):
    """Collects colour operations."""

    def __call__(self, df: DataFrame, fmt: SceneFormat = ...) -> DataFrame: ...

    def brightness(self, value: float) -> ColorProcessor: ...

    def contrast(self, value: float) -> ColorProcessor: ...

    def saturation(self, value: float) -> ColorProcessor: ...


@runtime_checkable
class TransformProcessor(Protocol):
    """Collects moves, turns and scalings."""

    def __call__(self, df: DataFrame, fmt: SceneFormat = ...) -> DataFrame: ...

    def translate(self, vector) -> TransformProcessor: ...

    def scale(self, factor) -> TransformProcessor: ...

    def rotate_quat(self, q) -> TransformProcessor: ...


@runtime_checkable
class FilterProcessor(Protocol):
    """Collects tests; gives their decision as a column, or the rows that pass."""

    def __call__(self, df: DataFrame, mode: str = ...) -> DataFrame: ...

    def column(self, mode: str = ...) -> Column: ...

    def within_sphere(self, center=..., radius: float = ...) -> FilterProcessor: ...

    def min_opacity(self, threshold: float = ...) -> FilterProcessor: ...

    def max_scale(self, threshold: float = ...) -> FilterProcessor: ...
