"""Opacity changes, in linear or logit space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..plans.values import OpacityValues
from ..scene_format import OPACITY, SceneFormat


def scaled(o: Column, scale: float) -> Column:
    """Up to 1 a factor; above, half the excess of the way to full opacity."""
    return o * float(scale) if scale <= 1 else o + (1 - o) * ((scale - 1) * 0.5)


def apply_opacity(df: DataFrame, v: OpacityValues, fmt: SceneFormat = SceneFormat()) -> DataFrame:
    if v.is_neutral():
        return df
    o = F.col(OPACITY)
    return df.withColumn(OPACITY, sc.logit(scaled(sc.sigmoid(o), v.scale)) if fmt.logit_opacity else sc.clip(scaled(o, v.scale), 0, 1))


def multiply_opacity(df: DataFrame, factor: float) -> DataFrame:
    """Linear opacities times a positive factor, clipped."""
    if factor <= 0:
        raise ValueError(f"factor has to be positive, not {factor}")
    return df.withColumn(OPACITY, sc.clip(F.col(OPACITY) * float(factor), 0, 1))
