"""What the columns of a scene hold: names, and the three format flags.

A scene is a DataFrame with a row per splat. Position, scale, orientation and
colour are flat columns, so a query reads and pushes down only what it needs.
The flags are given, never guessed from values.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scalar as sc

POS = ("x", "y", "z")
SCALE = ("sx", "sy", "sz")
QUAT = ("qw", "qx", "qy", "qz")
RGB = ("r", "g", "b")
OPACITY = "opacity"
#: Higher bands of spherical harmonics, if a scene has them: an array of r, g, b.
BANDS = "shn"


@dataclass(frozen=True)
class SceneFormat:
    #: Colours are RGB from 0 to 1, or the zeroth harmonic.
    rgb: bool = True
    #: Scales are natural logarithms.
    log_scale: bool = False
    #: Opacities are logits.
    logit_opacity: bool = False

    @property
    def is_linear(self) -> bool:
        return not (self.log_scale or self.logit_opacity)

    @property
    def is_log(self) -> bool:
        return self.log_scale and self.logit_opacity

    def summary(self) -> str:
        return f"colour {'RGB' if self.rgb else 'SH'}, scale {'log' if self.log_scale else 'linear'}, opacity {'logit' if self.logit_opacity else 'linear'}"


def cols(names) -> list[Column]:
    return [F.col(n) for n in names]


def put(df: DataFrame, names, columns) -> DataFrame:
    """df with these columns in place of what they are named after."""
    return df.withColumns(dict(zip(names, columns)))


def to_rgb(df: DataFrame, fmt: SceneFormat) -> tuple[DataFrame, SceneFormat]:
    """Clips to [0, 1], so the way back need not lead to the start."""
    return (df, fmt) if fmt.rgb else (put(df, RGB, map(sc.sh_to_rgb, cols(RGB))), replace(fmt, rgb=True))


def to_sh(df: DataFrame, fmt: SceneFormat) -> tuple[DataFrame, SceneFormat]:
    return (put(df, RGB, map(sc.rgb_to_sh, cols(RGB))), replace(fmt, rgb=False)) if fmt.rgb else (df, fmt)


def to_linear(df: DataFrame, fmt: SceneFormat) -> tuple[DataFrame, SceneFormat]:
    if fmt.log_scale:
        df = put(df, SCALE, map(F.exp, cols(SCALE)))
    if fmt.logit_opacity:
        df = put(df, [OPACITY], [sc.sigmoid(F.col(OPACITY))])
    return df, replace(fmt, log_scale=False, logit_opacity=False)


def to_log(df: DataFrame, fmt: SceneFormat) -> tuple[DataFrame, SceneFormat]:
    if not fmt.log_scale:
        df = put(df, SCALE, [F.ln(F.greatest(s, F.lit(1e-9))) for s in cols(SCALE)])
    if not fmt.logit_opacity:
        df = put(df, [OPACITY], [sc.logit(F.col(OPACITY))])
    return df, replace(fmt, log_scale=True, logit_opacity=True)


def pre_activate(df: DataFrame, min_scale: float = 1e-4, max_scale: float = 100.0, min_norm: float = 1e-8) -> DataFrame:
    """Log scales to linear within limits, logits to opacities, unit quaternions;
    a quaternion shorter than min_norm becomes no rotation. One projection."""
    from .functions import rotation as rot

    unit = rot.normalize_columns(cols(QUAT), min_norm)
    unit = [F.coalesce(u, F.lit(i)) for u, i in zip(unit, rot.IDENTITY)]
    scales = [sc.clip(F.exp(s), min_scale, max_scale) for s in cols(SCALE)]
    return put(df, (*SCALE, OPACITY, *QUAT), (*scales, sc.sigmoid(F.col(OPACITY)), *unit))
