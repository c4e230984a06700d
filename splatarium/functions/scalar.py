"""Small Column functions: clipping, logit and log spaces, colour spaces,
smoothstep, and interpolation in short tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The zeroth harmonic's factor, and Rec. 601 luma.
C0 = 0.28209479177387814
LUMA = (0.299, 0.587, 0.114)
EPS = 1e-7


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def sigmoid(c: Column) -> Column:
    return 1 / (F.exp(-c) + 1)


def logit(c: Column, eps: float = EPS) -> Column:
    p = clip(c, eps, 1 - eps)
    return F.ln(p / (1 - p))


def logit_number(p: float, eps: float = EPS) -> float:
    p = min(max(p, eps), 1 - eps)
    return math.log(p / (1 - p))


def log_number(v: float, least: float = 1e-9) -> float:
    return math.log(max(v, least))


def luminance(rgb) -> Column:
    return rgb[0] * LUMA[0] + rgb[1] * LUMA[1] + rgb[2] * LUMA[2]


def sh_to_rgb(c: Column) -> Column:
    return clip(c * C0 + 0.5, 0, 1)


def rgb_to_sh(c: Column) -> Column:
    return (c - 0.5) / C0


def smoothstep(a: float, b: float, c: Column) -> Column:
    t = clip((c - a) / (b - a), 0, 1)
    return t * t * (3 - t * 2)


def hue_offset(degrees: float) -> tuple[float, float, float]:
    """Half the cosines of the angles between a hue and red, green, blue."""
    return tuple(0.5 * math.cos(math.radians(degrees - 120 * k)) for k in range(3))


def linear_interp(x: Column, centers, values) -> Column:
    """Piecewise linear through (center, value), continued beyond both ends."""
    centers, values = list(map(float, centers)), list(map(float, values))
    out = None
    for a, b, u, v in list(zip(centers, centers[1:], values, values[1:]))[::-1]:
        piece = (x - a) / (b - a + 1e-8) * (v - u) + u
        out = piece if out is None else F.when(x < b, piece).otherwise(out)
    return out if out is not None else F.lit(values[0])


def nearest(x: Column, centers, values) -> Column:
    """The value of the nearest center; of two at one distance, the first's.

    Distances count to 12 digits of the largest center, so the last bit of a
    difference decides nothing.
    """
    digits = 12 - max((math.frexp(abs(float(c)))[1] * 3 // 10 for c in centers if c), default=0)
    table = F.array(*[F.struct(F.round(F.abs(x - float(c)), digits).alias("d"), F.lit(k).alias("k"), F.lit(float(v)).alias("v")) for k, (c, v) in enumerate(zip(centers, values))])
    return F.array_min(table)["v"]


def saturation_matrix(factor: float) -> np.ndarray:
    return np.outer(np.ones(3), LUMA) * (1 - factor) + factor * np.eye(3)


def temperature_matrix(temp: float) -> np.ndarray:
    return np.diag([1 + 0.3 * temp, 1, 1 - 0.3 * temp])


def tint_matrix(tint: float) -> np.ndarray:
    return np.diag([1, 1 - 0.1 * tint, 1])


#: Hue rotation as base + cos * C + sin * S, in two published forms.
HUE_LUMA = (
    np.array([[0.299, 0.587, 0.114]] * 3),
    np.array([[0.701, -0.587, -0.114], [-0.299, 0.413, -0.114], [-0.300, -0.588, 0.886]]),
    np.array([[0.168, 0.330, -0.497], [-0.328, 0.035, 0.292], [1.250, -1.050, -0.203]]),
)
HUE_SVG = (
    np.array([[0.213, 0.715, 0.072]] * 3),
    np.array([[0.787, -0.715, -0.072], [-0.213, 0.285, -0.072], [-0.213, -0.715, 0.928]]),
    np.array([[-0.213, -0.715, 0.928], [0.143, 0.140, -0.283], [-0.787, 0.715, 0.072]]),
)


def hue_matrix(degrees: float, form=HUE_LUMA) -> np.ndarray:
    a = math.radians(degrees)
    return form[0] + math.cos(a) * form[1] + math.sin(a) * form[2]


def hue_matrix_about_grey(degrees: float) -> np.ndarray:
    """Rotation about the grey axis (1, 1, 1); less than half a degree is none."""
    from .rotation import axis_angle_to_rotation_matrix

    return np.eye(3) if abs(degrees) < 0.5 else axis_angle_to_rotation_matrix(np.ones(3) / math.sqrt(3) * math.radians(degrees))
