"""Colour grading in three forms.

`apply_color`: all parameters of a record in a fixed order, on RGB or on
spherical harmonics with their higher bands. `Color`: stacked operations folded
into a table per channel, then the operations that mix channels; with named
parameters as a template. `ColorSteps`: clipped after every operation.

Each stage that needs a luminance is a projection of its own, so expressions
stay small; Spark keeps all of them in one code-generated stage.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rotation as rot
from ..functions import scalar as sc
from ..plans.presets import STEP_PRESETS
from ..plans.values import ColorValues, specs
from ..scene_format import BANDS, RGB, SceneFormat, cols, put, to_rgb, to_sh

_LUM = "_luminance"


def _bands(df: DataFrame, change) -> DataFrame:
    """The higher bands, each (r, g, b) by `change`; nothing if there are none."""
    if BANDS not in df.columns:
        return df
    new = lambda b: F.struct(*[c.alias(n) for c, n in zip(change([b[n] for n in RGB]), RGB)])
    return df.withColumn(BANDS, F.transform(BANDS, new))


def _matrix(df: DataFrame, m, bands=None) -> DataFrame:
    """Colours by a 3x3 matrix, and the bands by another, or the same."""
    return _bands(put(df, RGB, rot.linear(m, cols(RGB))), lambda v: rot.linear(m if bands is None else bands, v))


def _each(df: DataFrame, change) -> DataFrame:
    return put(df, RGB, [change(c) for c in cols(RGB)])


def apply_scale(df: DataFrame, k: float) -> DataFrame:
    return _bands(_each(df, lambda c: c * float(k)), lambda v: [c * float(k) for c in v])


def apply_contrast(df: DataFrame, k: float, rgb: bool) -> DataFrame:
    return _bands(_each(df, lambda c: (c - 0.5) * float(k) + 0.5 if rgb else c * float(k)), lambda v: [c * float(k) for c in v])


def apply_fade(df: DataFrame, k: float, rgb: bool) -> DataFrame:
    lift = k if rgb else k / sc.C0 * (1 - k)
    return _each(df, lambda c: c * (1 - k) + lift if rgb else c + lift)


def _gamma(df: DataFrame, k: float, rgb: bool) -> DataFrame:
    if rgb:
        return _each(df, lambda c: F.pow(F.greatest(c, F.lit(sc.EPS)), F.lit(float(k))))
    before = df.withColumn(_LUM, sc.luminance([c * sc.C0 + 0.5 for c in cols(RGB)]))
    after = _each(before, lambda c: (F.pow(F.greatest(c * sc.C0 + 0.5, F.lit(sc.EPS)), F.lit(float(k))) - 0.5) / sc.C0)
    ratio = sc.luminance([c * sc.C0 + 0.5 for c in cols(RGB)]) / (F.col(_LUM) + 1e-8)
    return _bands(after, lambda v: [c * ratio for c in v]).drop(_LUM)


def _vibrance(df: DataFrame, k: float, rgb: bool) -> DataFrame:
    """More saturation where there is little."""
    df, _ = to_rgb(df, SceneFormat(rgb=rgb))
    df = df.withColumn(_LUM, sc.luminance(cols(RGB))).withColumn("_more", (1 - (F.greatest(*cols(RGB)) - F.least(*cols(RGB)))) * (k - 1) + 1)
    df = _each(df, lambda c: sc.clip(F.col(_LUM) + (c - F.col(_LUM)) * F.col("_more"), 0, 1)).drop(_LUM, "_more")
    return df if rgb else to_sh(df, SceneFormat())[0]


def _shadows_highlights(df: DataFrame, shadows: float, highlights: float, rgb: bool) -> DataFrame:
    lum = sc.luminance(cols(RGB) if rgb else [sc.sh_to_rgb(c) for c in cols(RGB)])
    df = df.withColumn(_LUM, lum)
    gain = (1 - sc.smoothstep(0, 0.5, F.col(_LUM))) * float(shadows) + sc.smoothstep(0.5, 1, F.col(_LUM)) * float(highlights) + 1
    return _each(df.withColumn("_gain", gain), lambda c: c * F.col("_gain")).drop(_LUM, "_gain")


def _split_toning(df: DataFrame, v: ColorValues, rgb: bool = True, again: bool = False) -> DataFrame:
    """Tints in dark and in bright parts. `again`: the second sees the first's luminance."""
    for hue, sat, mask in ((v.shadow_tint_hue, v.shadow_tint_sat, lambda x: 1 - x * 2), (v.highlight_tint_hue, v.highlight_tint_sat, lambda x: x * 2 - 1)):
        if _LUM not in df.columns or again:
            df = df.withColumn(_LUM, sc.luminance(cols(RGB) if rgb else [sc.sh_to_rgb(c) for c in cols(RGB)]))
        if sat:
            m = F.greatest(F.lit(0.0), mask(F.col(_LUM))) * float(sat)
            df = put(df, RGB, [c + m * (o if rgb else o / sc.C0) for c, o in zip(cols(RGB), sc.hue_offset(hue))])
    return df.drop(_LUM)


def apply_color(df: DataFrame, v: ColorValues, fmt: SceneFormat = SceneFormat(), split_toning: bool = True, band_hue_transposed: bool = True) -> DataFrame:
    """A record, in this order: temperature, tint, brightness, contrast, gamma,
    saturation, hue, vibrance, shadows and highlights, fade, split toning, clip.

    split_toning=False leaves the tints out, and band_hue_transposed=False turns
    the higher bands' hue the same way as the first's; the published CPU path has
    the one, and both published paths have the other.
    """
    if v.is_neutral():
        return df
    rgb = fmt.rgb
    if v.temperature:
        df = _matrix(df, sc.temperature_matrix(v.temperature))
    if v.tint:
        df = put(df, RGB, [c + v.tint * k for c, k in zip(cols(RGB), (0.05, -0.1, 0.05))])
    if v.brightness != 1:
        k = v.brightness
        df = _bands(_each(df, lambda c: c * k if rgb else c * k + (k - 1) * 0.5 / sc.C0), lambda b: [c * k for c in b])
    if v.contrast != 1:
        df = apply_contrast(df, v.contrast, rgb)
    if v.gamma != 1:
        df = _gamma(df, v.gamma, rgb)
    if v.saturation != 1:
        df = _matrix(df, sc.saturation_matrix(v.saturation))
    if v.hue_shift:
        m = sc.hue_matrix(v.hue_shift)
        df = _matrix(df, m, m.T if band_hue_transposed else m)
    if v.vibrance != 1:
        df = _vibrance(df, v.vibrance, rgb)
    if v.shadows or v.highlights:
        df = _shadows_highlights(df, v.shadows, v.highlights, rgb)
    if v.fade:
        df = apply_fade(df, v.fade, rgb)
    if split_toning and (v.shadow_tint_sat or v.highlight_tint_sat):
        df = _split_toning(df, v, rgb)
    return _each(df, lambda c: sc.clip(c, 0, 1)) if rgb else df


# ------------------------------------------------------------ table pipeline


@dataclass(frozen=True)
class Param:
    """A named parameter of a template: a default, and a range or none."""

    name: str
    default: float = 1.0
    range: tuple[float, float] | None = None

    def __post_init__(self):
        self.validate(self.default)

    def validate(self, value) -> float:
        if not isinstance(value, (int, float)) or isinstance(value, bool):
            raise TypeError(f"{self.name} has to be a number, not {type(value).__name__}")
        if self.range and not self.range[0] <= value <= self.range[1]:
            raise ValueError(f"{self.name} has to be from {self.range[0]} to {self.range[1]}, not {value}")
        return float(value)


#: What the methods of Color accept; gamma only has to be positive.
_LIMITS = {k: s for k, s in specs(ColorValues).items()}


@dataclass(frozen=True)
class Color:
    """Stacked colour operations. Each method gives a new pipeline; stacked calls
    of one kind fold: factors multiply, offsets add up and are clipped, and tint
    hues average by saturation."""

    ops: tuple = ()
    lut_size: int = 1024
    params: tuple[tuple[str, Param], ...] = field(default=())

    @classmethod
    def template(cls, lut_size: int = 1024, **given: Param | float) -> Color:
        """Operations with named parameters, filled in when it is called."""
        names = [p.name for p in given.values() if isinstance(p, Param)]
        if len(set(names)) < len(names):
            raise ValueError("two parameters have one name")
        out = cls(lut_size=lut_size)
        for op, p in given.items():
            if op not in _LIMITS or op.startswith(("shadow_tint", "highlight_tint")):
                raise ValueError(f"no operation {op!r}")
            out = replace(out, params=(*out.params, (op, p))) if isinstance(p, Param) else out._with(op, p)
        return out

    def _with(self, op: str, value: float) -> Color:
        if not isinstance(value, (int, float)) or isinstance(value, bool):
            raise TypeError(f"{op} has to be a number, not {type(value).__name__}")
        s = _LIMITS[op]
        if op == "gamma" and value <= 0:
            raise ValueError(f"gamma has to be positive, not {value}")
        if op != "gamma" and not s.low <= value <= s.high:
            raise ValueError(f"{op} has to be from {s.low} to {s.high}, not {value}")
        return replace(self, ops=(*self.ops, (op, float(value))))

    def _tint(self, kind: str, hue: float, saturation: float) -> Color:
        self._with(f"{kind}_hue", hue), self._with(f"{kind}_sat", saturation)
        return replace(self, ops=(*self.ops, (kind, (float(hue), float(saturation)))))

    def shadow_tint(self, hue: float, saturation: float) -> Color:
        return self._tint("shadow_tint", hue, saturation)

    def highlight_tint(self, hue: float, saturation: float) -> Color:
        return self._tint("highlight_tint", hue, saturation)

    def is_identity(self) -> bool:
        return not self.ops and not self.params

    def folded(self) -> ColorValues:
        """One record that says what all stacked operations do."""
        out = {}
        for op, s in _LIMITS.items():
            if not op.startswith(("shadow_tint", "highlight_tint")):
                value = functools.reduce(s.combine, (x for o, x in self.ops if o == op), s.neutral)
                out[op] = s.validate(value) if s.rule == "plus" else value
        for kind in ("shadow_tint", "highlight_tint"):
            tints = [x for o, x in self.ops if o == kind]
            total = sum(sat for _, sat in tints)
            if total > 0:
                out |= {f"{kind}_hue": sum(h * s for h, s in tints) / total, f"{kind}_sat": min(total, 1.0)}
        return ColorValues(**out)

    def lut(self) -> np.ndarray:
        """lut_size x 3: temperature and tint offsets, brightness, contrast, gamma."""
        return _lut(self.folded(), self.lut_size)

    def __call__(self, df: DataFrame, fmt: SceneFormat = SceneFormat(), params: dict[str, float] | None = None, restore_format: bool = False, exact: bool = False) -> DataFrame:
        """Grades RGB, converting first where needed. Tables are looked up by the
        truncated index; exact=True evaluates what the tables sample instead."""
        if self.params:
            params = params or {}
            unknown = params.keys() - {p.name for _, p in self.params}
            if unknown:
                raise ValueError(f"no parameters {sorted(unknown)}")
            filled = replace(self, params=())
            for op, p in self.params:
                filled = filled._with(op, p.validate(params.get(p.name, p.default)))
            return filled(df, fmt, None, restore_format, exact)
        if self.is_identity():
            return df
        v, was_rgb = self.folded(), fmt.rgb
        df, fmt = to_rgb(df, fmt)
        df = _tables(df, v, None if exact else self.lut_size)
        if v.saturation != 1:
            df = put(df, RGB, rot.linear(sc.saturation_matrix(v.saturation), cols(RGB)))
        if v.vibrance != 1:
            hi, lo = F.greatest(*cols(RGB)), F.least(*cols(RGB))
            df = df.withColumns({"_boost": (1 - (hi - lo)) * (v.vibrance - 1), "_mid": (hi + lo) * 0.5})
            df = _each(df, lambda c: c + (c - F.col("_mid")) * F.col("_boost")).drop("_boost", "_mid")
        if abs(v.hue_shift) >= 0.5:
            df = put(df, RGB, rot.linear(sc.hue_matrix_about_grey(v.hue_shift), cols(RGB)))
        if v.shadows or v.highlights:
            df = df.withColumn("_gain", F.when(sc.luminance(cols(RGB)) < 0.5, float(v.shadows)).otherwise(float(v.highlights)) + 1)
            df = _each(df, lambda c: c * F.col("_gain")).drop("_gain")
        if v.fade > 0:
            df = apply_fade(df, v.fade, True)
        if v.shadow_tint_sat > 0 or v.highlight_tint_sat > 0:
            df = _split_toning(df, v)
        df = _each(df, lambda c: sc.clip(c, 0, 1))
        return to_sh(df, fmt)[0] if restore_format and not was_rgb else df


for _op in ("temperature", "brightness", "contrast", "gamma", "saturation", "vibrance", "hue_shift", "shadows", "highlights", "tint", "fade"):
    setattr(Color, _op, functools.partialmethod(Color._with, _op))


@functools.lru_cache(maxsize=256)
def _lut(v: ColorValues, n: int) -> np.ndarray:
    offset = np.array([0.1, 0, -0.1]) * v.temperature + np.array([0.05, -0.1, 0.05]) * v.tint
    x = ((np.linspace(0, 1, n)[:, None] + offset) * v.brightness - 0.5) * v.contrast + 0.5
    return np.clip(np.clip(x, 1e-7, 1) ** v.gamma, 0, 1)


def _tables(df: DataFrame, v: ColorValues, n: int | None) -> DataFrame:
    """The stage that the table stands for. A lookup by a truncated index is the
    formula at the truncated sample, so no table has to travel with the plan."""
    offsets = (0.1 * v.temperature + 0.05 * v.tint, -0.1 * v.tint, -0.1 * v.temperature + 0.05 * v.tint)

    def one(c: Column, o: float) -> Column:
        x = sc.clip(c, 0, 1)
        if n is not None:
            x = F.floor(x * (n - 1)).cast("double") / (n - 1)
        x = ((x + o) * v.brightness - 0.5) * v.contrast + 0.5
        return F.pow(sc.clip(x, 1e-7, 1), F.lit(float(v.gamma)))

    return put(df, RGB, [one(c, o) for c, o in zip(cols(RGB), offsets)])


def lookup(df: DataFrame, table: np.ndarray, interpolate: bool = False) -> DataFrame:
    """Any table of n x 3 values, by truncated index or linear in between."""
    n = len(table)
    out = []
    for k, c in enumerate(cols(RGB)):
        values = F.array(*[F.lit(float(x)) for x in table[:, k]])
        at = sc.clip(c, 0, 1) * (n - 1)
        low = F.floor(at).cast("int")
        value = F.element_at(values, low + 1)
        if interpolate:
            value = value + (F.element_at(values, F.least(low + 2, F.lit(n))) - value) * (at - low)
        out.append(value)
    return put(df, RGB, out)


# ------------------------------------------------------------- step pipeline

#: The order in which the steps apply, whatever order they were added in.
_STEP_ORDER = ("temperature", "tint", "brightness", "contrast", "gamma", "saturation", "vibrance", "hue_shift", "shadows", "highlights", "fade", "shadow_tint", "highlight_tint")


@dataclass(frozen=True)
class ColorSteps:
    """Operations on RGB that clip after each; in a fixed order of kinds."""

    ops: tuple = ()

    def _with(self, op: str, *value: float) -> ColorSteps:
        return replace(self, ops=(*self.ops, (op, value)))

    def preset(self, name: str, strength: float = 1.0) -> ColorSteps:
        if name not in STEP_PRESETS:
            raise ValueError(f"no preset {name!r}; there are {', '.join(STEP_PRESETS)}")
        out = self
        for op, s in specs(ColorValues).items():
            value = getattr(STEP_PRESETS[name], op)
            if value != s.neutral:
                out = out._with(op, s.neutral + (value - s.neutral) * strength)
        return out

    def requires_rgb(self) -> bool:
        return bool(self.ops)

    def __call__(self, df: DataFrame, fmt: SceneFormat = SceneFormat(), restore_format: bool = False) -> DataFrame:
        if not self.ops:
            return df
        was_rgb = fmt.rgb
        df, fmt = to_rgb(df, fmt)
        for op, value in sorted(self.ops, key=lambda x: _STEP_ORDER.index(x[0])):
            df = _each(_step(df, op, *value), lambda c: sc.clip(c, 0, 1))
        return to_sh(df, fmt)[0] if restore_format and not was_rgb else df


for _op in _STEP_ORDER:
    setattr(ColorSteps, _op, functools.partialmethod(ColorSteps._with, _op))


def _step(df: DataFrame, op: str, k: float, sat: float = 0.0) -> DataFrame:
    """One operation on RGB, before its clip."""
    if op == "temperature":
        return _matrix(df, sc.temperature_matrix(k))
    if op == "tint":
        return put(df, RGB, [c + k * o for c, o in zip(cols(RGB), (0.05, -0.1, 0.05))])
    if op == "brightness":
        return apply_scale(df, k)
    if op == "contrast":
        return apply_contrast(df, k, True)
    if op == "gamma":
        return _each(df, lambda c: F.pow(F.greatest(c, F.lit(1e-8)), F.lit(float(k))))
    if op == "saturation":
        return _matrix(df, sc.saturation_matrix(k))
    if op == "vibrance":
        return _vibrance(df, k, True)
    if op == "hue_shift":
        return _matrix(df, sc.hue_matrix(k), sc.hue_matrix(k).T)
    if op in ("shadows", "highlights"):
        return _shadows_highlights(df, k if op == "shadows" else 0.0, k if op == "highlights" else 0.0, True)
    if op == "fade":
        return apply_fade(df, k, True) if k > 0 else df
    tint = ColorValues(shadow_tint_hue=k, shadow_tint_sat=sat) if op == "shadow_tint" else ColorValues(highlight_tint_hue=k, highlight_tint_sat=sat)
    return _split_toning(df, tint)


def apply_color_steps(df: DataFrame, v: ColorValues, fmt: SceneFormat = SceneFormat(), restore_format: bool = False) -> DataFrame:
    """A record by steps, each clipped."""
    out = ColorSteps()
    for op, s in specs(ColorValues).items():
        if op in _STEP_ORDER and getattr(v, op) != s.neutral:
            out = out._with(op, getattr(v, op))
    for kind in ("shadow_tint", "highlight_tint"):
        if getattr(v, f"{kind}_sat"):
            out = out._with(kind, getattr(v, f"{kind}_hue"), getattr(v, f"{kind}_sat"))
    return out(df, fmt, restore_format)


def learnable_color(df: DataFrame, v: ColorValues) -> DataFrame:
    """The smooth order of the fitting module: brightness, contrast, gamma,
    temperature, tint, saturation, vibrance, shadows and highlights by sigmoids
    of luminance, fade, hue, split toning, one clip."""
    for op in ("brightness", "contrast", "gamma", "temperature", "tint", "saturation", "vibrance"):
        if getattr(v, op) != specs(v)[op].neutral:
            df = _step(df, op, getattr(v, op))
    if v.shadows or v.highlights:
        dark = sc.sigmoid((0.5 - sc.luminance(cols(RGB))) * 10)
        df = df.withColumn("_gain", dark * float(v.shadows) + (1 - dark) * float(v.highlights) + 1)
        df = _each(df, lambda c: c * F.col("_gain")).drop("_gain")
    if v.fade:
        df = apply_fade(df, v.fade, True)
    if v.hue_shift:
        df = _step(df, "hue_shift", v.hue_shift)
    if v.shadow_tint_sat or v.highlight_tint_sat:
        df = _split_toning(df, v)
    return _each(df, lambda c: sc.clip(c, 0, 1))
