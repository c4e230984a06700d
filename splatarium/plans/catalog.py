"""All registered scene queries, each with the same in SQL.

The SQL is written for DuckDB, from the formulas; constants such as matrices are
filled in as numbers. Sums and powers are rounded in both.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rotation as rot
from ..functions import scalar as sc
from ..operators import compose, filters, learn, opacity, stats
from ..operators.colour import Color, ColorSteps
from ..operators.filters import Filter, Tests
from ..operators.transform import Transform
from ..scene import Scene, process
from ..scene_format import BANDS, OPACITY, POS, QUAT, RGB, SCALE, cols, pre_activate
from ..sources import ply, ply_source
from ..sources.scratch import scratch_path
from . import fixtures as fx
from .pipeline import GroupedPipeline, Pipeline
from .presets import get_color_preset
from .values import ColorValues, FilterValues, HistogramConfig, OpacityValues, TransformValues

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "pipeline_grade_and_crop"
L, E, P = fx.SQL_L, fx.SQL_E, fx.SQL_P
KEYS = ", ".join(fx.KEYS_L)
C0 = repr(sc.C0)


def register(name: str, sql: str | None = None):
    def put_in(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = _same_rounding(sql)
        return f

    return put_in


#: Decimal inputs give results that end in a 5 where they are cut; this moves them off the edge.
_OFF_TIES = 1.23456e-07


def _rounded(c):
    """Six digits by plain arithmetic; `round` of a double goes through decimal numbers."""
    return F.floor(((F.col(c) if isinstance(c, str) else c) + _OFF_TIES) * 1e6 + 0.5) / 1e6


def _sum_of_many(c):
    """A sum of doubles that loses no digits with their number: whole units of 2^-20 add up exactly, and the rests to little."""
    units = F.when(F.abs(c) < 2.0**20, F.floor(c * 2.0**20)).otherwise(0)
    return F.sum(units) / 2.0**20 + F.sum(c - units / 2.0**20)


def _same_rounding(sql: str) -> str:
    """The same in SQL for every round(v, 10), which stands for it."""
    while (end := sql.find(", 10)")) >= 0:
        begin, depth = end, 1
        while depth:
            begin -= 1
            depth += (sql[begin] == ")") - (sql[begin] == "(")
        inner = sql[begin + 1 : end]
        sql = f"{sql[: begin - len('round')]}floor(({inner} + {_OFF_TIES!r}) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE{sql[end + len(', 10)') :]}"
    return sql


def _out(df: DataFrame, keys, values, digits: int = 10) -> DataFrame:
    return df.select(*keys, *[(_rounded(v) if digits == 10 else F.round(v, digits)).alias(v) for v in values])


def _r(values, digits: int = 10) -> str:
    """SQL select list of rounded columns; 10 digits stand for the rounding above."""
    return ", ".join(f"round({v}, {digits}) AS {v}" for v in values)


def _n(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _affine(m, names, shift=(0, 0, 0)) -> list[str]:
    m = np.asarray(m, float)
    return ["(" + " + ".join([*(f"{_n(a)}*{c}" for a, c in zip(row, names)), _n(t)]) + ")" for row, t in zip(m, shift)]


def _hamilton(q, names) -> list[str]:
    """Literal q times a row's quaternion, written out."""
    w, x, y, z = q
    rows = [(w, -x, -y, -z), (x, w, -z, y), (y, z, w, -x), (z, -y, x, w)]
    return ["(" + " + ".join(f"{_n(a)}*{c}" for a, c in zip(row, names)) + ")" for row in rows]


# Numbers for the SQL, worked out by themselves: matrix exponentials of the rotation
# vectors, products of 4x4 matrices, and quaternions as eigenvectors.
#: The inverse rotations of the boxes and ellipsoids (0.3, -0.2, 0.5) and of the frustum (0.1, 0.2, 0.05).
_SHAPE_TURN = ((0.859533898558663, 0.4398676329582309, 0.26022671404809444), (-0.49799153700292204, 0.8353156052067086, 0.23292116428443663), (-0.11491695393636674, -0.329794337692255, 0.9370324372849181))
_FRUSTUM_TURN = ((0.9788428062071255, 0.059519973493763895, -0.1957655063893064), (-0.03960732051223487, 0.9937772959432722, 0.10410545725138103), (0.20074366963468865, -0.0941491307606165, 0.9751091837730886))
#: Matrix and quaternion of transform_srt, and of transform_steps.
_SRT_MATRIX = ((0.6938588993097978, -0.4673250396482803, 0.11685747312189146, 0.890193662240488), (1.3632659731868455, 0.09710617010449868, -1.0581732309131235, 1.1314634061871074), (1.288435374475382, 0.14892178835002393, 1.0566994579133875, 2.416068342458974))
_SRT_TURN = (0.7492676583070113, 0.33475767510630355, -0.18895540828361257, 0.5392876123673934)
_STEPS_MATRIX = ((0.9859225562148001, -1.2858742826179321, 1.1723839142741137, 0.031930587856608794), (4.040283389007855, 4.251475294998789, 1.2653331389488551, -1.3441016950394762), (-0.5509517158424106, 0.29077023096382987, 0.7822434912452417, -0.31069833588209583))
_STEPS_TURN = (0.8636816521707773, 0.023122343247532293, 0.3291559077703491, 0.38101935557944766)


LUM = "(0.299*r + 0.587*g + 0.114*b)"
DBL = lambda c: f"CAST({c} AS DOUBLE)"
CLIP01 = lambda x: f"least(greatest({x}, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))"


# ------------------------------------------------------------------- filters

_ALWAYS = "opacity >= 0 AND opacity <= 1 AND greatest(sx,sy,sz) >= 0 AND greatest(sx,sy,sz) <= 100"
_SPHERE = lambda r, c=(0, 0, 0): f"((x-{_n(c[0])})*(x-{_n(c[0])}) + (y-{_n(c[1])})*(y-{_n(c[1])}) + (z-{_n(c[2])})*(z-{_n(c[2])}) <= {_n(r * r)})"


def _local_sql(center, turn):
    return _affine(turn, [f"({c}-{_n(o)})" for c, o in zip(POS, center)])


def _box_sql(center, half, turn):
    return "(" + " AND ".join(f"abs({p}) <= {_n(h)}" for p, h in zip(_local_sql(center, turn), half)) + ")"


def _ellipsoid_sql(center, radii, turn):
    return "(" + " + ".join(f"({p}/{_n(r)})*({p}/{_n(r)})" for p, r in zip(_local_sql(center, turn), radii)) + " <= 1)"


def _frustum_sql(position, turn, half_angle, aspect, near, far):
    x, y, z = _local_sql(position, turn)
    return f"({z} < {_n(-near)} AND {z} > {_n(-far)} AND abs({x}) <= -{z}*tan({_n(half_angle)})*{_n(aspect)} AND abs({y}) <= -{z}*tan({_n(half_angle)}))"


_ROT = (0.3, -0.2, 0.5)
_FILTERS: dict[str, tuple[FilterValues, str]] = {
    "filter_thresholds": (FilterValues(min_opacity=0.3, max_opacity=0.9, min_scale=0.2, max_scale=0.8), "opacity >= 0.3 AND opacity <= 0.9 AND greatest(sx,sy,sz) >= 0.2 AND greatest(sx,sy,sz) <= 0.8"),
    "filter_sphere": (FilterValues(sphere_radius=4.0, sphere_center=(1.0, 0.5, -0.5)), f"{_ALWAYS} AND {_SPHERE(4.0, (1.0, 0.5, -0.5))}"),
    "filter_box": (FilterValues(box_min=(-3.0, -4.05, -2.5), box_max=(2.0, 1.0, 4.5)), f"{_ALWAYS} AND x BETWEEN -3.0 AND 2.0 AND y BETWEEN -4.05 AND 1.0 AND z BETWEEN -2.5 AND 4.5"),
    "filter_rotated_box": (FilterValues(box_min=(-3.03, -2.07, -2.51), box_max=(2.01, 3.03, 4.04), box_rot=_ROT), f"{_ALWAYS} AND {_box_sql((-0.51, 0.48, 0.765), (2.52, 2.55, 3.275), _SHAPE_TURN)}"),
    "filter_ellipsoid": (FilterValues(ellipsoid_center=(0.51, 0.12, 0.03), ellipsoid_radii=(3.03, 4.07, 2.52), ellipsoid_rot=_ROT), f"{_ALWAYS} AND {_ellipsoid_sql((0.51, 0.12, 0.03), (3.03, 4.07, 2.52), _SHAPE_TURN)}"),
    "filter_frustum": (FilterValues(frustum_pos=(0.5, 0.3, 6.07), frustum_rot=(0.1, 0.2, 0.05), frustum_fov=0.9, frustum_aspect=1.3, frustum_near=1.03, frustum_far=9.02), f"{_ALWAYS} AND {_frustum_sql((0.5, 0.3, 6.07), _FRUSTUM_TURN, 0.45, 1.3, 1.03, 9.02)}"),
    "filter_combined": (FilterValues(min_opacity=0.3, max_scale=0.9, sphere_radius=4.0, box_min=(-5.0, -5.0, 0.0), box_max=(5.0, 5.0, 5.0)), f"opacity >= 0.3 AND opacity <= 1 AND greatest(sx,sy,sz) <= 0.9 AND {_SPHERE(4.0)} AND x BETWEEN -5 AND 5 AND y BETWEEN -5 AND 5 AND z BETWEEN 0 AND 5"),
    "filter_outside_sphere": (FilterValues(sphere_radius=4.0, invert=True), f"NOT ({_ALWAYS} AND {_SPHERE(4.0)})"),
    "filter_outside_box": (FilterValues(box_min=(-3.0, -4.05, -2.5), box_max=(2.0, 1.0, 4.5), invert=True), f"NOT ({_ALWAYS} AND x BETWEEN -3.0 AND 2.0 AND y BETWEEN -4.05 AND 1.0 AND z BETWEEN -2.5 AND 4.5)"),
    "filter_outside_ellipsoid": (FilterValues(ellipsoid_center=(0.51, 0.12, 0.03), ellipsoid_radii=(3.03, 4.07, 2.52), ellipsoid_rot=_ROT, invert=True), f"NOT ({_ALWAYS} AND {_ellipsoid_sql((0.51, 0.12, 0.03), (3.03, 4.07, 2.52), _SHAPE_TURN)})"),
    "filter_outside_frustum": (FilterValues(frustum_pos=(0.5, 0.3, 6.07), frustum_rot=(0.1, 0.2, 0.05), frustum_fov=0.9, frustum_aspect=1.3, frustum_near=1.03, frustum_far=9.02, invert=True), f"NOT ({_ALWAYS} AND {_frustum_sql((0.5, 0.3, 6.07), _FRUSTUM_TURN, 0.45, 1.3, 1.03, 9.02)})"),
    "filter_merged_spheres": (FilterValues(sphere_radius=5.0) + FilterValues(sphere_radius=3.0, sphere_center=(2.0, 0.0, 0.0), min_opacity=0.2), f"{_ALWAYS} AND opacity >= 0.2 AND {_SPHERE(3.0, (2.0, 0.0, 0.0))}"),
}
for _name, (_v, _where) in _FILTERS.items():
    register(_name, f"SELECT {KEYS}, {_r(POS)} FROM ({L}) WHERE {_where}")(lambda spark, sf, v=_v: _out(fx.scene_l(spark, sf).filter(v).df, fx.KEYS_L, POS))


@register("filter_both_spheres", f"SELECT {KEYS}, {_r(POS)} FROM ({L}) WHERE {_ALWAYS} AND {_SPHERE(5.0)} AND {_SPHERE(3.0, (2.0, 0.0, 0.0))}")
def _filter_both(spark, sf):
    return _out(fx.scene_l(spark, sf).filter(Filter.sphere(5.0) & Filter.sphere(3.0, (2.0, 0.0, 0.0))).df, fx.KEYS_L, POS)


@register("filter_algebra", f"SELECT {KEYS}, {_r(POS)} FROM ({L}) WHERE ({_ALWAYS} AND {_SPHERE(3.0)}) OR NOT ({_ALWAYS} AND opacity >= 0.5 AND x BETWEEN -4 AND 4 AND y BETWEEN -4 AND 4 AND z BETWEEN -4 AND 4)")
def _filter_algebra(spark, sf):
    f = Filter.sphere(3.0) | ~(Filter.min_opacity(0.5) & Filter.box((-4, -4, -4), (4, 4, 4)))
    return _out(fx.scene_l(spark, sf).filter(f).df, fx.KEYS_L, POS)


@register("filter_log_logit", f"SELECT gid, {_r(POS)} FROM ({E}) WHERE opacity >= ln(0.3/(1-0.3+1e-7)) AND greatest(sx,sy,sz) <= ln(0.9) AND {_SPHERE(2.0)}")
def _filter_log(spark, sf):
    return _out(fx.scene_e(spark, sf).filter(FilterValues(min_opacity=0.3, max_scale=0.9, sphere_radius=2.0)).df, ["gid"], POS)


_TESTS = Tests().within_sphere((0.0, 0.0, 0.0), 2.0).min_opacity(0.95).near_plane(4.55, "x").far_plane(-4.85, "y")
_TESTS_SQL = [_SPHERE(2.0), "opacity >= 0.95", "x >= 4.55", "y <= -4.85"]
register("tests_any", f"SELECT {KEYS}, {_r(POS)} FROM ({L}) WHERE {' OR '.join(_TESTS_SQL)}")(lambda spark, sf: _out(_TESTS(fx.scene_l(spark, sf).df, "or"), fx.KEYS_L, POS))
register("tests_mask", f"SELECT {KEYS}, {' AND '.join(_TESTS_SQL[:2])} AS mask_near FROM ({L})")(
    lambda spark, sf: Tests(_TESTS.ops[:2]).mask(fx.scene_l(spark, sf).df, "mask_near").select(*fx.KEYS_L, "mask_near")
)
register("tests_planes", f"SELECT {KEYS}, {_r(POS)} FROM ({L}) WHERE z >= -2.05 AND x <= 3.03")(
    lambda spark, sf: _out(Tests().near_plane(-2.05).far_plane(3.03, "x")(fx.scene_l(spark, sf).df), fx.KEYS_L, POS)
)
register("tests_complement", f"SELECT {KEYS}, {_r(POS)} FROM ({L}) WHERE NOT {_SPHERE(2.0)} AND opacity <= 0.95 - 1e-6 AND x <= 4.55 - 1e-6 AND y >= -4.85 + 1e-6")(
    lambda spark, sf: _out(_TESTS.complement()(fx.scene_l(spark, sf).df), fx.KEYS_L, POS)
)


@register("split_by_region", f"SELECT z > 0 AND x < 1 AS inside, count(*) AS n, round(sum(opacity), 4) AS opacity_sum FROM ({L}) GROUP BY 1")
def _split(spark, sf):
    inside, outside = fx.scene_l(spark, sf).split((F.col("z") > 0) & (F.col("x") < 1))
    both = inside.df.withColumn("inside", F.lit(True)).unionByName(outside.df.withColumn("inside", F.lit(False)))
    return both.groupBy("inside").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("opacity"), 4).alias("opacity_sum"))


@register("filter_soft_weight", f"SELECT {KEYS}, round(1/(1+exp(-(opacity-0.4)*10)) * 1/(1+exp(-(0.7-greatest(sx,sy,sz))*8)) * 1/(1+exp(-(4-sqrt(x*x+y*y+z*z))*5)), 10) AS weight FROM ({L})")
def _soft(spark, sf):
    w = filters.soft_weight(opacity=0.4, scale=0.7, scale_sharpness=8.0, shape="sphere", radius=4.0, sharpness=5.0)
    return fx.scene_l(spark, sf).df.select(*fx.KEYS_L, _rounded(w).alias("weight"))


# ---------------------------------------------------------------- transforms


@register("rotation_axis_angle", f"""SELECT gid, round(qx*f, 10) AS ax, round(qy*f, 10) AS ay, round(qz*f, 10) AS az FROM (
  SELECT gid, qx, qy, qz, CASE WHEN s > 0 THEN 2*atan2(s, abs(qw))/s ELSE 2/sqrt(qw*qw+s*s) END * CASE WHEN qw < 0 THEN -1 ELSE 1 END AS f FROM (SELECT *, sqrt(qx*qx+qy*qy+qz*qz) AS s FROM ({E})))""")
def _axis_angle(spark, sf):
    """The orientation of every row as axis times angle."""
    made = rot.axis_angle_columns([F.col(c) for c in QUAT])
    return fx.scene_e(spark, sf).df.select("gid", *[_rounded(c).alias(n) for n, c in zip(("ax", "ay", "az"), made)])


def _transform_sql(source: str, keys: str, m, q, size, log=False) -> str:
    scales = [f"{c} + {_n(np.log(s))}" if log else f"{c}*{_n(s)}" for c, s in zip(SCALE, size)]
    inner = [f"{e} AS {c}" for e, c in zip(_affine(np.asarray(m)[:3, :3], POS, np.asarray(m)[:3, 3]), POS)]
    inner += [f"{e} AS {c}" for e, c in zip(_hamilton(q, QUAT), QUAT)] + [f"{e} AS {c}" for e, c in zip(scales, SCALE)]
    return f"SELECT {keys}, {_r((*POS, *QUAT, *SCALE))} FROM (SELECT {keys}, {', '.join(inner)} FROM ({source}))"


_ALL = (*POS, *QUAT, *SCALE)
_SRT = TransformValues((2.0, 0.5, 1.5), tuple(rot.euler_to_quaternion((0.4, -0.7, 1.1)).tolist()), (1.0, 2.0, 3.0), (0.5, -0.5, 0.25))
register("transform_srt", _transform_sql(L, KEYS, _SRT_MATRIX, _SRT_TURN, (2.0, 0.5, 1.5)))(lambda spark, sf: _out(fx.scene_l(spark, sf).transform(_SRT).df, fx.KEYS_L, _ALL))
register("transform_log_scale", _transform_sql(E, "gid", _SRT_MATRIX, _SRT_TURN, (2.0, 0.5, 1.5), True))(lambda spark, sf: _out(fx.scene_e(spark, sf).transform(_SRT).df, ["gid"], _ALL))
register("transform_translate", f"SELECT {KEYS}, round(x+1, 10) AS x, round(y+2, 10) AS y, round(z-3, 10) AS z FROM ({L})")(lambda spark, sf: _out(fx.scene_l(spark, sf).translate((1, 2, -3)).df, fx.KEYS_L, POS))
_STEPS = Transform().scale(2.0, (1, 0, 0)).rotate_axis_angle_deg((0, 1, 1), 40).translate((0.5, 0, -1)).rotate_euler((0.1, 0.2, 0.3), (0, 1, 0)).scale((1.0, 3.0, 0.5))
register("transform_steps", _transform_sql(L, KEYS, _STEPS_MATRIX, _STEPS_TURN, (2.0, 6.0, 1.0)))(lambda spark, sf: _out(_STEPS(fx.scene_l(spark, sf).df), fx.KEYS_L, _ALL))
_SUM = TransformValues.from_rotation_euler(10, 20, 30) + TransformValues.from_scale((1.0, 2.0, 4.0)) + TransformValues.from_translation(1, 1, 1)
register("transform_merged", _transform_sql(L, KEYS, _SUM.to_matrix(), _SUM.rotation, _SUM.scale))(lambda spark, sf: _out(fx.scene_l(spark, sf).transform(_SUM).df, fx.KEYS_L, _ALL))
_M4 = np.array([[0.8, -0.6, 0.0, 1.0], [0.6, 0.8, 0.0, -2.0], [0.0, 0.0, 1.0, 0.5], [0, 0, 0, 1]])
register("transform_matrix", _transform_sql(L, KEYS, _M4, (0.9486832980505138, 0.0, 0.0, 0.31622776601683794), (1, 1, 1)))(lambda spark, sf: _out(fx.scene_l(spark, sf).transform_matrix(_M4).df, fx.KEYS_L, _ALL))


@register("rotation_of_rows", f"""SELECT {KEYS}, {_r(('w', 'ex', 'ey', 'ez', 'm01', 'm22'))} FROM (
  SELECT {KEYS}, qw*qw - qx*qx - qy*qy - qz*qz AS w, atan2(2*(qw*qx+qy*qz), 1-2*(qx*qx+qy*qy)) AS ex, asin(least(greatest(2*(qw*qy-qz*qx), -1), 1)) AS ey,
  atan2(2*(qw*qz+qx*qy), 1-2*(qy*qy+qz*qz)) AS ez, 2*(qx*qy-qw*qz)/n AS m01, (qw*qw-qx*qx-qy*qy+qz*qz)/n AS m22 FROM (SELECT *, qw*qw+qx*qx+qy*qy+qz*qz AS n FROM ({L})))""")
def _rotation_rows(spark, sf):
    df, q = fx.scene_l(spark, sf).df, cols(QUAT)
    m = rot.matrix_columns(q)
    made = [rot.multiply_columns(q, q)[0], *rot.euler_columns(q), m[0][1], m[2][2]]
    return df.select(*fx.KEYS_L, *[_rounded(v).alias(n) for v, n in zip(made, ("w", "ex", "ey", "ez", "m01", "m22"))])


# -------------------------------------------------------------------- colour


def _stages(source: str, keys: str, stages: list[tuple[str, ...]], final=RGB, digits: int = 10) -> str:
    """Nested selects, each replacing r, g, b by three expressions over them."""
    sql = source
    for e in stages:
        sql = f"SELECT * REPLACE ({', '.join(f'{x} AS {c}' for x, c in zip(e, RGB))}) FROM ({sql})"
    return f"SELECT {keys}, {_r(final, digits)} FROM ({sql})"


def _all3(f: Callable[[str], str]) -> tuple[str, ...]:
    return tuple(f(c) for c in RGB)


_SS = lambda a, b: f"(least(greatest(({LUM}-{a})/{b - a},0),1)*least(greatest(({LUM}-{a})/{b - a},0),1)*(3-2*least(greatest(({LUM}-{a})/{b - a},0),1)))"
_SAT = "(greatest(r,g,b)-least(r,g,b))"


def _value_stages(v: ColorValues) -> list[tuple[str, ...]]:
    """RGB stages of a record, in SQL."""
    s: list[tuple[str, ...]] = []
    if v.temperature:
        s.append((f"r*{_n(1 + 0.3 * v.temperature)}", "g", f"b*{_n(1 - 0.3 * v.temperature)}"))
    if v.tint:
        s.append((f"r+{_n(0.05 * v.tint)}", f"g-{_n(0.1 * v.tint)}", f"b+{_n(0.05 * v.tint)}"))
    if v.brightness != 1:
        s.append(_all3(lambda c: f"{c}*{_n(v.brightness)}"))
    if v.contrast != 1:
        s.append(_all3(lambda c: f"({c}-0.5)*{_n(v.contrast)}+0.5"))
    if v.gamma != 1:
        s.append(_all3(lambda c: f"pow(greatest({c}, {_n(1e-7)}), {_n(v.gamma)})"))
    if v.saturation != 1:
        s.append(_all3(lambda c: f"{LUM}+{_n(v.saturation)}*({c}-{LUM})"))
    if v.hue_shift:
        s.append(tuple(_affine(sc.hue_matrix(v.hue_shift), RGB)))
    if v.vibrance != 1:
        s.append(_all3(lambda c: f"least(greatest({LUM}+({c}-{LUM})*((1-{_SAT})*{_n(v.vibrance - 1)}+1),0),1)"))
    if v.shadows or v.highlights:
        s.append(_all3(lambda c: f"{c}*(1+{_n(v.shadows)}*(1-{_SS(0, 0.5)})+{_n(v.highlights)}*{_SS(0.5, 1)})"))
    if v.fade:
        s.append(_all3(lambda c: f"{c}*{_n(1 - v.fade)}+{_n(v.fade)}"))
    if v.shadow_tint_sat or v.highlight_tint_sat:
        a, b = sc.hue_offset(v.shadow_tint_hue), sc.hue_offset(v.highlight_tint_hue)
        s.append(tuple(f"{c}+greatest(0,1-2*{LUM})*{_n(v.shadow_tint_sat * p)}+greatest(0,2*{LUM}-1)*{_n(v.highlight_tint_sat * q)}" for c, p, q in zip(RGB, a, b)))
    s.append(_all3(lambda c: f"least(greatest({c},0),1)"))
    return s


_COLOURS = {
    "color_temperature_tint": ColorValues(temperature=0.4, tint=-0.3), "color_brightness": ColorValues(brightness=1.3), "color_contrast": ColorValues(contrast=1.4), "color_gamma": ColorValues(gamma=0.8),
    "color_saturation": ColorValues(saturation=1.5), "color_hue": ColorValues(hue_shift=40.0), "color_vibrance": ColorValues(vibrance=1.6), "color_shadows_highlights": ColorValues(shadows=0.3, highlights=-0.2),
    "color_fade": ColorValues(fade=0.15), "color_preset_teal_orange": get_color_preset("teal_orange"), "color_merged": get_color_preset("cinematic") + ColorValues(hue_shift=-30.0, gamma=1.1, vibrance=0.8),
}
for _name, _v in _COLOURS.items():
    register(_name, _stages(L, KEYS, _value_stages(_v)))(lambda spark, sf, v=_v: _out(fx.scene_l(spark, sf).color(v).df, fx.KEYS_L, RGB))


# The same from other units; the SQL has the numbers that 5600 K and half a radian stand for.
for _name, _v, _same in (("color_kelvin", ColorValues.from_k(5600.0), ColorValues(temperature=0.2)), ("color_radians", ColorValues.from_rad(0.5), ColorValues(hue_shift=28.64788975654116))):
    register(_name, _stages(L, KEYS, _value_stages(_same)))(lambda spark, sf, v=_v: _out(fx.scene_l(spark, sf).color(v).df, fx.KEYS_L, RGB))


_SH = ColorValues(temperature=0.2, tint=0.1, brightness=1.2, contrast=1.1, saturation=0.8, hue_shift=25.0, fade=0.1)
_BAND0 = [f"shn_0_{c}" for c in RGB]


def _sh_sql() -> str:
    s = [(f"r*{_n(1.06)}", "g", f"b*{_n(0.94)}"), (f"r+{_n(0.005)}", f"g-{_n(0.01)}", f"b+{_n(0.005)}"), _all3(lambda c: f"{c}*1.2+{_n(0.2 * 0.5)}/{_n(sc.C0)}"), _all3(lambda c: f"{c}*1.1")]
    s += [_all3(lambda c: f"{LUM}+0.8*({c}-{LUM})"), tuple(_affine(sc.hue_matrix(25.0), RGB)), _all3(lambda c: f"{c}+{_n(0.1 / sc.C0 * 0.9)}")]
    band = _affine(sc.hue_matrix(25.0).T @ sc.saturation_matrix(0.8) @ (sc.temperature_matrix(0.2) * 1.2 * 1.1), _BAND0)
    inner = ", ".join(f"{e} AS band_{c}" for e, c in zip(band, RGB))
    return _stages(f"SELECT *, {inner} FROM ({E})", "gid", s, (*RGB, *(f"band_{c}" for c in RGB)))


@register("color_harmonics", _sh_sql())
def _color_sh(spark, sf):
    df = fx.scene_e(spark, sf).color(_SH).df
    return df.select("gid", *[_rounded(c).alias(c) for c in RGB], *[_rounded(F.col(BANDS)[0][c]).alias(f"band_{c}") for c in RGB])


_PIPE = Color().temperature(0.3).brightness(1.1).brightness(1.1).contrast(1.2).gamma(0.9).saturation(1.2).vibrance(1.3).hue_shift(30).shadows(0.1).highlights(-0.1).fade(0.05).shadow_tint(-140, 0.2).highlight_tint(30, 0.1)


def _pipe_sql() -> str:
    v, n = _PIPE.folded(), 1023
    off = (0.1 * v.temperature, 0.0, -0.1 * v.temperature)
    s = [tuple(f"pow(least(greatest(((floor({CLIP01(c)}*{n})/{n} + {_n(o)})*{_n(v.brightness)}-0.5)*{_n(v.contrast)}+0.5, {_n(1e-7)}), 1), {_n(v.gamma)})" for c, o in zip(RGB, off))]
    s.append(_all3(lambda c: f"{LUM}+{_n(v.saturation)}*({c}-{LUM})"))
    s.append(_all3(lambda c: f"{c}+({c}-(greatest(r,g,b)+least(r,g,b))*0.5)*(1-{_SAT})*{_n(v.vibrance - 1)}"))
    s.append(tuple(_affine(sc.hue_matrix_about_grey(v.hue_shift), RGB)))
    s.append(_all3(lambda c: f"{c}*(1+CASE WHEN {LUM} < 0.5 THEN {_n(v.shadows)} ELSE {_n(v.highlights)} END)"))
    tail = _value_stages(ColorValues(fade=v.fade, shadow_tint_hue=v.shadow_tint_hue, shadow_tint_sat=v.shadow_tint_sat, highlight_tint_hue=v.highlight_tint_hue, highlight_tint_sat=v.highlight_tint_sat))
    return _stages(L, KEYS, s + tail)


register("color_table_pipeline", _pipe_sql())(lambda spark, sf: _out(_PIPE(fx.scene_l(spark, sf).df), fx.KEYS_L, RGB))


def _step_sql() -> str:
    clip = _all3(lambda c: f"least(greatest({c},0),1)")
    s: list = []
    for v in (ColorValues(temperature=0.05), ColorValues(brightness=1.05), ColorValues(contrast=1.15), ColorValues(gamma=0.92), ColorValues(saturation=0.95), ColorValues(shadows=0.2), ColorValues(fade=0.1)):
        # the steps' gamma starts a little lower
        s += [*(tuple(x.replace(_n(1e-7), _n(1e-8)) for x in e) for e in _value_stages(v)[:-1]), clip]
    return _stages(L, KEYS, s)


register("color_steps", _step_sql())(lambda spark, sf: _out(ColorSteps().fade(0.1).shadows(0.2).preset("cinematic")(fx.scene_l(spark, sf).df), fx.KEYS_L, RGB))


# --------------------------------------------------------- opacity and format

register("opacity_fade", f"SELECT {KEYS}, round(least(greatest(opacity*0.6,0),1), 10) AS opacity FROM ({L})")(lambda spark, sf: _out(fx.scene_l(spark, sf).opacity(OpacityValues.fade(0.6)).df, fx.KEYS_L, [OPACITY]))
register("opacity_boost_logit", f"""SELECT gid, round(ln(p/(1-p)), 5) AS opacity FROM (
  SELECT gid, least(greatest(o+(1-o)*0.25, 1e-7), 1-1e-7) AS p FROM (SELECT gid, 1/(1+exp(-opacity)) AS o FROM ({E})))""")(lambda spark, sf: _out(fx.scene_e(spark, sf).opacity(OpacityValues.boost(1.5)).df, ["gid"], [OPACITY], 5))
register("opacity_multiply", f"SELECT {KEYS}, round(least(opacity*1.5, 1), 10) AS opacity FROM ({L})")(lambda spark, sf: _out(opacity.multiply_opacity(fx.scene_l(spark, sf).df, 1.5), fx.KEYS_L, [OPACITY]))
register("format_to_linear_rgb", f"""SELECT gid, {', '.join(f'round(exp({c}), 10) AS {c}' for c in SCALE)}, round(1/(1+exp(-opacity)), 10) AS opacity,
  {', '.join(f'round(least(greatest({c}*{C0}+0.5,0),1), 10) AS {c}' for c in RGB)} FROM ({E})""")(lambda spark, sf: _out(fx.scene_e(spark, sf).to_linear().to_rgb().df, ["gid"], (*SCALE, OPACITY, *RGB)))
register("format_to_log_sh", f"""SELECT {KEYS}, {', '.join(f'round(ln(greatest({c}, 1e-9)), 10) AS {c}' for c in SCALE)}, round(ln(p/(1-p)), 5) AS opacity, {', '.join(f'round(({c}-0.5)/{C0}, 10) AS {c}' for c in RGB)}
  FROM (SELECT *, least(greatest(opacity, 1e-7), 1-1e-7) AS p FROM ({L}))""")(
    lambda spark, sf: (lambda s: s.df.select(*fx.KEYS_L, *[_rounded(c).alias(c) for c in (*SCALE, *RGB)], F.round(OPACITY, 5).alias(OPACITY)))(fx.scene_l(spark, sf).to_log().to_sh())
)
register("format_pre_activate", f"""SELECT gid, {', '.join(f'round(least(greatest(exp({c}), 1e-4), 100), 10) AS {c}' for c in SCALE)}, round(1/(1+exp(-opacity)), 10) AS opacity,
  {', '.join(f'round({c}/sqrt(qw*qw+qx*qx+qy*qy+qz*qz), 10) AS {c}' for c in QUAT)} FROM ({E})""")(lambda spark, sf: _out(pre_activate(fx.scene_e(spark, sf).df), ["gid"], (*SCALE, OPACITY, *QUAT)))
_CENTERS, _VALUES = (0.1, 0.3, 0.6, 0.9), (1.0, 4.0, 2.0, 8.0)
# at a tie the first center wins, in both
_TABLES_SQL = f"""SELECT {KEYS}, round(CASE WHEN opacity < 0.3 THEN (opacity-0.1)/(0.3-0.1+1e-8)*3+1 WHEN opacity < 0.6 THEN (opacity-0.3)/(0.6-0.3+1e-8)*(-2)+4 ELSE (opacity-0.6)/(0.9-0.6+1e-8)*6+2 END, 5) AS linear,
  CASE WHEN round(opacity-0.2, 12) <= 0 THEN 1.0::DOUBLE WHEN round(opacity-0.45, 12) <= 0 THEN 4.0::DOUBLE WHEN round(opacity-0.75, 12) <= 0 THEN 2.0::DOUBLE ELSE 8.0::DOUBLE END AS nearest FROM ({L})"""


@register("interpolate_tables", _TABLES_SQL)
def _interpolated(spark, sf):
    table = lambda f: f(F.col(OPACITY), _CENTERS, _VALUES)
    return fx.scene_l(spark, sf).df.select(*fx.KEYS_L, F.round(table(sc.linear_interp), 5).alias("linear"), table(sc.nearest).alias("nearest"))


# ---------------------------------------------------------------- aggregates

_BOUNDS = [f"min({c}) AS min_{c}, max({c}) AS max_{c}, max({c})-min({c}) AS size_{c}, (max({c})+min({c}))/2 AS center_{c}" for c in POS]
_BNAMES = [f"{k}_{c}" for c in POS for k in ("min", "max", "size", "center")]
register("stats_bounds", f"SELECT {_r([*_BNAMES, 'max_size'])} FROM (SELECT {', '.join(_BOUNDS)}, greatest({', '.join(f'max({c})-min({c})' for c in POS)}) AS max_size FROM ({L}))")(lambda spark, sf: _out(fx.scene_l(spark, sf).bounds(), [], [*_BNAMES, "max_size"]))
register("stats_centroid", f"SELECT {', '.join(f'round(avg({c}), 10) AS mean_{c}' for c in POS)} FROM ({L})")(lambda spark, sf: _out(fx.scene_l(spark, sf).centroid(), [], [f"mean_{c}" for c in POS]))
register("stats_recommended_max_scale", f"SELECT round(quantile_cont(greatest(sx,sy,sz), 0.995), 10) AS max_scale FROM ({L})")(lambda spark, sf: _out(fx.scene_l(spark, sf).recommended_max_scale(), [], ["max_scale"]))
register("transform_center", f"SELECT {KEYS}, {', '.join(f'round({c} - (SELECT avg({c}) FROM ({L})), 5) AS {c}' for c in POS)} FROM ({L})")(lambda spark, sf: _out(fx.scene_l(spark, sf).center_at_origin().df, fx.KEYS_L, POS, 5))
_FACTOR = f"(SELECT 2.0/greatest({', '.join(f'max({c})-min({c})' for c in POS)}) FROM ({L}))"
register("transform_normalize", f"SELECT {KEYS}, {', '.join(f'round({c}*{_FACTOR}, 10) AS {c}' for c in (*POS, *SCALE))} FROM ({L})")(lambda spark, sf: _out(fx.scene_l(spark, sf).normalize_scale().df, fx.KEYS_L, (*POS, *SCALE)))


def _hist_sql(source: str, values: dict[str, str], n: int, lo: str, hi: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{k}' AS channel, {e} AS v FROM ({source})" for k, e in values.items())
    return f"""WITH rows AS ({rows}), ends AS (SELECT {lo} AS lo, {hi} AS hi FROM rows),
  placed AS (SELECT channel, least(greatest(floor((v-lo)/((hi-lo)/{n})), 0), {n - 1})::BIGINT AS bin, count(*) AS n FROM rows, ends GROUP BY 1, 2),
  frame AS (SELECT * FROM (SELECT DISTINCT channel FROM rows), (SELECT unnest(range({n}))::BIGINT AS bin))
  SELECT channel, bin, round(lo+bin*((hi-lo)/{n}), 10) AS low, round(lo+(bin+1)*((hi-lo)/{n}), 10) AS high, coalesce(n, 0)::BIGINT AS count FROM frame LEFT JOIN placed USING (channel, bin), ends"""


def _hist_out(h: DataFrame) -> DataFrame:
    return h.select("channel", "bin", _rounded("low").alias("low"), _rounded("high").alias("high"), "count")


register("histogram_colors", _hist_sql(L, {c: c for c in RGB}, 64, "min(v)", "max(v)"))(lambda spark, sf: _hist_out(fx.scene_l(spark, sf).histogram_colors(HistogramConfig(64))))
register("histogram_opacity_clamped", _hist_sql(L, {"opacity": "opacity"}, 13, "0.253::DOUBLE", "0.801::DOUBLE").replace("FROM rows),\n  placed", "),\n  placed"))(lambda spark, sf: _hist_out(fx.scene_l(spark, sf).histogram_opacity(HistogramConfig(13, 0.253, 0.801))))
register("histogram_scales", _hist_sql(L, {"scale": "(sx+sy+sz)/3"}, 32, "min(v)", "max(v)"))(lambda spark, sf: _hist_out(fx.scene_l(spark, sf).histogram_scales(HistogramConfig(32))))
register("histogram_positions", _hist_sql(L, {"distance": "sqrt(x*x+y*y+z*z)"}, 256, "min(v)", "max(v)"))(lambda spark, sf: _hist_out(fx.scene_l(spark, sf).histogram_positions()))
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS channel, {c} AS v FROM ({L})" for c in RGB)
register("stats_channels", f"SELECT channel, count(*) AS n, round(avg(v), 10) AS mean, round(stddev_pop(v), 10) AS std, min(v) AS min, max(v) AS max FROM ({_LONG}) GROUP BY 1")(
    lambda spark, sf: stats.statistics(fx.scene_l(spark, sf).df, stats.colour_values()).select("channel", "n", _rounded("mean").alias("mean"), _rounded("std").alias("std"), "min", "max")
)
_H16 = _hist_sql(L, {c: c for c in RGB}, 16, "0.003::DOUBLE", "1.007::DOUBLE").replace("FROM rows),\n  placed", "),\n  placed")


@register("histogram_summary", f"""WITH h AS ({_H16}), t AS (SELECT *, sum(count) OVER (PARTITION BY channel) AS total, sum(count) OVER (PARTITION BY channel ORDER BY bin) AS run FROM h)
  SELECT channel, round(min_by((low+high)/2, bin) FILTER (WHERE run*100 >= total*25), 7) AS p25, round(max_by((low+high)/2, count*100-bin), 7) AS mode,
  round(-sum(count/total*log2(count/total)) FILTER (WHERE count > 0), 7) AS entropy FROM t GROUP BY channel""")
def _hist_summary(spark, sf):
    h = fx.scene_l(spark, sf).histogram_colors(HistogramConfig(16, 0.003, 1.007))
    parts = [(stats.bin_percentile(h, 25), "p25"), (stats.bin_mode(h), "mode"), (stats.entropy(h), "entropy")]
    parts = [d.select("channel", F.round("value", 7).alias(n)) for d, n in parts]
    return parts[0].join(parts[1], "channel").join(parts[2], "channel")


@register("histogram_soft", f"""WITH rows AS ({_LONG}), bins AS (SELECT unnest(range(8)) AS bin), w AS (
  SELECT channel, bin, sum(exp(-((v-(bin+0.5)*0.125)/0.0625)*((v-(bin+0.5)*0.125)/0.0625)/2)) AS s FROM rows, bins GROUP BY 1, 2)
  SELECT channel, bin::INTEGER AS bin, round(s/(sum(s) OVER (PARTITION BY channel)+1e-8), 10) AS weight FROM w""")
def _hist_soft(spark, sf):
    return stats.soft_histogram(fx.scene_l(spark, sf).df, stats.colour_values(), 8).select("channel", "bin", _rounded("weight").alias("weight"))


@register("histogram_soft_fine", f"""WITH rows AS (SELECT channel, v, count(*) AS n FROM ({_LONG}) GROUP BY 1, 2), bins AS (SELECT unnest(range(256)) AS bin), w AS (
  SELECT channel, bin, sum(n*exp(-((v-(bin+0.5)/256)*512)*((v-(bin+0.5)/256)*512)/2)) AS s FROM rows, bins GROUP BY 1, 2)
  SELECT channel, bin::INTEGER AS bin, round(s/(sum(s) OVER (PARTITION BY channel)+1e-8), 10) AS weight FROM w""")
def _hist_soft_fine(spark, sf):
    return stats.soft_histogram(fx.scene_l(spark, sf).df, stats.colour_values(), 256).select("channel", "bin", _rounded("weight").alias("weight"))


_AUTO = f"""WITH l AS (SELECT *, {LUM} AS lum FROM ({L})), q AS (SELECT quantile_cont(lum, 0.001) AS a, quantile_cont(lum, 0.999) AS b, quantile_cont(lum, 0.01) AS c, quantile_cont(lum, 0.99) AS d FROM l),
  t AS (SELECT avg(lum) AS m, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM l WHERE lum BETWEEN (SELECT c FROM q) AND (SELECT d FROM q)),
  k AS (SELECT least(greatest((mr+mg+mb)/3/(mr+1e-8), 0.5), 2) AS kr, least(greatest((mr+mg+mb)/3/(mg+1e-8), 0.5), 2) AS kg, least(greatest((mr+mg+mb)/3/(mb+1e-8), 0.5), 2) AS kb FROM t)
  SELECT round(least(greatest(0.95/(b-a), 0.5), 3), 5) AS contrast, round(least(greatest(0.45/m, 0.5), 2.5), 5) AS brightness,
  round(least(greatest((kr/(kb+1e-8)-1)/2, -1), 1), 5) AS temperature, round(least(greatest((1-kg/((kr+kb)/2+1e-8))/2, -1), 1), 5) AS tint FROM q, t, k"""


@register("auto_corrections", _AUTO)
def _auto(spark, sf):
    row = stats.corrections(fx.scene_l(spark, sf).df)
    return row.select(*[F.round(n, 5).alias(n) for n in ("contrast", "brightness", "temperature", "tint")])


# ---------------------------------------------------------------- fitting

# An ellipsoid that the weights of all rows come from, and what the fit finds from another one.
_ELLIPSOID = "1/(1+exp(-(1-sqrt(power((x-0.5)/3, 2)+power((y+0.25)/2.5, 2)+power((z-1)/4, 2)))*10))"


@register("fit_ellipsoid", f"SELECT CAST(count(*) AS BIGINT) AS n, 0.5 AS cx, -0.25 AS cy, 1.0 AS cz, 3.0 AS rx, 2.5 AS ry, 4.0 AS rz, round(sum(power({_ELLIPSOID}-1/(1+exp(-(1-sqrt(power(x/2, 2)+power(y/2, 2)+power(z/2, 2)))*10)), 2)), 3) AS loss_before FROM ({L})".replace("0.5 AS cx, -0.25 AS cy, 1.0 AS cz, 3.0 AS rx, 2.5 AS ry, 4.0 AS rz", ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in (("cx", 0.5), ("cy", -0.25), ("cz", 1), ("rx", 3), ("ry", 2.5), ("rz", 4)))))
def _fit_ellipsoid(spark, sf):
    """A soft ellipsoid fitted to the weights of another one over all rows."""
    rows = fx.scene_l(spark, sf).df.select(*POS, F.expr(_ELLIPSOID).alias("wanted"))
    start = learn.SoftShape(shape="ellipsoid", radii=(2.0, 2.0, 2.0))
    found, _ = learn.fit_shape(rows, F.col("wanted"), start)
    d = start.weight() - F.col("wanted")
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.lit(round(v, 6) + 0.0).alias(k) for k, v in zip(("cx", "cy", "cz", "rx", "ry", "rz"), (*found.center, *found.radii))], F.round(_sum_of_many(d * d), 3).alias("loss_before"))


@register("fit_chain", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(1.2 AS DOUBLE) AS brightness, CAST(0.8 AS DOUBLE) AS opacity, CAST(2 AS DOUBLE) AS tx, CAST(-1 AS DOUBLE) AS ty, CAST(0.5 AS DOUBLE) AS tz, round(sum(opacity*0.8), 4) AS total FROM ({L})")
def _fit_chain(spark, sf):
    """Colour, opacity and translation found together, from results beside the rows."""
    rows = fx.scene_l(spark, sf).df.select(*POS, OPACITY, *RGB, *QUAT, *SCALE)
    rows = rows.withColumns({**{f"to_{c}": F.col(c) + d for c, d in zip(POS, (2.0, -1.0, 0.5))}, f"to_{OPACITY}": F.col(OPACITY) * 0.8, **{f"to_{c}": F.least(F.col(c) * 1.2, F.lit(1.0)) for c in RGB}})
    (colour_, opacity_, move), _ = learn.fit_chain(rows, {c: f"to_{c}" for c in (*POS, OPACITY, *RGB)}, ColorValues(), OpacityValues(0.9), TransformValues(), {"color": ("brightness",), "opacity": ("scale",), "transform": ("translation",)})
    found = {"brightness": colour_.brightness, "opacity": opacity_.scale, **dict(zip(("tx", "ty", "tz"), move.translation))}
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.lit(round(v, 6) + 0.0).alias(k) for k, v in found.items()], F.round(_sum_of_many(F.col(f"to_{OPACITY}")), 4).alias("total"))


# -------------------------------------------------------------------- files

_FILED = (*POS, *SCALE, *QUAT, OPACITY, *RGB)
_AS_FLOAT = lambda c: f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"


@register("ply_round_trip", f"""SELECT CAST(row_number() OVER (ORDER BY gid)-1 AS BIGINT) AS place, {', '.join(f'round({_AS_FLOAT(c)}, 10) AS {c}' for c in _FILED)},
  {', '.join(f'round({_AS_FLOAT(f"shn_1_{c}")}, 10) AS band_{c}' for c in RGB)} FROM ({E})""")
def _ply(spark, sf):
    """Written as one PLY file's pieces, put into files of a shared folder, and read in ranges."""
    scene = fx.scene_e(spark, sf)
    folder = scratch_path(spark)
    n = Window.orderBy("file")  # a row for each file
    before = ply.export_ply(scene, folder).select(F.regexp_extract("file", "[^/]+$", 0).alias("name"), (F.sum("n").over(n) - F.col("n")).alias("before"))
    back = ply.read_ply(spark, folder, scene.format, split_bytes=20_000).df.withColumn("name", F.regexp_extract("file", "[^/]+$", 0)).join(before, "name")
    return back.select((F.col("gid") + F.col("before")).alias("place"), *[_rounded(F.col(c).cast("double")).alias(c) for c in _FILED], *[_rounded(F.col(BANDS)[1][c].cast("double")).alias(f"band_{c}") for c in RGB])


@register("ply_one_file", f"""SELECT CAST(row_number() OVER (ORDER BY gid)-1 AS BIGINT) AS gid, {', '.join(f'round({_AS_FLOAT(c)}, 10) AS {c}' for c in (*POS, OPACITY))} FROM ({E})""")
def _ply_one(spark, sf):
    """One file, put together by tasks, and four of its columns read by the data source."""
    ply_source.register(spark)
    file = f"{scratch_path(spark)}/scene.ply"
    ply_source.write_one_file(fx.scene_e(spark, sf), file)
    back = spark.read.format("ply").schema("gid bigint, " + ", ".join(f"{c} float" for c in (*POS, OPACITY))).option("rangeRows", 100).load(file)
    return back.select("gid", *[_rounded(F.col(c).cast("double")).alias(c) for c in (*POS, OPACITY)])


@register("ply_parts", f"""SELECT CAST(count(*) AS BIGINT) AS n, {', '.join(f'round(sum({_AS_FLOAT(c)}), 4) AS {c}' for c in _FILED)} FROM ({L})""")
def _ply_parts(spark, sf):
    """A folder of files that the data source's tasks write, and all of it read again."""
    ply_source.register(spark)
    folder = scratch_path(spark)
    fx.scene_l(spark, sf).df.select(*_FILED).repartition(5).write.format("ply").mode("append").save(folder)
    return spark.read.format("ply").load(folder).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(F.col(c).cast("double")), 4).alias(c) for c in _FILED])


# ------------------------------------------------------- scenes and pipelines

_FLIP = TransformValues.from_rotation_euler(0, 0, 90)


@register("compose_scenes", f"""SELECT 0 AS scene_id, {KEYS}, {_r(POS)} FROM ({L}) UNION ALL
  SELECT 1, {KEYS}, round(-y, 10), round(x, 10), round(z, 10) FROM ({L}) WHERE opacity >= 0.9""")
def _compose(spark, sf):
    a = fx.scene_l(spark, sf)
    b = Scene(a.df.filter("opacity >= 0.9"), a.format)
    df, _ = compose.compose_with_transforms([(a.df, a.format), (b.df, b.format)], [None, _FLIP])
    return _out(df, ["scene_id", *fx.KEYS_L], POS)


@register("deduplicate_last", f"""WITH p AS ({P}) SELECT gid, {_r(POS)} FROM p a WHERE NOT EXISTS (
  SELECT 1 FROM p b WHERE b.gid > a.gid AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 0.05*0.05)""")
def _dedup_last(spark, sf):
    return _out(compose.deduplicate(fx.points_p(spark, sf), 0.05, "last"), ["gid"], POS)


@register("deduplicate_first", f"""WITH RECURSIVE p AS ({P}), e AS (SELECT a.gid AS a, b.gid AS b FROM p a JOIN p b ON a.gid < b.gid AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 0.05*0.05),
  run AS (SELECT (SELECT min(gid) FROM p) AS cur, CAST([] AS BIGINT[]) AS lost UNION ALL
    SELECT (SELECT min(gid) FROM p WHERE gid > run.cur), CASE WHEN list_contains(lost, run.cur) THEN lost ELSE list_concat(lost, coalesce((SELECT list(b) FROM e WHERE a = run.cur), [])) END FROM run WHERE run.cur IS NOT NULL)
  SELECT gid, {_r(POS)} FROM p WHERE NOT list_contains((SELECT lost FROM run WHERE cur IS NULL), gid)""")
def _dedup_first(spark, sf):
    return _out(compose.deduplicate(fx.points_p(spark, sf), 0.05, "first"), ["gid"], POS)


_GRADE = Pipeline().min_opacity(0.2).within_sphere(5.5).translate((1, 0, 0)).rotate_euler((0, 0, 90)).scale(2.0).brightness(1.2).contrast(1.1).saturation(1.3)


def _grade_sql() -> str:
    # moved by 1 along x, turned by 90 degrees about z, twice as large
    inner = f"SELECT * REPLACE (-2*y AS x, 2*(x+1) AS y, 2*z AS z) FROM ({L}) WHERE {_ALWAYS} AND opacity >= 0.2 AND {_SPHERE(5.5)}"
    return _stages(inner, KEYS, _value_stages(ColorValues(brightness=1.2, contrast=1.1, saturation=1.3)), (*POS, *RGB))


register(FLAGSHIP, _grade_sql())(lambda spark, sf: _out(_GRADE(fx.scene_l(spark, sf)).df, fx.KEYS_L, (*POS, *RGB)))
_GROUPED = GroupedPipeline().brightness(1.2).within_sphere((0.0, 0.0, 0.0), 4.0).translate((1.0, 0.0, 0.0)).min_opacity(0.5).scale(2.0)
register("pipeline_grouped", _stages(f"SELECT * REPLACE (2*(x+1) AS x, 2*y AS y, 2*z AS z) FROM ({L}) WHERE {_SPHERE(4.0)} AND opacity >= 0.5", KEYS, [_all3(lambda c: f"least({c}*1.2, 1)")], (*POS, *RGB)))(
    lambda spark, sf: _out(_GROUPED(fx.scene_l(spark, sf)).df, fx.KEYS_L, (*POS, *RGB))
)


@register("process_all", _stages(f"SELECT * REPLACE (x+1 AS x, opacity*0.5 AS opacity) FROM ({L}) WHERE {_ALWAYS} AND opacity >= 0.4", KEYS, _value_stages(ColorValues(gamma=1.2)), ("x", "opacity", *RGB)))
def _process(spark, sf):
    s = process(fx.scene_l(spark, sf), ColorValues(gamma=1.2), TransformValues.from_translation(1, 0, 0), FilterValues(min_opacity=0.4), OpacityValues(0.5))
    return _out(s.df, fx.KEYS_L, ("x", "opacity", *RGB))

