"""Fitting parameters to a target by aggregates.

Rows stay where they are. Colours, opacities and what filters look at are counted
once on a grid of cells, whose number does not depend on the number of rows; a
transform needs sums of products alone. Every step of the optimiser then works on
those numbers. The cells are means of the rows in them, so for a grid fine enough
the moments are those of the rows. Where a grid can't hold the parameters, as for
shapes and whole chains, each step takes sums of products of derivatives over all rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rotation as rot
from ..functions import scalar as sc
from ..plans.values import ColorValues, FilterValues, OpacityValues, TransformValues, specs
from ..scene_format import OPACITY, POS, QUAT, RGB, SCALE, SceneFormat, cols
from .filters import largest_scale, soft_weight
from .transform import rotation_from_6d

GRID = 24


@dataclass(frozen=True)
class Target:
    """What the colours should look like: mean and std (of a sample) by channel."""

    mean: tuple[float, float, float]
    std: tuple[float, float, float]


def moments(df: DataFrame) -> Target:
    row = df.agg(*[f(c).alias(f"{n}{c}") for c in RGB for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return Target(tuple(row[f"m{c}"] or 0.0 for c in RGB), tuple(row[f"s{c}"] or 0.0 for c in RGB))


def colour_cells(df: DataFrame, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """(mean colour, rows) of each cell that has rows: at most grid^3 of them."""
    at = [F.least(F.floor(sc.clip(c, 0, 1) * grid), F.lit(grid - 1)).alias(f"at_{n}") for n, c in zip(RGB, cols(RGB))]
    rows = df.select(*RGB, *at).groupBy(*(f"at_{n}" for n in RGB)).agg(*[F.avg(n).alias(n) for n in RGB], F.count(F.lit(1)).alias("n")).collect()
    return np.array([[r[n] for n in RGB] for r in rows]).reshape(-1, 3), np.array([r["n"] for r in rows], float)


def grade(x: np.ndarray, v: ColorValues) -> np.ndarray:
    """`operators.colour.apply_color` for RGB, on an array of a few colours."""
    lum = lambda y: (y @ np.array(sc.LUMA))[:, None]
    step = lambda a, b, y: (lambda t: t * t * (3 - 2 * t))(np.clip((y - a) / (b - a), 0, 1))
    x = x @ sc.temperature_matrix(v.temperature).T + v.tint * np.array([0.05, -0.1, 0.05])
    x = np.maximum((x * v.brightness - 0.5) * v.contrast + 0.5, sc.EPS if v.gamma != 1 else -np.inf) ** v.gamma
    x = x @ sc.saturation_matrix(v.saturation).T
    if v.hue_shift:
        x = x @ sc.hue_matrix(v.hue_shift).T
    if v.vibrance != 1:
        more = (1 - (x.max(1) - x.min(1)))[:, None] * (v.vibrance - 1) + 1
        x = np.clip(lum(x) + (x - lum(x)) * more, 0, 1)
    x = x * (1 + v.shadows * (1 - step(0, 0.5, lum(x))) + v.highlights * step(0.5, 1, lum(x)))
    x = x * (1 - v.fade) + v.fade
    at = lum(x)
    for hue, sat, mask in ((v.shadow_tint_hue, v.shadow_tint_sat, 1 - 2 * at), (v.highlight_tint_hue, v.highlight_tint_sat, 2 * at - 1)):
        x = x + np.maximum(mask, 0) * sat * np.array(sc.hue_offset(hue))
    return np.clip(x, 0, 1)


def weighted_moments(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, std of a sample, and skewness by channel."""
    total = n.sum()
    mean = n @ x / total
    var = n @ (x - mean) ** 2 / max(total - 1, 1)
    std = np.sqrt(var)
    return mean, std, n @ (x - mean) ** 3 / total / np.maximum(std, 1e-8) ** 3


def moment_loss(x: np.ndarray, n: np.ndarray, target: Target) -> float:
    mean, std, _ = weighted_moments(x, n)
    return float(np.mean((mean - target.mean) ** 2 + (std - target.std) ** 2))


def contrast_loss(x: np.ndarray, before: np.ndarray, n: np.ndarray, least: float = 0.8) -> float:
    """Std that falls below a share of what it was, squared."""
    return float(np.mean(np.maximum(least * weighted_moments(before, n)[1] - weighted_moments(x, n)[1], 0) ** 2))


def range_loss(x: np.ndarray, n: np.ndarray, target: Target) -> float:
    """Distance of the 5th and 95th percentiles from mean -+ 2 std, squared."""
    out = 0.0
    for k in range(3):
        order = np.argsort(x[:, k])
        run = np.cumsum(n[order])
        low, high = (x[order[np.searchsorted(run, p * run[-1], side="right").clip(0, len(order) - 1)], k] for p in (0.05, 0.95))
        out += (low - np.clip(target.mean[k] - 2 * target.std[k], 0, 1)) ** 2 + (high - np.clip(target.mean[k] + 2 * target.std[k], 0, 1)) ** 2
    return out / 3


def neutrality_loss(v: ColorValues, params: tuple[str, ...]) -> float:
    return sum((getattr(v, p) - specs(v)[p].neutral) ** 2 for p in params)


def bounds_loss(v: ColorValues, params: tuple[str, ...]) -> float:
    """How far parameters are out of their ranges, squared."""
    return sum((getattr(v, p) - specs(v)[p].validate(getattr(v, p))) ** 2 for p in params)


def fit_color(
    df: DataFrame, target: Target, params: tuple[str, ...] = ("brightness", "contrast", "gamma", "saturation", "temperature"), start: ColorValues = ColorValues(),
    epochs: int = 100, rate: float = 0.02, contrast_weight: float = 0.0, range_weight: float = 0.0, regularization: float = 0.0, grid: int = GRID,
) -> tuple[ColorValues, float]:
    """(best values, their loss). One aggregation; then Adam on its cells, with
    gradients by central differences. Parameters stay in their ranges."""
    colours, n = colour_cells(df, grid)
    if not len(n):
        return start, 0.0

    def loss(p: np.ndarray) -> float:
        v = replace(start, **dict(zip(params, p.tolist())))
        x = grade(colours, v)
        out = moment_loss(x, n, target)
        if contrast_weight:
            out += contrast_weight * contrast_loss(x, colours, n)
        if range_weight:
            out += range_weight * range_loss(x, n, target)
        return out + regularization * neutrality_loss(v, params)

    kinds = [specs(start)[p] for p in params]
    best, least = _descend(loss, [getattr(start, k) for k in params], epochs, rate, lambda p: np.array([k.validate(x) for k, x in zip(kinds, p)]))
    return replace(start, **dict(zip(params, best.tolist()))), least


def _descend(loss: Callable[[np.ndarray], float], start, epochs: int, rate: float, within: Callable[[np.ndarray], np.ndarray] = lambda p: p) -> tuple[np.ndarray, float]:
    """(best parameters, their loss): Adam with gradients by central differences, its
    rate falling to a tenth."""
    p = np.array(start, float)
    best, least = p, loss(p)
    m, s = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, epochs + 1):
        grad = np.array([(loss(p + e) - loss(p - e)) / 2e-4 for e in np.eye(len(p)) * 1e-4])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        p = within(p - rate * 0.1 ** (t / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8))
        now = loss(p)
        if now < least:
            best, least = p, now
    return best, least


# ------------------------------------------------- transforms, opacity, filters


def position_moments(df: DataFrame, target: tuple[str, str, str]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(rows, sum x, sum y, sum x x', sum y x', sum y y) of positions x and the
    targets y beside them: all that a squared distance needs, from one aggregate."""
    x, y = cols(POS), cols(target)
    sums = {f"x{i}": x[i] for i in range(3)} | {f"y{i}": y[i] for i in range(3)}
    sums |= {f"xx{i}{j}": x[i] * x[j] for i in range(3) for j in range(3)} | {f"yx{i}{j}": y[i] * x[j] for i in range(3) for j in range(3)}
    row = df.dropna(subset=[*POS, *target]).agg(F.count(F.lit(1)).alias("n"), F.sum(sum((c * c for c in y[1:]), y[0] * y[0])).alias("yy"), *[F.sum(c).alias(k) for k, c in sums.items()]).first()
    take = lambda k, *shape: np.array([row[f"{k}{''.join(map(str, i))}"] or 0.0 for i in np.ndindex(*shape)]).reshape(shape)
    return float(row["n"]), take("x", 3), take("y", 3), take("xx", 3, 3), take("yx", 3, 3), row["yy"] or 0.0


def fit_transform(df: DataFrame, target: tuple[str, str, str], params: tuple[str, ...] = ("scale", "rotation", "translation"), start: TransformValues = TransformValues(), epochs: int = 600, rate: float = 0.1) -> tuple[TransformValues, float]:
    """(values, mean squared distance) of the transform that moves positions to the
    targets in three other columns. Rotations are free in six numbers, from which an
    orthogonal matrix follows by Gram-Schmidt. What is not in `params` stays."""
    n, sx, sy, xx, yx, yy = position_moments(df, target)
    if not n:
        return start, 0.0
    center = np.zeros(3) if start.center is None else np.asarray(start.center, float)
    turn = rot.quaternion_to_rotation_matrix(start.rotation)
    parts = {"scale": start.scale_vector.astype(float), "rotation": turn[:, :2].T.reshape(6), "translation": np.asarray(start.translation, float)}
    sizes = {k: len(parts[k]) for k in params}

    def unpack(p: np.ndarray) -> dict[str, np.ndarray]:
        at = np.cumsum([0, *sizes.values()])
        return parts | {k: p[a:b] for k, a, b in zip(sizes, at, at[1:])}

    def loss(p: np.ndarray) -> float:
        v = unpack(p)
        m = rotation_from_6d(v["rotation"]) * v["scale"]
        t = v["translation"] + center - m @ center
        return float((np.sum((m @ xx) * m) + n * t @ t + yy + 2 * t @ (m @ sx) - 2 * np.sum(m * yx) - 2 * t @ sy) / n)

    best, least = _descend(loss, np.concatenate([parts[k] for k in params]), epochs, rate)
    v = unpack(best)
    turned = rot.rotation_matrix_to_quaternion(rotation_from_6d(v["rotation"])) if "rotation" in params else start.rotation
    return TransformValues(tuple(v["scale"].tolist()), tuple(np.asarray(turned).tolist()), tuple(v["translation"].tolist()), start.center), max(least, 0.0)


def fit_opacity(df: DataFrame, mean: float, fmt: SceneFormat = SceneFormat(), start: OpacityValues = OpacityValues(), epochs: int = 200, rate: float = 0.05, grid: int = 1024) -> tuple[OpacityValues, float]:
    """(values, squared difference of means): the scale that brings the mean of
    (linear) opacities to a target."""
    o = sc.sigmoid(F.col(OPACITY)) if fmt.logit_opacity else F.col(OPACITY)
    cells = df.select(o.alias("o")).filter("o is not null and not isnan(o)").groupBy(F.least(F.floor(F.col("o") * grid), F.lit(grid - 1)).alias("at")).agg(F.avg("o").alias("o"), F.count(F.lit(1)).alias("n")).collect()
    if not cells:
        return start, 0.0
    o, n = np.array([r["o"] for r in cells]), np.array([r["n"] for r in cells], float)

    def loss(p: np.ndarray) -> float:
        # the same as `operators.opacity.scaled`
        now = np.clip(o * p[0] if p[0] <= 1 else o + (1 - o) * ((p[0] - 1) * 0.5), 0, 1)
        return float((n @ now / n.sum() - mean) ** 2)

    best, least = _descend(loss, [start.scale], epochs, rate, lambda p: np.array([specs(start)["scale"].validate(p[0])]))
    return OpacityValues(float(best[0])), least


def fit_filter(df: DataFrame, wanted: Column, params: tuple[str, ...] = ("min_opacity", "max_scale", "sphere_radius"), start: FilterValues = FilterValues(min_opacity=0.1, max_scale=1.0, sphere_radius=1.0), sharpness: tuple[float, float, float] = (10.0, 10.0, 10.0), epochs: int = 300, rate: float = 0.05, grid: int = 16) -> tuple[FilterValues, float]:
    """(values, mean squared difference): thresholds whose soft weight (see
    `operators.filters.soft_weight`) comes near a wanted weight from 0 to 1.

    Opacity, largest scale and distance from the sphere's center are counted on a
    grid between their 0.1 and 99.9 percentiles: grid^3 cells at most.
    """
    center = [F.lit(float(c)) for c in start.sphere_center]
    p = cols(POS)
    d = [(a - c) * (a - c) for a, c in zip(p, center)]
    names = ("o", "s", "d")
    rows = df.select(F.col(OPACITY).alias("o"), largest_scale().alias("s"), F.sqrt(d[0] + d[1] + d[2]).alias("d"), wanted.cast("double").alias("w")).dropna()
    # a sketch of fixed size gives the ends, so that a few far values don't put all others into one cell
    ends = rows.agg(*[F.percentile_approx(c, F.lit(share), F.lit(10_000)).alias(f"{k}_{c}") for c in names for k, share in (("lo", 0.001), ("hi", 0.999))])
    at = [F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), sc.clip(F.floor((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * grid), 0, grid - 1)).otherwise(0).alias(f"at_{c}") for c in names]
    counted = rows.crossJoin(F.broadcast(ends)).groupBy(*at).agg(*[F.avg(c).alias(c) for c in names], F.avg("w").alias("w"), F.count(F.lit(1)).alias("n")).collect()
    if not counted:
        return start, 0.0
    x = {k: np.array([r[k] for r in counted], float) for k in (*names, "w", "n")}
    soft = lambda v: 1 / (1 + np.exp(-np.clip(v, -60, 60)))

    def loss(q: np.ndarray) -> float:
        v = {k: getattr(start, k) for k in ("min_opacity", "max_scale", "sphere_radius")} | dict(zip(params, q.tolist()))
        w = soft((x["o"] - v["min_opacity"]) * sharpness[0]) if v["min_opacity"] > 0 else 1.0
        w = w * (soft((v["max_scale"] - x["s"]) * sharpness[1]) if v["max_scale"] < 100 else 1.0)
        w = w * (soft((v["sphere_radius"] - x["d"]) * sharpness[2]) if np.isfinite(v["sphere_radius"]) else 1.0)
        return float(x["n"] @ (w - x["w"]) ** 2 / x["n"].sum())

    best, least = _descend(loss, [getattr(start, k) for k in params], epochs, rate, lambda q: np.maximum(q, 1e-6))
    return replace(start, **dict(zip(params, best.tolist()))), least


# ------------------------------------------- least squares over rows of any scene

#: Rows and their residuals at given parameters; then, if it is known, by parameter how each residual
#: that it moves, named by its place, changes with it. Else central differences are taken.
Slopes = dict[str, dict[int, Column]]
Residuals = Callable[[DataFrame, dict[str, float]], tuple[DataFrame, list[Column]] | tuple[DataFrame, list[Column], Slopes]]


def differences(df: DataFrame, residuals: Callable[[DataFrame, dict[str, float]], tuple[DataFrame, list[Column]]], at: dict[str, float], names: list[str], h: float = 1e-5, mark: str = "r") -> tuple[DataFrame, list[Column], Slopes]:
    """Residuals and their central differences by the named parameters, as columns that begin with mark."""
    variants: list[list[str]] = []
    for k, values in enumerate([at, *({**at, n: at[n] + d} for n in names for d in (h, -h))]):
        df, columns = residuals(df, values)
        variants.append([f"{mark}{k}_{i}" for i in range(len(columns))])
        df = df.withColumns(dict(zip(variants[-1], columns)))
    return df, [F.col(c) for c in variants[0]], {n: {i: (F.col(a) - F.col(b)) / (2 * h) for i, (a, b) in enumerate(zip(more, less))} for n, more, less in zip(names, variants[1::2], variants[2::2])}


def normal_equations(df: DataFrame, residuals: Residuals, at: dict[str, float], h: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(J'J, J'r, r'r, rows) of residuals at given parameters, from one aggregate: the derivatives are
    columns beside the residuals. Rows in which any of them is null or NaN are left out.

    These are marked and not filtered: a filter goes below the projections, where each residual and
    derivative is computed again for it, in a method too long for the JVM to compile.
    """
    names, found = list(at), residuals(df, at)
    made, base, slopes = found if len(found) == 3 else differences(df, residuals, at, names, h)
    parts = {"r": dict(enumerate(base))} | {f"j{k}": slopes.get(n, {}) for k, n in enumerate(names)}
    rows = made.select(*[c.alias(f"{v}_{i}") for v, own in parts.items() for i, c in own.items()])
    rows = rows.withColumn("sound", functools.reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) for c in rows.columns]))

    def both(a: str, b: str) -> Column | None:
        terms = [F.col(f"{a}_{i}") * F.col(f"{b}_{i}") for i in parts[a] if i in parts[b]]
        return F.sum(F.when(F.col("sound"), sum(terms[1:], terms[0]))).alias(f"{a}{b}") if terms else None

    pairs = [(a, b) for k, a in enumerate(parts) for b in list(parts)[: k + 1]]
    row = rows.agg(F.count_if("sound").alias("n"), *[c for a, b in pairs if (c := both(a, b)) is not None]).first().asDict()
    g = np.array([row.get(f"j{a}r") or 0.0 for a in range(len(names))])
    jj = np.array([[row.get(f"j{max(a, b)}j{min(a, b)}") or 0.0 for b in range(len(names))] for a in range(len(names))])
    return jj.reshape(len(names), len(names)), g, row["rr"] or 0.0, row["n"]


def least_squares(df: DataFrame, residuals: Residuals, start: dict[str, float], within: dict[str, tuple[float, float]] | None = None, steps: int = 25) -> tuple[dict[str, float], float]:
    """(parameters, mean square of the residuals) by Levenberg and Marquardt's method. A step is one
    pass over the rows, and what comes back is a few sums, however many rows there are."""
    within, p, damp = within or {}, dict(start), 1e-3
    jj, g, rr, n = normal_equations(df, residuals, p)
    for _ in range(steps):
        if not n or rr <= 1e-18 * n:
            break
        move = np.linalg.lstsq(jj + damp * (np.diag(np.diag(jj)) + 1e-12 * np.eye(len(p))), -g, rcond=None)[0]
        new = {k: float(np.clip(v + m, *within.get(k, (-np.inf, np.inf)))) for (k, v), m in zip(p.items(), move)}
        jj2, g2, rr2, _ = normal_equations(df, residuals, new)
        if rr2 < rr:
            done = rr - rr2 <= 1e-12 * rr
            p, jj, g, rr, damp = new, jj2, g2, rr2, max(damp / 9, 1e-12)
            if done:
                break
        else:
            damp *= 11
            if damp > 1e10:
                break
    return p, rr / max(n, 1)


@dataclass(frozen=True)
class SoftShape:
    """What `operators.filters.soft_weight` takes: thresholds, and one soft shape."""

    opacity: float = 0.0
    scale: float = 100.0
    shape: str = "sphere"
    center: tuple[float, float, float] = (0.0, 0.0, 0.0)
    radius: float = 1.0
    radii: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rotation: tuple[float, float, float] = (0.0, 0.0, 0.0)  # axis times angle
    opacity_sharpness: float = 10.0
    scale_sharpness: float = 10.0
    sharpness: float = 10.0

    def weight(self) -> Column:
        return soft_weight(**vars(self))

    def slopes(self, df: DataFrame) -> tuple[DataFrame, Column, dict[str, Column]]:
        """(rows, the weight, its derivatives by each number of the fields) of a product of sigmoids: by what
        stands in one of them, it is the product times what the sigmoid lacks to 1. Each step is a
        projection of its own, so that no root and no exponential is taken twice."""
        p, r = cols(POS), self.radii if self.shape in ("ellipsoid", "box") else (1.0, 1.0, 1.0)
        away, local, pull = ([f"shape_{k}{i}" for i in range(3)] for k in ("away", "local", "pull"))
        # far away a slope is 0, and is so at an infinite distance as well
        times = lambda slope, c: F.when(slope != 0, slope * c).otherwise(slope)
        turn = lambda v: rot.axis_angle_to_rotation_matrix(v).T / np.array(r, float)[:, None]
        df = df.withColumns(dict(zip(away, (c - float(m) for c, m in zip(p, self.center)))))
        df = df.withColumns(dict(zip(local, rot.linear(turn(self.rotation), cols(away)))))
        q, shaped = cols(local), self.shape in ("ellipsoid", "box") or self.shape == "sphere" and self.radius < np.inf
        df = df.withColumn("shape_far", F.greatest(*map(F.abs, q)) if self.shape == "box" else F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2]))
        # what stands in each sigmoid, before its sharpness, and the sharpness
        inside = {"opacity": (F.col(OPACITY) - self.opacity, "opacity_sharpness")} if self.opacity > 0 else {}
        inside |= {"scale": (self.scale - largest_scale(), "scale_sharpness")} if self.scale < 100 else {}
        inside |= {"far": ((self.radius if self.shape == "sphere" else 1) - F.col("shape_far"), "sharpness")} if shaped else {}
        df = df.withColumns({f"shape_in_{k}": c for k, (c, _) in inside.items()})
        df = df.withColumns({f"shape_soft_{k}": sc.sigmoid(F.col(f"shape_in_{k}") * getattr(self, s)) for k, (_, s) in inside.items()})
        df = df.withColumn("shape_weight", functools.reduce(Column.__mul__, [F.col(f"shape_soft_{k}") for k in inside], F.lit(1.0)))
        df = df.withColumns({f"shape_by_{k}": F.col("shape_weight") * (1 - F.col(f"shape_soft_{k}")) for k in inside})
        out = {s: times(F.col(f"shape_by_{k}"), F.col(f"shape_in_{k}")) for k, (_, s) in inside.items()}
        out |= {k: F.col(f"shape_by_{k}") * (sign * getattr(self, inside[k][1])) for k, sign in (("opacity", -1.0), ("scale", 1.0)) if k in inside}
        if not shaped:
            return df, F.col("shape_weight"), out
        # the weight's derivative by each local coordinate, less its sign; at the center there is none
        by, far = F.col("shape_by_far") * self.sharpness, F.col("shape_far")
        if self.shape == "box":
            df = df.withColumns({k: F.when(F.abs(c) == far, F.signum(c) * by).otherwise(0.0) for k, c in zip(pull, q)})
        else:
            df = df.withColumn("shape_pull", F.when(far != 0, by / far).otherwise(by * 0)).withColumns({k: times(F.col("shape_pull"), c) for k, c in zip(pull, q)})
        u, dot = cols(pull), lambda m: rot.linear(np.reshape(m, (1, 3)), cols(pull))[0]
        out |= {f"center.{k}": dot(turn(self.rotation)[:, k]) for k in range(3)}
        for k, e in enumerate(np.eye(3) * 1e-6):
            turned = rot.linear((turn(np.add(self.rotation, e)) - turn(np.subtract(self.rotation, e))) / -2e-6, cols(away))
            out[f"rotation.{k}"] = times(u[0], turned[0]) + times(u[1], turned[1]) + times(u[2], turned[2])
        return df, F.col("shape_weight"), out | ({"radius": by} if self.shape == "sphere" else {f"radii.{k}": times(u[k], q[k]) / float(r[k]) for k in range(3)})


def _flat(of, params: tuple[str, ...]) -> dict[str, float]:
    """Numbers of a record's fields, by name and place."""
    return {f"{k}.{i}" if np.ndim(getattr(of, k)) else k: float(x) for k in params for i, x in enumerate(np.atleast_1d(getattr(of, k)))}


def _filled(of, flat: dict[str, float]):
    out: dict = {}
    for name, x in flat.items():
        k, _, i = name.partition(".")
        if i:
            out.setdefault(k, list(getattr(of, k)))[int(i)] = x
        else:
            out[k] = x
    return replace(of, **{k: tuple(v) if isinstance(v, list) else v for k, v in out.items()})


def fit_shape(df: DataFrame, wanted: Column, start: SoftShape, params: tuple[str, ...] = ("center", "radii"), steps: int = 25) -> tuple[SoftShape, float]:
    """(shape, mean squared difference) of the soft sphere, ellipsoid or box, and of the thresholds beside
    it, whose weights come nearest to wanted ones from 0 to 1. Any fields can be in `params`; three
    for a center, radii (half sizes of a box) and a rotation each."""
    flat = _flat(start, params)
    within = {k: (1e-6, np.inf) for k in flat if k.startswith("rad")} | {k: (1e-9, np.inf) for k in flat if k in ("opacity", "scale")}

    def residuals(rows: DataFrame, p: dict[str, float]):
        made, weight, slopes = _filled(start, p).slopes(rows)
        return made, [weight - F.col("wanted_weight")], {k: {0: c} for k, c in slopes.items() if k in p}

    best, least = least_squares(df.withColumn("wanted_weight", wanted.cast("double")), residuals, flat, within, steps)
    return _filled(start, best), least


def fit_chain(
    df: DataFrame, target: dict[str, str], color: ColorValues | None = None, opacity: OpacityValues | None = None, transform: TransformValues | None = None,
    params: dict[str, tuple[str, ...]] | None = None, fmt: SceneFormat = SceneFormat(), steps: int = 25,
) -> tuple[tuple[ColorValues | None, OpacityValues | None, TransformValues | None], float]:
    """((colour, opacity, transform), mean square over rows) of a chain whose results come nearest to the
    columns that target names for each of position, opacity and colour: all fitted together.

    params has the fields to fit of "color", "opacity" and "transform". A rotation is fitted as
    axis times angle, by which the transform's own rotation is followed.
    """
    from .colour import apply_color
    from .opacity import apply_opacity
    from .transform import apply_transform

    start = {"color": color, "opacity": opacity, "transform": transform}
    params = params or {"color": ("brightness", "contrast"), "opacity": ("scale",), "transform": ("translation",)}
    turn = "transform" in params and "rotation" in params["transform"]
    if transform is not None and np.ndim(transform.scale) == 0:
        start["transform"] = transform = replace(transform, scale=tuple(transform.scale_vector.tolist()))
    flat = {f"{part}:{k}": v for part, of in start.items() if of is not None for k, v in _flat(of, tuple(x for x in params.get(part, ()) if x != "rotation")).items()}
    flat |= {f"turn:{i}": 0.0 for i in range(3)} if turn else {}
    kept = [c for c in (*POS, OPACITY, *RGB, *QUAT, *SCALE) if c in df.columns]
    rows = df.withColumns({f"from_{c}": F.col(c) for c in kept})
    # each part has columns of its own, so its parameters move the residuals of these alone
    places, position = {c: i for i, c in enumerate(target)}, [F.col(f"from_{c}") for c in POS]
    parts = {"color": (RGB, apply_color), "opacity": ((OPACITY,), apply_opacity), "transform": ((*QUAT, *SCALE), apply_transform)}
    parts = {part: (own, apply) for part, (all_, apply) in parts.items() if start[part] is not None and (own := [c for c in target if c in all_])}

    def chain(p: dict[str, float]):
        out = {part: of and _filled(of, {k.partition(":")[2]: v for k, v in p.items() if k.startswith(f"{part}:")}) for part, of in start.items()}
        if turn:
            by = rot.axis_angle_to_quaternion([p[f"turn:{i}"] for i in range(3)])
            out["transform"] = replace(out["transform"], rotation=tuple(rot.quaternion_multiply(by, transform.rotation).tolist()))
        return out

    def residuals(made: DataFrame, p: dict[str, float], h: float = 1e-5):
        base, slopes = {c: F.col(c) - F.col(t) for c, t in target.items()}, {k: {} for k in p}
        if transform is not None:
            # positions are linear in the entries of a matrix, so its slopes are all it takes
            m = lambda q: chain(q)["transform"].to_matrix()[:3]
            place = lambda m: zip(POS, rot.linear(m[:, :3], position, m[:, 3]), m.any(1))
            base |= {c: v - F.col(target[c]) for c, v, _ in place(m(p)) if c in target}
            for k in (k for k in p if k.startswith(("transform:", "turn:"))):
                slopes[k] |= {places[c]: v for c, v, moves in place((m({**p, k: p[k] + h}) - m({**p, k: p[k] - h})) / (2 * h)) if c in target and moves}
        for part, (own, apply) in parts.items():

            def moved(df: DataFrame, q: dict[str, float]):
                df = apply(df.withColumns({c: F.col(f"from_{c}") for c in kept}), chain(q)[part], fmt)
                return df, [F.col(c) - F.col(target[c]) for c in own]

            made, more, by = differences(made, moved, p, [k for k in p if k.startswith(("transform:", "turn:") if part == "transform" else f"{part}:")], h, part)
            base |= dict(zip(own, more))
            for k, found in by.items():
                slopes[k] |= {places[own[i]]: c for i, c in found.items()}
        return made, [base[c] for c in target], slopes

    best, least = least_squares(rows, residuals, flat, steps=steps)
    v = chain(best)
    return (v["color"], v["opacity"], v["transform"]), least


def balanced_loss_weights(contrast_weight: float = 0.5, regularization: float = 0.1) -> dict[str, float]:
    """Arguments of `fit_color` for a fit that keeps contrast and stays near neutral."""
    return {"contrast_weight": contrast_weight, "range_weight": 0.1, "regularization": regularization * 0.01}
