"""Scene statistics as aggregates: bounds, centroid, percentiles, histograms,
and the corrections that follow from them.

Whatever feeds back into rows comes from one aggregate of fixed size: a row of
numbers joined to all rows, which Spark plans as a broadcast of that row.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..plans.values import ColorValues, HistogramConfig
from ..scene_format import OPACITY, POS, RGB, SCALE, SceneFormat, cols, put
from .filters import largest_scale


def bounds(df: DataFrame) -> DataFrame:
    """One row: min_, max_, size_ and center_ of x, y, z, and max_size; nulls if empty."""
    out = df.agg(*[f(c).alias(f"{n}_{c}") for c in POS for n, f in (("min", F.min), ("max", F.max))])
    out = out.select("*", *[(F.col(f"max_{c}") - F.col(f"min_{c}")).alias(f"size_{c}") for c in POS], *[((F.col(f"max_{c}") + F.col(f"min_{c}")) / 2).alias(f"center_{c}") for c in POS])
    return out.withColumn("max_size", F.greatest(*[F.col(f"size_{c}") for c in POS]))


@dataclass(frozen=True)
class SceneBounds:
    min: tuple
    max: tuple
    sizes: tuple
    center: tuple
    max_size: float


def scene_bounds(df: DataFrame) -> SceneBounds:
    row = bounds(df).first()
    if row["max_size"] is None:
        raise ValueError("an empty scene has no bounds")
    return SceneBounds(*(tuple(row[f"{k}_{c}"] for c in POS) for k in ("min", "max", "size", "center")), row["max_size"])


def centroid(df: DataFrame) -> DataFrame:
    return df.agg(*[F.avg(c).alias(f"mean_{c}") for c in POS])


#: Cells of a power of two in the first step of a search, cells of an interval in each later
#: one, and rows whose values are taken themselves at last.
PER_BINADE, DIGIT, FEW = 64, 1 << 14, 20_000
_BORDER = 1 << 18  # no cell of a finite number is beyond


def _binade_cell(v: Column) -> Column:
    """A number for v that never falls as v rises: its sign, its power of two and the first digit
    behind it. Where log2 is off at a power of two, the digit makes up for it."""
    a = F.abs(v)
    power = F.floor(F.log2(a))
    cell = power * (2 * PER_BINADE) + F.floor(a / F.pow(F.lit(2.0), power.cast("double")) * PER_BINADE) + _BORDER
    return F.when(v == 0, 0).when(a == math.inf, F.signum(v).cast("long") * 2 * _BORDER).otherwise(F.signum(v).cast("long") * cell).cast("long")


def percentile_values(df: DataFrame, value: Column, shares: dict[str, float]) -> dict[str, float | None]:
    """Exact percentiles with linear interpolation, None for a scene without values; NaN is none.

    Radix selection: the first pass counts rows by the leading bits of their numbers, each
    later one splits only the cells that hold a wanted rank by their next 14 bits. So
    there are at most six passes, mostly two, and what the driver gets of each has a bound
    that no values and no number of rows change; each is one aggregate with map-side sums.
    """
    base = df.select(value.cast("double").alias("v")).filter("v is not null and not isnan(v)")

    def counted(rows: DataFrame, cell: Column) -> list:
        return sorted(rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: r["cell"])

    cells = counted(base, _binade_cell(F.col("v")))
    n = sum(r["n"] for r in cells)
    if not n:
        return dict.fromkeys(shares)
    at = {name: share * (n - 1) for name, share in shares.items()}
    ranks = sorted({rank for x in at.values() for rank in (math.floor(x), min(math.floor(x) + 1, n - 1))})
    found: dict[int, float] = {}
    open_ = {rank: (0, -math.inf, math.inf) for rank in ranks}  # rows below an interval, and the interval
    groups = {(-math.inf, math.inf): cells}
    while open_:
        for rank, (below, *span) in list(open_.items()):
            for r in groups[tuple(span)]:
                if rank < below + r["n"]:
                    break
                below += r["n"]
            if r["low"] == r["high"]:
                found[rank] = r["low"]
                del open_[rank]
            else:
                open_[rank] = (below, r["low"], r["high"])
        spans = sorted({x[1:] for x in open_.values()})
        if not spans:
            break
        v = F.col("v")
        inside = [v.between(lo, hi) for lo, hi in spans]
        rows = base.filter(functools.reduce(Column.__or__, inside))
        held = {(r["low"], r["high"]): r["n"] for g in groups.values() for r in g}
        few = sum(held[x] for x in spans) <= FEW
        digit = [F.least(F.floor((v - lo) / (hi - lo) * DIGIT), F.lit(DIGIT - 1)) + k * DIGIT for k, (lo, hi) in enumerate(spans)]
        which = functools.reduce(lambda c, x: c.when(*x), zip(inside, digit), F)
        got = counted(rows, v if few else which)
        groups = {x: [r for r in got if x[0] <= r["low"] <= x[1]] for x in spans}
    return {name: found[math.floor(x)] + (found[min(math.floor(x) + 1, n - 1)] - found[math.floor(x)]) * (x - math.floor(x)) if x > math.floor(x) else found[math.floor(x)] for name, x in at.items()}


def percentiles(df: DataFrame, value: Column, shares: dict[str, float]) -> DataFrame:
    """The same as one row, a column for each name in shares."""
    got = percentile_values(df, value, shares)
    return df.sparkSession.range(1).select(*[F.lit(got[name]).cast("double").alias(name) for name in shares])


def recommended_max_scale(df: DataFrame, percentile: float = 99.5, approximate: bool = False) -> DataFrame:
    """One row, max_scale: a percentile of the largest scale of each row, exact
    with linear interpolation; or approximate, with a sketch of fixed size."""
    if approximate:
        return df.agg(F.percentile_approx(largest_scale(), F.lit(percentile / 100), F.lit(10_000)).alias("max_scale"))
    return percentiles(df, largest_scale(), {"max_scale": percentile / 100})


def _with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Every row of df beside the one row of an aggregate."""
    return df.crossJoin(F.broadcast(row))


def center_at_origin(df: DataFrame) -> DataFrame:
    """Positions minus their mean; lazy, one plan."""
    joined = _with_row(df, centroid(df))
    return put(joined, POS, [F.col(c) - F.col(f"mean_{c}") for c in POS]).drop(*(f"mean_{c}" for c in POS))


def normalize_scale(df: DataFrame, target_size: float = 2.0, fmt: SceneFormat = SceneFormat()) -> DataFrame:
    """Positions and scales by the factor that makes the largest extent the
    target; a scene without extent stays as it is."""
    size = bounds(df).select(F.when(F.col("max_size") >= 1e-8, target_size / F.col("max_size")).otherwise(1.0).alias("_factor"))
    joined = _with_row(df, size)
    k = F.col("_factor")
    joined = put(joined, (*POS, *SCALE), [*(c * k for c in cols(POS)), *((c + F.ln(k)) if fmt.log_scale else c * k for c in cols(SCALE))])
    return joined.drop("_factor")


# ----------------------------------------------------------------- histograms


def _long(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(channel, v): a row for each of a few values of each row; nulls left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("channel"), v.cast("double").alias("v")) for k, v in values.items()])
    return df.select(F.explode(pairs).alias("p")).select("p.channel", "p.v").filter("v is not null")


def histogram(df: DataFrame, values: dict[str, Column], config: HistogramConfig = HistogramConfig(), clamp: bool = True) -> DataFrame:
    """(channel, bin, low, high, count): all bins, also empty ones.

    The range is common to all channels: as configured, or from the smallest to
    the largest value. Values outside go to the end bins, or, with clamp=False,
    nowhere. Counting combines on the map side, so a few rows for each bin move.
    """
    n = config.n_bins
    rows = _long(df, values)
    every = [v.cast("double") for v in values.values()]
    lows, highs = F.array(*map(F.min, every)), F.array(*map(F.max, every))
    ends = df.agg(F.array_min(lows).alias("lo"), F.array_max(highs).alias("hi"))
    given = lambda v, c: F.lit(float(v)) if v is not None else F.coalesce(F.col(c), F.lit(0.0 if c == "lo" else 1.0))
    ends = ends.select(given(config.min_value, "lo").alias("lo"), given(config.max_value, "hi").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / n).otherwise(1.0 / n)
    placed = _with_row(rows, ends.withColumn("width", width))
    if not clamp:
        placed = placed.filter("v >= lo and v <= hi")
    at = F.floor((F.col("v") - F.col("lo")) / F.col("width"))
    counts = placed.groupBy("channel", F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    frame = spark.range(n).select(F.col("id").alias("bin"), F.explode(F.array(*map(F.lit, values))).alias("channel"))
    out = _with_row(frame, ends.withColumn("width", width)).join(counts, ["channel", "bin"], "left")
    count = F.coalesce("count", F.lit(0)).cast("long")
    if config.normalize:
        total = F.sum(F.coalesce("count", F.lit(0))).over(Window.partitionBy("channel"))
        count = F.when(total > 0, count / (total * F.col("width"))).otherwise(0.0)
    return out.select("channel", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"), count.alias("count"))


def statistics(df: DataFrame, values: dict[str, Column], sample: bool = False) -> DataFrame:
    """(channel, n, mean, std, min, max); std of the population, or of a sample.
    All channels are columns of one aggregate, whose row is taken apart at the end."""
    kinds = {"n": F.count, "mean": F.avg, "std": F.stddev_samp if sample else F.stddev_pop, "min": F.min, "max": F.max}
    row = df.agg(*[F.struct(*[f(v.cast("double")).alias(k) for k, f in kinds.items()]).alias(f"c{i}") for i, v in enumerate(values.values())])
    parts = F.array(*[F.struct(F.lit(name).alias("channel"), F.col(f"c{i}").alias("s")) for i, name in enumerate(values)])
    return row.select(F.explode(parts).alias("p")).select("p.channel", "p.s.*").filter("n > 0")


def colour_values() -> dict[str, Column]:
    return dict(zip(RGB, cols(RGB)))


def opacity_values() -> dict[str, Column]:
    return {OPACITY: F.col(OPACITY)}


def scale_values() -> dict[str, Column]:
    s = cols(SCALE)
    return {"scale": (s[0] + s[1] + s[2]) / 3}


def position_values(axis: str | None = None) -> dict[str, Column]:
    p = cols(POS)
    return {axis: F.col(axis)} if axis else {"distance": F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])}


def bin_percentile(hist: DataFrame, p: float) -> DataFrame:
    """(channel, value): the center of the first bin at which p percent are reached.
    Windows run over bins, of which there are few."""
    run = Window.partitionBy("channel").orderBy("bin")
    total = F.sum("count").over(Window.partitionBy("channel"))
    reached = hist.withColumn("ok", F.sum("count").over(run) * 100 >= total * p).filter("ok")
    return reached.groupBy("channel").agg(F.min_by((F.col("low") + F.col("high")) / 2, "bin").alias("value"))


def bin_mode(hist: DataFrame) -> DataFrame:
    """(channel, value): the center of the fullest bin, of several the first."""
    first = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("count"), "bin"))
    return hist.withColumn("nth", first).filter("nth = 1").select("channel", ((F.col("low") + F.col("high")) / 2).alias("value"))


def entropy(hist: DataFrame) -> DataFrame:
    """(channel, value) in bits."""
    share = F.col("count") / F.sum("count").over(Window.partitionBy("channel"))
    return hist.filter("count > 0").withColumn("p", share).groupBy("channel").agg((-F.sum(F.col("p") * F.log2("p"))).alias("value"))


def dynamic_range(hist: DataFrame, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """One row: the mean over channels of the distance between two percentiles."""
    a, b = bin_percentile(hist, low), bin_percentile(hist, high).withColumnRenamed("value", "top")
    return a.join(b, "channel").agg(F.avg(F.col("top") - F.col("value")).alias("value"))


#: Of a soft histogram: cells of one sigma, moments of each, and sigmas beyond which a weight is nothing (2e-22).
CELLS_OF_SIGMA, MOMENTS, REACH = 4, 10, 10


def soft_histogram(df: DataFrame, values: dict[str, Column], n_bins: int = 64, lo: float = 0.0, hi: float = 1.0, sigma: float | None = None) -> DataFrame:
    """(channel, bin, weight): Gaussian weights to bin centers, adding up to 1.

    A row adds to the moments of the cell it lies in, whatever the number of bins; what the rows of
    a cell weigh in a bin follows from these by the Taylor series of the Gaussian, whose
    derivatives are Hermite polynomials. A row's weight is off by 1.09 / sqrt(10!) / 8 ^ 10
    at most, which is 6e-13, since no row is farther than an eighth of sigma from its cell's middle.
    """
    width = (hi - lo) / n_bins
    s = width / 2 if sigma is None else sigma
    first, step = lo - REACH * s, s / CELLS_OF_SIGMA
    cell, middle = F.floor((F.col("v") - first) / step), first + (F.col("cell") + 0.5) * step
    rows = _long(df, values).withColumn("cell", F.when((F.col("v") >= first) & (F.col("v") <= hi + REACH * s), cell).otherwise(-1))
    d = (F.col("v") - middle) / s
    powers = [F.lit(1.0)]
    for _ in range(MOMENTS - 1):
        powers.append(powers[-1] * F.col("d"))
    cells = rows.withColumn("d", F.when(F.col("cell") >= 0, d).otherwise(0.0)).groupBy("channel", "cell").agg(*[F.sum(x).alias(f"m{k}") for k, x in enumerate(powers)])
    # the bins in reach of a cell, and all bins with nothing for each channel
    at = lambda x: F.floor((x - lo) / width)
    low, high = F.greatest(at(middle - REACH * s), F.lit(0)), F.least(at(middle + REACH * s), F.lit(n_bins - 1))
    near = cells.filter("cell >= 0").withColumns({"low": low, "high": high}).filter("low <= high").withColumn("bin", F.explode(F.sequence("low", "high")))
    u = (middle - (lo + (F.col("bin") + 0.5) * width)) / s
    series = F.lit(0.0)
    for k in range(MOMENTS):
        poly = F.lit(0.0)
        for factor in reversed(np.polynomial.hermite_e.herme2poly([0] * k + [1]).tolist()):
            poly = poly * F.col("u") + factor
        series = series + poly * F.col(f"m{k}") * ((-1) ** k / math.factorial(k))
    parts = near.withColumn("u", u).select("channel", F.col("bin").cast("int").alias("bin"), (series * F.exp(-F.col("u") * F.col("u") / 2)).alias("weight"))
    none = cells.select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"), F.lit(0.0).alias("weight"))
    out = parts.unionByName(none).groupBy("channel", "bin").agg(F.greatest(F.sum("weight"), F.lit(0.0)).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("channel"))
    return out.withColumn("weight", F.col("weight") / (total + 1e-8))


def color_profile(mean: float, std: float, profile: str = "neutral") -> ColorValues:
    """A record that moves a histogram with this mean and std to a profile."""
    contrast, bright = std / 0.289, mean / 0.5  # of an even spread from 0 to 1
    within = lambda v, a, b: min(max(v, a), b)
    # The published profiles.
    fixed = {
        "vibrant": ColorValues(saturation=1.3, vibrance=1.2, contrast=1.05, gamma=0.95 if mean > 0.5 else 1.05),
        "dramatic": ColorValues(contrast=1.3, shadows=-0.15, highlights=0.05, saturation=1.1),
        "warm": ColorValues(temperature=0.3, tint=0.05, saturation=1.05),
        "cool": ColorValues(temperature=-0.3, tint=-0.05, saturation=1.05),
        "cinematic": ColorValues(contrast=1.15, saturation=0.9, fade=0.08, shadows=-0.1, highlights=-0.05, shadow_tint_hue=0.6, shadow_tint_sat=0.15, highlight_tint_hue=0.1, highlight_tint_sat=0.1),
        "muted": ColorValues(saturation=0.7, vibrance=0.8, contrast=0.9, fade=0.05),
        "punchy": ColorValues(contrast=1.25, saturation=1.25, vibrance=1.15, shadows=-0.1, highlights=0.1),
    }
    if profile in fixed:
        return fixed[profile]
    if profile == "neutral":
        gamma = math.log(0.5) / math.log(mean) if 0.01 < mean < 1 else 2.0 if mean >= 1 else 1.0
        return ColorValues(gamma=within(gamma, 0.5, 2.0), contrast=within(1 / contrast if contrast > 0.1 else 1.0, 0.5, 2.0))
    if profile == "bright":
        return ColorValues(brightness=within(1.3 / bright if bright > 0.1 else 1.3, 1.0, 2.0), gamma=0.9)
    if profile == "dark":
        return ColorValues(brightness=within(0.7 / bright if bright > 0.1 else 0.7, 0.5, 1.0), gamma=1.1)
    raise ValueError(f"no profile {profile!r}; there are neutral, bright, dark, {', '.join(fixed)}")


# ----------------------------------------------------- automatic corrections

#: The published limits and goals of the corrections.
LIMITS = {"contrast": (0.5, 3.0), "blacks": (-0.2, 0.2), "brightness": (0.5, 2.5), "gain": (0.5, 2.0), "temperature": (-1.0, 1.0), "tint": (-1.0, 1.0), "enhanced": (0.5, 2.0)}
SPAN, LEAST_SPAN, LEAST_LIGHT, PATCH, TINY = 0.95, 0.01, 0.01, 0.95, 1e-8


@dataclass(frozen=True)
class Correction:
    brightness: float = 1.0
    contrast: float = 1.0
    exposure: float = 0.0
    blacks: float = 0.0
    temperature: float = 0.0
    tint: float = 0.0
    gains: tuple[float, float, float] = (1.0, 1.0, 1.0)

    def to_color_values(self) -> ColorValues:
        return ColorValues(brightness=self.brightness, contrast=self.contrast, temperature=self.temperature, tint=self.tint, shadows=self.blacks)


def _within(name: str, c: Column) -> Column:
    return sc.clip(c, *LIMITS[name])


def corrections(df: DataFrame, contrast_clip: float = 0.1, light_clip: float = 1.0, midtone: float = 0.45, white: str = "gray_world") -> DataFrame:
    """One row with all automatic corrections: contrast, blacks, brightness,
    exposure, temperature, tint, gain_r, gain_g, gain_b.

    One search, when this is called, gives all percentiles of luminance, and one aggregate the means
    between two of them (or above one), from which everything else follows.
    Clips are in percent. A scene without rows, of one tone, or too dark for a
    correction is left as it is.
    """
    if white not in ("gray_world", "white_patch"):
        raise ValueError(f"no method {white!r}")
    lum = sc.luminance(cols(RGB))
    shares = {"_a": contrast_clip / 100, "_b": 1 - contrast_clip / 100, "_c": light_clip / 100, "_d": 1 - light_clip / 100, "_w": PATCH}
    at = {k: F.lit(v).cast("double") for k, v in percentile_values(df, lum, shares).items()}
    beside = df.select(*RGB, lum.alias("_lum"))
    trimmed = F.col("_lum").between(at["_c"], at["_d"])
    toned = trimmed if white == "gray_world" else F.col("_lum") >= at["_w"]
    row = beside.agg(F.avg(F.when(trimmed, F.col("_lum"))).alias("light"), *[F.avg(F.when(toned, F.col(c))).alias(f"m_{c}") for c in RGB])
    span, means = at["_b"] - at["_a"], cols([f"m_{c}" for c in RGB])
    goal = (means[0] + means[1] + means[2]) / 3 if white == "gray_world" else F.greatest(*means)
    row = row.withColumn("contrast", F.when(span >= LEAST_SPAN, _within("contrast", SPAN / span)).otherwise(1.0))
    row = row.withColumn("blacks", F.when(span >= LEAST_SPAN, _within("blacks", -at["_a"] * F.col("contrast"))).otherwise(0.0))
    row = row.withColumn("brightness", F.when(F.col("light") >= LEAST_LIGHT, _within("brightness", midtone / F.col("light"))).otherwise(1.0))
    row = row.withColumn("exposure", F.log2("brightness"))
    row = row.withColumns({f"gain_{c}": F.when(goal >= LEAST_LIGHT, _within("gain", goal / (m + TINY))).otherwise(1.0) for c, m in zip(RGB, means)})
    r, g, b = cols([f"gain_{c}" for c in RGB])
    warm, green = (r / (b + TINY) - 1) / 2, (1 - g / ((r + b) / 2 + TINY)) / 2
    lit = goal >= LEAST_LIGHT
    return row.select("contrast", "blacks", "brightness", "exposure", F.when(lit, _within("temperature", warm)).otherwise(0.0).alias("temperature"), F.when(lit, _within("tint", green)).otherwise(0.0).alias("tint"), "gain_r", "gain_g", "gain_b")


def auto_contrast(df: DataFrame, clip_percent: float = 0.1, per_channel: bool = False) -> Correction:
    if not per_channel:
        row = corrections(df, contrast_clip=clip_percent).first()
        return Correction(contrast=row["contrast"], blacks=row["blacks"])
    row = {k: v for c in RGB for k, v in percentile_values(df, F.col(c), {f"{c}0": clip_percent / 100, f"{c}1": 1 - clip_percent / 100}).items()}
    if row["r0"] is None:
        return Correction()
    spans = [row[f"{c}1"] - row[f"{c}0"] for c in RGB]
    gains = tuple(1 / s if s > LEAST_SPAN else 1.0 for s in spans)
    return Correction(contrast=sum(gains) / 3, gains=gains)


def auto_exposure(df: DataFrame, target_midtone: float = 0.45, clip_percent: float = 1.0) -> Correction:
    row = corrections(df, light_clip=clip_percent, midtone=target_midtone).first()
    return Correction(brightness=row["brightness"], exposure=row["exposure"])


def auto_white_balance(df: DataFrame, clip_percent: float = 1.0, method: str = "gray_world") -> Correction:
    row = corrections(df, light_clip=clip_percent, white=method).first()
    return Correction(temperature=row["temperature"], tint=row["tint"], gains=(row["gain_r"], row["gain_g"], row["gain_b"]))


def auto_enhance(df: DataFrame, strength: float = 1.0, preserve_warmth: bool = True) -> Correction:
    """Exposure, contrast and white balance, blended by strength; all from one row."""
    row = corrections(df, contrast_clip=0.5).first()
    within = lambda v, name: min(max(v, LIMITS[name][0]), LIMITS[name][1])
    k = strength * (0.5 if preserve_warmth else 1.0)
    return Correction(
        brightness=within(1 + (row["brightness"] - 1) * strength, "enhanced"), contrast=within(1 + (row["contrast"] - 1) * strength * 0.7, "enhanced"),
        temperature=within(row["temperature"] * k, "temperature"), tint=within(row["tint"] * k, "tint"), exposure=row["exposure"],
    )


def optimal_parameters(df: DataFrame, target_mean: float | None = None, target_std: float | None = None, preserve_contrast: bool = True, min_contrast_ratio: float = 0.8) -> ColorValues:
    lum = sc.luminance(cols(RGB))
    row = df.agg(F.avg(lum).alias("m"), F.stddev_pop(lum).alias("s")).first()
    out = ColorValues()
    if row["m"] is None:
        return out
    if target_mean is not None and row["m"] > 1e-8:
        out = replace(out, brightness=target_mean / row["m"])
    if target_std is not None and row["s"] > 1e-8:
        k = target_std / row["s"]
        out = replace(out, contrast=max(k, min_contrast_ratio) if preserve_contrast else k)
    return out
