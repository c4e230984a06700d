import contextlib
import io
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from splatarium.functions import rotation as rot
from splatarium.functions import scalar as sc
from splatarium.operators import colour, compose, filters, learn, stats, transform, verify
from splatarium.operators.filters import Filter, Tests
from splatarium.plans.pipeline import GroupedPipeline, Pipeline, Stage
from splatarium.plans.values import ColorValues, FilterValues, HistogramConfig, OpacityValues, TransformValues
from splatarium.scene import Scene
from splatarium.scene_format import BANDS, OPACITY, POS, QUAT, RGB, SCALE, SceneFormat
from splatarium.sources import ply, ply_source, tables

COLS = [*POS, *SCALE, "qw", "qx", "qy", "qz", OPACITY, *RGB]
N = 300


@pytest.fixture(scope="module")
def pdf():
    g = np.random.default_rng(42)
    q = g.normal(size=(N, 4))
    x = np.concatenate([g.normal(size=(N, 3)) * 2, g.random((N, 3)) * 0.5 + 0.1, q / np.linalg.norm(q, axis=1, keepdims=True), g.random((N, 4))], axis=1)
    return pd.DataFrame(x, columns=COLS).assign(gid=np.arange(N))


@pytest.fixture(scope="module")
def scene(spark, pdf):
    return Scene(spark.createDataFrame(pdf).cache())


def rows(s, *cols):
    df = s.df if isinstance(s, Scene) else s
    return df.orderBy("gid").select(*cols).toPandas().to_numpy()


def gids(s):
    df = s.df if isinstance(s, Scene) else s
    return set(df.toPandas()["gid"])


def test_filters_against_numpy(scene, pdf):
    p = pdf[list(POS)].to_numpy()
    assert gids(scene.filter_within_sphere(2.0, (1, 0, 0))) == set(np.flatnonzero(((p - [1, 0, 0]) ** 2).sum(1) <= 4))
    assert gids(scene.filter_min_opacity(0.5)) == set(np.flatnonzero(pdf[OPACITY] >= 0.5))
    inside = gids(scene.filter(FilterValues(box_min=(-1, -2, -1), box_max=(2, 1, 3), box_rot=(0.2, 0.4, -0.3))))
    from splatarium.functions import rotation as rot

    local = (p - [0.5, -0.5, 1]) @ rot.axis_angle_to_rotation_matrix((0.2, 0.4, -0.3))
    assert inside == set(np.flatnonzero((np.abs(local) <= [1.5, 1.5, 2]).all(1)))
    assert gids(scene.filter_outside_sphere(2.0)) == set(range(N)) - gids(scene.filter_within_sphere(2.0))
    assert gids(scene.filter(FilterValues())) == set(range(N))


def test_filter_algebra(scene):
    a, b = Filter.sphere(2.0), Filter.min_opacity(0.5)
    A, B = gids(scene.filter(a)), gids(scene.filter(b))
    assert gids(scene.filter(a & b)) == A & B and gids(scene.filter(a | b)) == A | B and gids(scene.filter(~~a)) == A
    assert gids(scene.filter(~(a | b))) == set(range(N)) - A - B
    two = Filter.sphere(5.0) & Filter.sphere(3.0, (2, 0, 0))
    merged = Filter.sphere(5.0).merged_with(Filter.sphere(3.0, (2, 0, 0)))
    assert gids(scene.filter(two)) <= gids(scene.filter(merged))
    with pytest.raises(ValueError):
        (a | b).to_values()
    assert gids(scene.filter(Filter.from_values(FilterValues(sphere_radius=2.0, invert=True)))) == set(range(N)) - A
    masked = scene.mask("near", a).df.filter("mask_near")
    assert gids(masked) == A


def test_nan_nulls_and_empty(spark):
    nan = float("nan")
    rows_ = [(0, nan, 0.0, 0.0, 0.5), (1, 0.0, 0.0, 0.0, nan), (2, 0.0, 0.0, 0.0, None), (3, 0.0, 0.0, 0.0, 1.2), (4, 0.0, 0.0, 0.0, 0.5)]
    df = spark.createDataFrame(rows_, "gid int, x double, y double, z double, opacity double").selectExpr("*", "0.1D AS sx", "0.1D AS sy", "0.1D AS sz")
    s = Scene(df)
    assert gids(s.filter_within_sphere(1.0)) == {4}
    assert gids(s.filter_outside_sphere(1.0)) == {0, 1, 2, 3}
    assert gids(Tests().min_opacity(0.3)(df)) == {0, 3, 4}
    empty = Scene(df.limit(0))
    assert empty.bounds().first()["max_size"] is None
    with pytest.raises(ValueError):
        stats.scene_bounds(empty.df)
    h = empty.histogram_opacity(HistogramConfig(4)).toPandas()
    assert h["count"].sum() == 0 and h["low"].min() == 0 and h["high"].max() == 1
    assert empty.center_at_origin().df.count() == 0


def test_geometry_checks(scene):
    for bad in (lambda: filters.SphereFilter(radius=0), lambda: filters.BoxFilter(size=(1, 0, 1)), lambda: filters.EllipsoidFilter(radii=(1, 1, -1)), lambda: filters.FrustumFilter(near=2, far=1), lambda: filters.QualityFilter(min_opacity=2)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        filters.geometry_filter(scene.df, "sphere")
    some = filters.geometry_filter(scene.df, filters.SphereFilter(radius=3.0), filters.QualityFilter(min_opacity=0.5, max_scale=0.5))
    assert gids(some) == gids(scene.filter(FilterValues(sphere_radius=3.0, min_opacity=0.5, max_scale=0.5)))
    cam = filters.geometry_filter(scene.df, filters.FrustumFilter(position=(0, 0, 5), far=20.0))
    assert all(z < 5 - 0.1 for (z,) in rows(cam, "z"))


def test_pushdown(spark, scene, tmp_path):
    tables.write_scene(scene, str(tmp_path / "s"), cell=0.5)
    back = tables.read_scene(spark, str(tmp_path / "s"), scene.format)
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = back.filter_within_sphere(1.0).df.select("r")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x," in plan and "qw" not in plan.split("ReadSchema")[1]
    assert gids(back) == set(range(N))


def test_transform(scene, pdf):
    v = TransformValues((2, 1, 0.5), (0.5, 0.5, 0.5, 0.5), (1, 2, 3), (0.1, 0, 0))
    got = rows(scene.transform(v), *POS, *SCALE)
    p = np.c_[pdf[list(POS)], np.ones(N)] @ v.to_matrix().T
    assert np.allclose(got[:, :3], p[:, :3]) and np.allclose(got[:, 3:], pdf[list(SCALE)] * [2, 1, 0.5])
    log = Scene(scene.df, SceneFormat(log_scale=True))
    assert np.allclose(rows(log.scale_uniform(2.0), *SCALE), pdf[list(SCALE)] + math.log(2))
    steps = transform.Transform().translate((1, 0, 0)).rotate_euler_deg((0, 0, 90)).scale(2.0)
    assert np.allclose(rows(steps(scene.df), *POS), np.c_[-2 * pdf.y, 2 * (pdf.x + 1), 2 * pdf.z])
    assert np.allclose(transform.rotation_from_6d(transform.axis_angle_to_6d((0.1, 0.2, 0.3))), transform.rot.axis_angle_to_rotation_matrix((0.1, 0.2, 0.3)))
    with pytest.raises(TypeError):
        transform.Transform().translate(1.0)
    unit = scene.normalize_scale(2.0).bounds().first()["max_size"]
    assert unit == pytest.approx(2.0) and np.allclose(list(scene.center_at_origin().centroid().first()), 0, atol=1e-12)


def test_colour_forms(scene, pdf):
    c = pdf[list(RGB)].to_numpy()
    v = ColorValues(brightness=1.1, contrast=1.2, gamma=0.9, saturation=1.3, temperature=0.2, tint=0.1, hue_shift=20, vibrance=1.2, shadows=0.1, highlights=-0.1, fade=0.05, shadow_tint_sat=0.2, shadow_tint_hue=90)
    assert np.allclose(rows(scene.color(v), *RGB), learn.grade(c, v))
    assert np.allclose(rows(scene.color(ColorValues()), *RGB), c)
    table = colour.Color().brightness(1.2).gamma(0.8)
    exact = rows(table(scene.df, exact=True), *RGB)
    assert np.allclose(rows(table(scene.df), *RGB), exact, atol=4e-3)
    assert np.allclose(rows(colour.lookup(scene.df, table.lut()), *RGB), rows(table(scene.df), *RGB))
    assert np.allclose(rows(colour.lookup(scene.df, table.lut(), interpolate=True), *RGB), exact, atol=1e-3)
    assert colour.Color().brightness(1.1).brightness(1.1).folded().brightness == pytest.approx(1.21)
    both = colour.Color().shadow_tint(0, 0.1).shadow_tint(90, 0.3).folded()
    assert (both.shadow_tint_hue, both.shadow_tint_sat) == pytest.approx((67.5, 0.4))
    for bad in (lambda: colour.Color().brightness(6), lambda: colour.Color().gamma(0), lambda: colour.Color().fade(-0.1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        colour.Color().contrast("1")
    t = colour.Color.template(brightness=colour.Param("b", 1.0, (0.5, 2.0)), shadows=colour.Param("s", 0.0, (-1, 1)))
    assert np.allclose(rows(t(scene.df, params={"b": 1.5, "s": 0.2}, exact=True), *RGB), rows(colour.Color().brightness(1.5).shadows(0.2)(scene.df, exact=True), *RGB))
    with pytest.raises(ValueError):
        t(scene.df, params={"b": 3.0})
    assert np.allclose(rows(scene.color_preset("warm", 0.0), *RGB), c) and rows(colour.learnable_color(scene.df, v), *RGB).max() <= 1


def test_harmonics_and_formats(spark, scene, pdf):
    df = scene.df.withColumn("shn", F.array(F.struct(F.col("r"), F.col("g"), F.col("b"))))
    sh = Scene(df).to_sh()
    assert np.allclose(rows(sh.to_rgb(), *RGB), pdf[list(RGB)])
    # brightness means the same in both forms
    assert np.allclose(rows(sh.adjust(brightness=1.5).to_rgb(), *RGB), np.clip(pdf[list(RGB)] * 1.5, 0, 1))
    bands = sh.adjust(brightness=1.5, contrast=2.0).df.orderBy("gid").select("shn").collect()
    assert bands[0].shn[0].r == pytest.approx(3 * pdf.r[0])
    gamma = sh.adjust(gamma=2.0).df.orderBy("gid").first()
    lum = lambda rgb: float(np.dot(rgb, sc.LUMA))
    c = pdf.loc[0, list(RGB)].to_numpy(float)
    assert gamma.shn[0].g == pytest.approx(c[1] * lum(c**2) / (lum(c) + 1e-8))
    back = scene.to_log().to_linear()
    assert np.allclose(rows(back, *SCALE, OPACITY), pdf[[*SCALE, OPACITY]], atol=1e-6)
    assert SceneFormat(log_scale=True, logit_opacity=True).is_log and "RGB" in SceneFormat().summary()
    logit = scene.to_log()
    assert gids(logit.filter_min_opacity(0.5)) == gids(scene.filter_min_opacity(0.5))
    assert np.allclose(rows(logit.opacity(OpacityValues(1.5)).to_linear(), OPACITY), rows(scene.opacity(OpacityValues(1.5)), OPACITY), atol=1e-6)


def test_statistics(scene, pdf):
    b = stats.scene_bounds(scene.df)
    assert np.allclose(b.min, pdf[list(POS)].min()) and b.max_size == pytest.approx((pdf[list(POS)].max() - pdf[list(POS)].min()).max())
    assert scene.recommended_max_scale().first()[0] == pytest.approx(np.percentile(pdf[list(SCALE)].max(axis=1), 99.5))
    h = scene.histogram_colors(HistogramConfig(8, 0.0, 1.0)).toPandas()
    want = np.histogram(pdf.g, 8, (0, 1))[0]
    assert h[h.channel == "g"].sort_values("bin")["count"].tolist() == want.tolist()
    dens = scene.histogram_opacity(HistogramConfig(8, normalize=True)).toPandas()
    assert (dens["count"] * (dens.high - dens.low)).sum() == pytest.approx(1)
    dropped = stats.histogram(scene.df, stats.opacity_values(), HistogramConfig(4, 0.2, 0.6), clamp=False)
    assert dropped.agg(F.sum("count")).first()[0] == pdf[OPACITY].between(0.2, 0.6).sum()
    flat = stats.histogram(scene.df, {"k": F.lit(0.5)}, HistogramConfig(4)).toPandas()
    assert flat["count"].tolist().count(0) == 3
    assert stats.dynamic_range(scene.histogram_colors(), 1, 99).first()[0] > 0.9
    assert stats.auto_contrast(scene.df).contrast == pytest.approx(0.95 / np.subtract(*np.percentile(pdf[list(RGB)] @ sc.LUMA, [99.9, 0.1])))
    for m in ("gray_world", "white_patch"):
        assert abs(stats.auto_white_balance(scene.df, method=m).temperature) < 0.2
    with pytest.raises(ValueError):
        stats.auto_white_balance(scene.df, method="x")
    assert stats.auto_enhance(scene.df, 0.0).to_color_values().is_neutral()
    assert stats.optimal_parameters(scene.df, target_mean=0.25).brightness == pytest.approx(0.25 / (pdf[list(RGB)] @ sc.LUMA).mean())
    for p in ("neutral", "vibrant", "dramatic", "bright", "dark", "warm", "cool", "cinematic", "muted", "punchy"):
        assert isinstance(stats.color_profile(0.4, 0.2, p), ColorValues)
    with pytest.raises(ValueError):
        stats.color_profile(0.4, 0.2, "none")


@pytest.mark.parametrize("kind", ["even", "ties", "far", "one", "equal", "none", "huge", "powers", "digits"])
def test_percentiles(spark, kind, monkeypatch):
    monkeypatch.setattr(stats, "FEW", 50 if kind == "digits" else 20_000)
    g = np.random.default_rng(3)
    x = {"even": g.random(5000), "ties": g.integers(0, 9, 3000) / 7, "far": np.append(g.exponential(1, 4000), [1e12, -1e9]), "one": np.array([2.5]), "equal": np.full(50, 0.1), "none": np.zeros(0)} | {
        # values that no cells of equal width tell apart, and neighbours of powers of two
        "huge": np.concatenate([10.0 ** np.linspace(-300, 300, 999), -(10.0 ** np.linspace(-320, 300, 998)), [0.0, -0.0, 5e-324, 1.7e308, -1.7e308]]),
        "powers": np.concatenate([[f(2.0**k, d) for d in (0, 9e9)] for k in range(-1070, 1023, 9) for f in (np.nextafter, lambda v, _: v)]),
        "digits": 1 + g.random(4000) * 1e-9,
    }
    x = x[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,)], "v double").repartition(3)
    shares = {"a": 0.0, "b": 0.001, "c": 0.5, "d": 0.995, "e": 1.0, "f": 0.37}
    row = stats.percentiles(df, F.col("v"), shares).first()
    for name, s in shares.items():
        assert row[name] is None if kind == "none" else row[name] == pytest.approx(np.quantile(x, s), rel=1e-12, abs=1e-12)


def test_corrections_of_odd_scenes(spark, scene):
    """No rows, one tone, and black: nothing is corrected."""
    for df in (scene.df.limit(0), scene.df.withColumns({c: F.lit(0.0) for c in RGB})):
        assert stats.auto_enhance(df).to_color_values().is_neutral() and stats.auto_contrast(df) == stats.Correction() and stats.auto_contrast(df, per_channel=True).contrast == 1
    grey = scene.df.withColumns({c: F.lit(0.5) for c in RGB})
    assert stats.auto_contrast(grey).contrast == 1 and stats.auto_exposure(grey).brightness == pytest.approx(0.9) and stats.auto_white_balance(grey).temperature == pytest.approx(0, abs=1e-6)


def test_fit(scene, pdf):
    target = learn.moments(scene.color(ColorValues(brightness=0.8, contrast=1.1)).df)
    v, loss = learn.fit_color(scene.df, target, ("brightness", "contrast"), epochs=60)
    before = learn.moment_loss(pdf[list(RGB)].to_numpy(), np.ones(N), target)
    assert loss < before / 20 and v.brightness == pytest.approx(0.8, abs=0.08)
    kept, _ = learn.fit_color(scene.df, target, ("contrast",), epochs=5, **learn.balanced_loss_weights())
    assert 0 <= kept.contrast <= 5 and learn.fit_color(scene.df.limit(0), target)[1] == 0


def brute_first(points, eps):
    kept = []
    for i, p in enumerate(points):
        if all(np.linalg.norm(p - points[k]) >= eps for k in kept):
            kept.append(i)
    return set(kept)


def test_deduplicate(spark):
    def frame(points):
        return spark.createDataFrame(pd.DataFrame(np.asarray(points, float), columns=list(POS)).assign(gid=range(len(points))))

    chain = frame([(0, 0, 0), (0.8, 0, 0), (1.6, 0, 0)])
    assert gids(compose.deduplicate(chain, 1.0)) == {0, 2} and gids(compose.deduplicate(chain, 1.0, "last")) == {2}
    basic = frame([(0, 0, 0), (-0.0, 0, 0), (1, 0, 0), (1, 0, 0), (2, 0, 0)])
    assert gids(compose.deduplicate(basic)) == {0, 2, 4} and gids(compose.deduplicate(basic, method="last")) == {1, 3, 4}
    cloud = np.random.default_rng(3).random((250, 3)) * 2
    assert gids(compose.deduplicate(frame(cloud), 0.3)) == brute_first(cloud, 0.3)
    far = frame([(3e9, 0, 0), (3e9, 0, 0), (-3e9, 1, 1)])
    assert gids(compose.deduplicate(far, 1e-3)) == {0, 2}
    with pytest.raises(NotImplementedError):
        compose.deduplicate(basic, method="average")
    with pytest.raises(ValueError):
        compose.deduplicate(basic, method="x")


def test_fit_transform(scene, pdf):
    want = TransformValues((2.0, 0.5, 1.5), TransformValues.from_rotation_euler(20, -35, 60).rotation, (1.0, -2.0, 0.5), (0.3, 0.1, -0.2))
    moved = scene.transform(want).df.select("gid", *[F.col(c).alias(f"to_{c}") for c in POS])
    pairs, to = scene.df.join(moved, "gid"), ("to_x", "to_y", "to_z")
    got, loss = learn.fit_transform(pairs, to, start=TransformValues(center=(0.3, 0.1, -0.2)))
    assert loss < 1e-4 and np.allclose(got.to_matrix(), want.to_matrix(), atol=0.02) and got.center == want.center
    x, m = pdf[list(POS)].to_numpy(), want.to_matrix()
    y = x @ m[:3, :3].T + m[:3, 3]
    moved_alone, loss = learn.fit_transform(pairs, to, params=("translation",))
    assert np.allclose(moved_alone.translation, (y - x).mean(0), atol=0.01) and moved_alone.scale == (1.0, 1.0, 1.0) and loss == pytest.approx(((x + moved_alone.translation - y) ** 2).sum(1).mean(), rel=1e-6)
    assert learn.fit_transform(pairs.limit(0), to) == (TransformValues(), 0.0)


def test_fit_opacity_and_filter(scene, pdf):
    for scale in (0.6, 1.4):
        after = scene.opacity(OpacityValues(scale)).df.agg(F.avg(OPACITY)).first()[0]
        got, loss = learn.fit_opacity(scene.df, after)
        assert got.scale == pytest.approx(scale, abs=0.01) and loss < 1e-6
        logit = scene.to_log()
        assert learn.fit_opacity(logit.df, after, logit.format)[0].scale == pytest.approx(scale, abs=0.01)
    want = filters.soft_weight(opacity=0.4, scale=0.45, shape="sphere", radius=2.5)
    start = FilterValues(min_opacity=0.2, max_scale=0.7, sphere_radius=1.0)
    got, loss = learn.fit_filter(scene.df, want, start=start, grid=64)
    assert loss < 1e-4 and (got.min_opacity, got.max_scale, got.sphere_radius) == pytest.approx((0.4, 0.45, 2.5), abs=0.03)
    kept, _ = learn.fit_filter(scene.df, want, params=("sphere_radius",), start=start)
    assert (kept.min_opacity, kept.max_scale) == (0.2, 0.7)
    assert learn.fit_filter(scene.df.limit(0), want, start=start) == (start, 0.0) and learn.fit_opacity(scene.df.limit(0), 0.5) == (OpacityValues(), 0.0)


def test_smooth_chain(scene, pdf):
    """Smooth steps follow one another on one scene, in any order."""
    a = scene.smooth_color(ColorValues(brightness=1.2)).transform(TransformValues.from_translation(1, 0, 0)).opacity(OpacityValues(0.5)).soft_filter(opacity=0.3)
    b = scene.opacity(OpacityValues(0.5)).soft_filter(opacity=0.3).transform(TransformValues.from_translation(1, 0, 0)).smooth_color(ColorValues(brightness=1.2))
    verify.assert_equivalent(a, b, 0, 0)
    o = pdf[OPACITY].to_numpy() * 0.5
    assert np.allclose(rows(a, OPACITY)[:, 0], o / (1 + np.exp(-(o - 0.3) * 10))) and np.allclose(rows(a, "x")[:, 0], pdf["x"] + 1)


def test_equivalence(scene):
    verify.assert_equivalent(scene, scene.translate((1, 0, 0)).translate((-1, 0, 0)))
    verify.assert_equivalent(Scene(scene.df.withColumn("x", F.lit(math.nan))), Scene(scene.df.withColumn("x", F.lit(math.nan))), 0, 0)
    for other in (scene.translate((1e-3, 0, 0)), Scene(scene.df.limit(N - 1)), Scene(scene.df.unionByName(scene.df.limit(1))), Scene(scene.df.withColumn("r", F.lit(None).cast("double"))), scene.to_log()):
        with pytest.raises(AssertionError):
            verify.assert_equivalent(scene, other)
    verify.assert_equivalent(scene, scene.translate((1e-3, 0, 0)), check_all=False)
    with pytest.raises(AssertionError):
        verify.assert_same_format(scene, scene.to_sh())


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("method", ["first", "last"])
def test_deduplicate_clumps(spark, seed, method):
    """Clumps, chains and equal points against the definition, one row after another."""
    g = np.random.default_rng(seed)
    x = np.concatenate([g.random((40, 3)) * 3, g.normal(size=(120, 3)) * 0.05, np.outer(np.arange(60) * 0.15, [1, 0.5, 0.2]), np.zeros((5, 3)), -g.random((20, 3)) * 0.4])
    x = x[g.permutation(len(x))].round(3)
    df = spark.createDataFrame(pd.DataFrame(x, columns=POS).assign(gid=np.arange(len(x)))).repartition(3)
    near = ((x[:, None] - x[None]) ** 2).sum(-1) < 0.2 * 0.2
    if method == "last":
        want = [i for i in range(len(x)) if not near[i, i + 1 :].any()]
    else:
        want = []
        for i in range(len(x)):
            if not near[i, want].any():
                want.append(i)
    assert gids(compose.deduplicate(df, 0.2, method)) == set(want)


@pytest.mark.parametrize("block", [40, 200_000])
def test_deduplicate_blocks(spark, block, monkeypatch):
    """Chains, clumps and far points over many borders of blocks, with keys in any order."""
    monkeypatch.setattr(compose, "BLOCK", block)
    g = np.random.default_rng(block)
    x = np.concatenate([np.outer(np.arange(150) * 0.15, [1, 0.02, -0.3]), g.normal(size=(250, 3)) * 0.5, g.random((60, 3)) * 9 - 5])
    for order in (np.arange(len(x)), g.permutation(len(x))):
        p = x[order]
        df = spark.createDataFrame(pd.DataFrame(p, columns=POS).assign(gid=np.arange(len(p)))).repartition(3)
        assert gids(compose.deduplicate(df, 0.2)) == brute_first(p, 0.2)


def test_deduplicate_a_long_line(spark, monkeypatch):
    """A line of 100,000 points, each near its neighbours, settles in a fixed number of tables."""
    tables, save = [], compose.saved
    monkeypatch.setattr(compose, "saved", lambda df: tables.append(save(df)) or tables[-1])
    line = spark.range(100_000).select(F.col("id").alias("gid"), (F.col("id") * 0.75).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    got = compose.deduplicate(line, 1.0).agg(F.count("gid"), F.sum(F.col("gid") % 2)).first()
    assert tuple(got) == (50_000, 0) and len(tables) == 2


def test_compose(scene):
    pair = (scene.df, scene.format)
    both, _ = compose.merge_scenes([pair, pair], deduplicate_threshold=1e-6)
    assert both.count() == N and both.select("scene_id").distinct().count() == 1
    moved, _ = compose.compose_with_transforms([pair, pair], [None, TransformValues.from_translation(100, 0, 0)])
    assert moved.count() == 2 * N
    for bad in (lambda: compose.concatenate([]), lambda: compose.compose_with_transforms([pair], []), lambda: compose.concatenate([pair, (scene.df, SceneFormat(rgb=False))])):
        with pytest.raises(ValueError):
            bad()
    extra, _ = compose.concatenate([pair, (scene.df.withColumn("more", F.lit(1)), scene.format)])
    assert extra.filter("more is null").count() == N


def test_pipelines(scene):
    p = Pipeline().brightness(1.2).brightness(0.5).translate((1, 0, 0)).scale((1.0, 2.0, 3.0)).min_opacity(0.3).outside_sphere(1.0).center_at_origin()
    assert [n for n, _ in p.merged()] == ["color", "transform", "scale_nonuniform", "filter", "center_at_origin"]
    exact = Pipeline(merge=False).min_opacity(0.3).outside_sphere(1.0)
    assert gids(exact(scene)) == gids(scene.filter_min_opacity(0.3).filter_outside_sphere(1.0)) and isinstance(exact, Stage)
    assert p(scene).df.count() > 0 and Pipeline()(scene) is scene
    g = GroupedPipeline().brightness(1.2).within_sphere((0.0, 0.0, 0.0), 2.0).min_opacity(0.9).rotate_euler((0.0, 0.0, 1.0)).normalize_scale(1.0)
    assert g.order == ("color", "filter", "transform")
    assert gids(g(scene, "or")) == gids(scene.filter_within_sphere(2.0)) | gids(scene.filter_min_opacity(0.9))


def test_ply(spark, scene, tmp_path, monkeypatch):
    df = scene.df.withColumn("shn", F.array(*[F.struct(F.col("r").alias("r"), F.col("x").alias("g"), (F.col("b") * k).alias("b")) for k in (1, 2)]))
    want = rows(df, *COLS).astype(np.float32)
    bands = rows(df.select("gid", *[F.col("shn")[k][c].alias(f"{k}{c}") for k in (0, 1) for c in "rgb"]), *[f"{k}{c}" for k in (0, 1) for c in "rgb"]).astype(np.float32)
    parts = ply.write_ply(Scene(df, scene.format), str(tmp_path / "parts"), one_file=True)
    (file,) = ply.save_parts(parts, str(tmp_path / "one"))
    many = ply.save_parts(ply.write_ply(Scene(df, scene.format), str(tmp_path / "more")), str(tmp_path / "many"))
    assert sum(ply.parse_header(open(f, "rb").read())[1] for f in many) == N
    monkeypatch.setattr(ply, "RANGE_ROWS", 70)  # the tasks get it by value, with the function
    for split in (1 << 20, 100):
        back = ply.read_ply(spark, file, scene.format, split_bytes=split)
        assert np.array_equal(rows(back, *COLS), want)
        assert np.array_equal(rows(back.df.select("gid", *[F.col("shn")[k][c].alias(f"{k}{c}") for k in (0, 1) for c in "rgb"]), *[f"{k}{c}" for k in (0, 1) for c in "rgb"]), bands)
    exported = ply.export_ply(scene, f"file://{tmp_path}/out")
    assert exported.agg(F.sum("n")).first()[0] == N == ply.read_ply(spark, f"{tmp_path}/out", scene.format).df.count()
    assert ply.read_ply(spark, f"{tmp_path}/out", scene.format).df.filter("shn is not null").count() == 0
    empty = ply.save_parts(ply.write_ply(Scene(scene.df.limit(0), scene.format), str(tmp_path / "none"), one_file=True), str(tmp_path / "empty"))
    assert ply.read_ply(spark, empty[0]).df.count() == 0
    with pytest.raises(ValueError):
        ply.parse_header(b"obj\n")


def test_ply_ranges_are_shared(spark, scene, tmp_path):
    """Ranges of one large file lie in several partitions."""
    big = scene.df.crossJoin(spark.range(60).select(F.col("id").alias("k"))).withColumn("gid", F.col("gid") + F.col("k") * N).drop("k")
    (file,) = ply.save_parts(ply.write_ply(Scene(big, scene.format), str(tmp_path / "p"), one_file=True), str(tmp_path / "f"))
    got = list(ply._ranges([pd.DataFrame({"path": [file]})]))
    assert sum(int(g["n"].sum()) for g in got) == 60 * N
    cut = pd.DataFrame({"path": [file, file], "first": [0, 9000], "n": [9000, 9000]})
    back = pd.concat(list(ply._read_ranges([cut])))
    assert len(back) == 60 * N and back["gid"].tolist() == list(range(60 * N))
    assert ply.read_ply(spark, file, scene.format, split_bytes=1000).df.agg(F.sum("gid")).first()[0] == 60 * N * (60 * N - 1) // 2


def test_tables(scene):
    x = F.col("x")
    got = rows(scene.df.select("gid", sc.linear_interp(x, (0, 1, 2), (0, 10, 0)).alias("l"), sc.nearest(x, (-1, 0, 1), (5, 6, 7)).alias("n")), "l", "n")
    xs = rows(scene, "x")[:, 0]
    assert np.allclose(got[:, 0], np.where(xs < 1, xs * 10, 10 - (xs - 1) * 10), atol=1e-5)
    assert np.allclose(got[:, 1], np.array([5, 6, 7])[np.abs(xs[:, None] - [-1, 0, 1]).argmin(1)])


_FILED = (*POS, *SCALE, *QUAT, OPACITY, *RGB)


def test_ply_source(spark, scene, tmp_path):
    ply_source.register(spark)
    file = f"file://{tmp_path}/one/scene.ply"
    assert ply_source.write_one_file(scene, file) == N
    read = spark.read.format("ply").option("rangeRows", 60)
    back, want = read.load(file).orderBy("gid").toPandas(), scene.df.orderBy("gid").toPandas()
    assert len(back) == N and all(np.allclose(back[c], want[c]) for c in (*POS, *SCALE, OPACITY, *RGB))
    assert ply.read_ply(spark, f"{tmp_path}/one", scene.format).df.count() == N
    some = spark.read.format("ply").schema("gid bigint, y float").option("rangeRows", 60).load(file)
    assert some.columns == ["gid", "y"] and some.rdd.getNumPartitions() == -(-N // 60)
    few = read.load(file).filter("gid >= 50 and gid < 70")
    assert [r.gid for r in few.select("gid").orderBy("gid").collect()] == list(range(50, 70)) and few.rdd.getNumPartitions() == 1
    # a folder of parts: appended, replaced, and nothing left of a write that fails
    folder, rows = f"file://{tmp_path}/parts", scene.df.select(*_FILED)
    for mode, n in (("append", N), ("append", 2 * N), ("overwrite", N)):
        rows.repartition(3).write.format("ply").mode(mode).save(folder)
        assert spark.read.format("ply").load(folder).count() == n
    with pytest.raises(Exception):
        rows.repartition(2).withColumn("x", F.when(F.col("x") > -1e9, F.raise_error(F.lit("no"))).cast("float")).write.format("ply").mode("append").save(folder)
    assert spark.read.format("ply").load(folder).count() == N and not [p for p in (tmp_path / "parts").iterdir() if p.name.startswith("_")]
    with pytest.raises(Exception, match="needs"):
        rows.drop("x").write.format("ply").mode("append").save(folder)
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("ply").schema("foo float").load(folder).count()
    bands = scene.df.withColumn("rest", F.array(*[F.lit(float(k)) for k in range(9)]))
    bands.select(*_FILED, "rest").write.format("ply").mode("append").save(f"{folder}3")
    one = ply_source.read_scene(spark.read.format("ply").load(f"{folder}3"), scene.format).df.first()
    assert [tuple(b) for b in one[BANDS]] == [(0, 1, 2), (3, 4, 5), (6, 7, 8)]


@pytest.mark.parametrize("angle", [0.0, 1e-300, 1e-9, 1e-4, 1.0, math.pi - 1e-9, math.pi])
def test_axis_angle_there_and_back(spark, angle):
    axis = np.array([0.6, -0.64, 0.48])
    q = rot.axis_angle_to_quaternion(axis * angle) if angle >= 1e-8 else np.concatenate([[1.0], axis * angle / 2])
    rows = spark.createDataFrame([tuple(map(float, s * k * q)) for s in (1, -1) for k in (1, 3)], list(QUAT))
    got = [rot.quaternion_to_axis_angle(s * 3 * q) for s in (1, -1)] + [list(r) for r in rows.select(rot.axis_angle_columns(list(map(F.col, QUAT)))).collect()]
    for v in got:
        v = np.array(v) * (-1 if angle > 3.14159265 and v[0] < 0 else 1)  # a half turn has two axes
        assert v == pytest.approx(axis * angle, abs=1e-12, rel=1e-7)
    assert rot.axis_angle_to_rotation_matrix(rot.rotation_matrix_to_axis_angle(rot.axis_angle_to_rotation_matrix(axis * angle))) == pytest.approx(rot.axis_angle_to_rotation_matrix(axis * angle), abs=1e-7)
    zero = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0)], list(QUAT)).select(rot.axis_angle_columns(list(map(F.col, QUAT)))).first()
    assert list(zero) == [None] * 3


def test_normal_equations_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=(50, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])).unionByName(spark.createDataFrame([(None, 1.0), (math.nan, 1.0)], "a double, b double"))
    f = lambda p, a, b, exp, sin: [exp(a * p["u"]) - b * p["v"], sin(b * p["u"]) + a]
    p = {"u": 0.3, "v": -1.2}
    jj, g, rr, n = learn.normal_equations(df, lambda rows, q: (rows, f(q, F.col("a"), F.col("b"), F.exp, F.sin)), p)
    a, b = x.T
    r = np.concatenate(f(p, a, b, np.exp, np.sin))
    j = np.stack([np.concatenate([a * np.exp(0.3 * a), b * np.cos(0.3 * b)]), np.concatenate([-b, 0 * b])], 1)
    assert n == 50 and rr == pytest.approx(r @ r) and g == pytest.approx(j.T @ r, rel=1e-6) and jj == pytest.approx(j.T @ j, rel=1e-6)


@pytest.mark.parametrize("shape", ["sphere", "box", "ellipsoid"])
def test_fit_shape(spark, shape):
    """Shifted, turned shapes are found again from soft weights."""
    p = np.random.default_rng(4).normal(size=(400, 3)) * 1.5
    df = spark.createDataFrame(pd.DataFrame(p, columns=POS).assign(opacity=0.5, sx=0.1, sy=0.1, sz=0.1)).repartition(2).cache()
    true = learn.SoftShape(shape=shape, center=(0.3, -0.2, 0.1), radius=1.4, radii=(1.5, 1.0, 2.0), rotation=(0.2, -0.1, 0.3) if shape == "ellipsoid" else (0.0, 0.0, 0.0), sharpness=4.0)
    start = learn.SoftShape(shape=shape, radius=1.0, radii=(1.3, 1.2, 1.7), sharpness=4.0)
    got, least = learn.fit_shape(df, true.weight(), start, {"sphere": ("center", "radius"), "box": ("center", "radii"), "ellipsoid": ("center", "radii", "rotation")}[shape], steps=10)
    assert least < 1e-8 and got.center == pytest.approx(true.center, abs=1e-3)
    assert (got.radius == pytest.approx(1.4, abs=1e-3)) if shape == "sphere" else (got.radii == pytest.approx(true.radii, abs=1e-3) and got.rotation == pytest.approx(true.rotation, abs=1e-3))


def method_sizes(spark, monkeypatch, run):
    """Bytes of the longest method that Spark generates for each aggregate that is asked for: the JVM
    doesn't compile those of more than 8,000, and interprets them instead."""
    kind, sizes = type(spark.range(1)), []

    def first(df, ask=kind.first):
        with contextlib.redirect_stdout(io.StringIO()) as text:
            df.explain("codegen")
        sizes.extend(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())))
        return ask(df)

    monkeypatch.setattr(kind, "first", first)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sizes
    return sizes


def test_fit_shape_compiles(spark, scene, monkeypatch):
    true = learn.SoftShape(shape="ellipsoid", center=(0.3, -0.2, 0.1), radii=(1.5, 1.0, 2.0))
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("l_quantity / 5 - 5 AS x", "l_extendedprice / 10500 - 5 AS y", "l_discount * 100 - 5 AS z")
    assert max(method_sizes(spark, monkeypatch, lambda: learn.fit_shape(rows, true.weight(), learn.SoftShape(shape="ellipsoid"), steps=1))) < 8000
    more = learn.SoftShape(0.2, 0.9, "ellipsoid"), ("opacity", "scale", "center", "radii", "rotation", "opacity_sharpness", "scale_sharpness", "sharpness")
    assert max(method_sizes(spark, monkeypatch, lambda: learn.fit_shape(scene.df, F.lit(0.5), *more, steps=1))) < 8000


@pytest.mark.parametrize("shape", ["sphere", "box", "ellipsoid"])
def test_slopes_of_shapes(spark, shape):
    """Against differences; no slope at the center and none at an infinite distance, and no weight of nulls."""
    p = np.random.default_rng(6).normal(size=(60, 6))
    df = spark.createDataFrame(pd.DataFrame(p, columns=[*POS, *SCALE]).assign(opacity=0.4)).cache()
    turned = learn.SoftShape(0.3, 0.6, shape, (0.1, -0.2, 0.3), 1.2, (1.1, 0.8, 1.5), (0.2, 0.5, -0.4), 7.0, 5.0, 4.0)
    flat = learn._flat(turned, tuple(vars(turned).keys() - {"shape"}))
    made, weight, slopes = turned.slopes(df)
    assert flat.keys() - slopes.keys() == ({"radii.0", "radii.1", "radii.2"} if shape == "sphere" else {"radius"})
    by = lambda k: [learn._filled(turned, {k: flat[k] + d}).weight() for d in (1e-6, -1e-6)]
    got = made.select((weight - turned.weight()).alias("same"), *[c.alias(k.replace(".", "")) for k, c in slopes.items()]).toPandas()
    assert got["same"].to_numpy() == pytest.approx(0, abs=1e-12)
    for k in slopes:
        more, less = by(k)
        assert got[k.replace(".", "")].to_numpy() == pytest.approx(df.select(((more - less) / 2e-6).alias("d")).toPandas()["d"].to_numpy(), abs=1e-8)
    odd = spark.createDataFrame([(0.0, 0.0, 0.0), (math.inf, 0.0, 0.0), (None, None, None)], "x double, y double, z double")
    made, weight, slopes = learn.SoftShape(shape=shape).slopes(odd)
    center, far, null = map(tuple, made.select(weight, *[slopes[f"center.{k}"] for k in range(3)], slopes["sharpness"], slopes["radius" if shape == "sphere" else "radii.0"]).collect())
    assert far == (0.0,) * 6 and null[0] is None and (shape == "box" or center[1:4] == (0.0, 0.0, 0.0))


def test_fit_chain(spark, scene):
    """Colour, opacity and a move fitted together give the targets again."""
    v = ColorValues(brightness=1.1), OpacityValues(0.7), TransformValues.from_translation(1.0, 0.0, -2.0)
    done = scene.color(v[0]).opacity(v[1]).transform(v[2]).df.select("gid", *[F.col(c).alias(f"to_{c}") for c in (*POS, OPACITY, *RGB)])
    rows = scene.df.join(done, "gid").cache()
    fields = {"color": ("brightness",), "opacity": ("scale",), "transform": ("translation",)}
    got, least = learn.fit_chain(rows, {c: f"to_{c}" for c in (*POS, OPACITY, *RGB)}, ColorValues(), OpacityValues(0.9), TransformValues(), fields, scene.format, steps=6)
    assert least < 1e-6 and got[0].brightness == pytest.approx(1.1, abs=1e-3) and got[1].scale == pytest.approx(0.7, abs=1e-3) and got[2].translation == pytest.approx((1, 0, -2), abs=1e-3)


def test_fit_chain_compiles(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("l_quantity / 5 AS x", "l_extendedprice / 10500 AS y", "l_discount * 100 AS z", "l_quantity / 50 AS opacity", "l_discount * 10 AS r", "l_tax * 12.5 AS g", "l_tax AS b", "1 + l_tax AS goal")
    fit = lambda: learn.fit_chain(rows, {c: "goal" for c in (*POS, OPACITY, *RGB)}, ColorValues(), OpacityValues(0.9), TransformValues(), steps=1)
    assert max(method_sizes(spark, monkeypatch, fit)) < 8000


def test_slopes_of_chains(spark, scene, monkeypatch):
    """Residuals against the scene's own operators, and slopes against differences of them."""
    asked, kept = {}, (*QUAT, *SCALE, *RGB, OPACITY, *POS)
    monkeypatch.setattr(learn, "least_squares", lambda rows, residuals, start, **_: asked.update(rows=rows, residuals=residuals) or (start, 0.0))
    about = {"rotation": tuple(rot.axis_angle_to_quaternion([0.1, 0.2, -0.3]).tolist()), "translation": (1.0, 0.0, -2.0), "center": (0.1, 0.2, 0.3)}
    start = ColorValues(saturation=0.9), OpacityValues(0.7), TransformValues((1.2, 0.9, 1.1), **about)
    learn.fit_chain(scene.df.withColumns({f"to_{c}": F.col(c) * 0.5 for c in kept}), {c: f"to_{c}" for c in kept}, *start, {"color": ("brightness",), "opacity": ("scale",), "transform": ("rotation", "translation")}, scene.format)
    at = {"color:brightness": 1.2, "opacity:scale": 0.8, "transform:translation.1": 1.1, "turn:0": 0.0, "turn:1": 0.1, "turn:2": 0.0}

    def direct(p):
        turn = rot.quaternion_multiply(rot.axis_angle_to_quaternion([p[f"turn:{i}"] for i in range(3)]), about["rotation"])
        moved = TransformValues((1.2, 0.9, 1.1), **about | {"rotation": tuple(turn.tolist()), "translation": (1.0, p["transform:translation.1"], -2.0)})
        done = scene.color(ColorValues(brightness=p["color:brightness"], saturation=0.9)).opacity(OpacityValues(p["opacity:scale"])).transform(moved)
        return (rows(done, *kept) - rows(scene, *kept) * 0.5).ravel()

    jj, g, rr, n = learn.normal_equations(asked["rows"], asked["residuals"], at)
    r, j = direct(at), np.stack([(direct({**at, k: v + 1e-5}) - direct({**at, k: v - 1e-5})) / 2e-5 for k, v in at.items()], 1)
    assert n == N and rr == pytest.approx(r @ r) and g == pytest.approx(j.T @ r, rel=1e-6, abs=1e-5) and jj == pytest.approx(j.T @ j, rel=1e-6, abs=1e-5)


def test_fit_of_scale_begins_at_none(spark, scene):
    df = scene.df.withColumns({f"to_{c}": F.col(c) * k for c, k in zip(POS, (1.5, 1.0, 0.5))})
    (_, _, got), least = learn.fit_chain(df, {c: f"to_{c}" for c in POS}, transform=TransformValues(), params={"transform": ("scale",)}, steps=5)
    assert got.scale == pytest.approx((1.5, 1.0, 0.5), abs=1e-6) and least < 1e-12


def test_sum_of_many(spark):
    from splatarium.plans import catalog

    df = spark.range(0, 2_000_000, 1, 1).select((F.lit(0.1) + F.col("id") * 0).alias("v"))
    assert df.select(catalog._sum_of_many(F.col("v"))).first()[0] == pytest.approx(200_000, abs=1e-9)
    odd = spark.createDataFrame([(1, 1e300), (1, None), (2, math.inf), (2, math.inf), (3, math.nan), (3, 1.0)], "k int, v double")
    assert [repr(r[1]) for r in odd.groupBy("k").agg(catalog._sum_of_many(F.col("v"))).orderBy("k").collect()] == ["1e+300", "inf", "nan"]


def test_protocols():
    from splatarium.plans import protocols

    kinds = (protocols.PipelineStage, protocols.ColorProcessor, protocols.TransformProcessor, protocols.FilterProcessor)
    fits = lambda stage: [isinstance(stage, k) for k in kinds]
    assert fits(colour.Color()) == [True, True, False, False] and fits(transform.Transform()) == [True, False, True, False]
    assert fits(Tests())[1:] == [False, False, True] and fits(lambda df: df) == [False] * 4


@pytest.mark.parametrize("bins, sigma", [(1, None), (8, 0.3), (64, None), (256, 0.01)])
def test_soft_histogram(spark, bins, sigma):
    """Against every row's weight in every bin, with values far outside."""
    g = np.random.default_rng(bins)
    v = np.concatenate([g.random(300), g.normal(size=100), [1e6, -1e6, 0.0, 1.0]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(2)
    got = stats.soft_histogram(df, {"a": F.col("v"), "far": F.col("v") + 1e9}, bins, sigma=sigma).toPandas().sort_values(["channel", "bin"])
    centers, s = (np.arange(bins) + 0.5) / bins, sigma or 0.5 / bins
    w = np.exp(-(((v[:, None] - centers) / s) ** 2) / 2).sum(0)
    assert got[got.channel == "a"].bin.tolist() == list(range(bins))
    assert got[got.channel == "a"].weight.to_numpy() == pytest.approx(w / (w.sum() + 1e-8), abs=1e-11)
    assert got[got.channel == "far"].weight.tolist() == [0.0] * bins
