import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from splatarium.functions import rotation as rot
from splatarium.plans import presets
from splatarium.plans.values import ColorValues, FilterValues, HistogramConfig, OpacityValues, TransformValues, from_dict, specs, to_dict

unit = st.floats(-3, 3, allow_nan=False)
quats = st.tuples(unit, unit, unit, unit).filter(lambda q: np.linalg.norm(q) > 0.1)


def test_color_merge_identity_and_sum():
    a, b = ColorValues(brightness=1.2, temperature=0.3, hue_shift=170), ColorValues(brightness=1.5, temperature=-0.1, hue_shift=20)
    c = a + b
    assert c.brightness == pytest.approx(1.8) and c.temperature == pytest.approx(0.2) and c.hue_shift == pytest.approx(-170)
    assert a + ColorValues() == a and sum([a, b]) == c
    assert ColorValues(brightness=9, fade=-1, hue_shift=500).clamp() == ColorValues(brightness=5, fade=0, hue_shift=180)
    assert ColorValues(shadow_tint_hue=40).is_neutral() and not ColorValues(shadow_tint_sat=0.1).is_neutral()
    assert ColorValues.from_k(6500).is_neutral() and ColorValues.from_k(2000).temperature == 1
    assert ColorValues.from_k(4500).to_k() == pytest.approx(4500) and ColorValues.from_rad(math.pi / 2).to_rad() == pytest.approx(math.pi / 2)


def test_specs():
    s = specs(ColorValues)
    assert len(s) == 15 and s["gamma"].validate(0) == 0.1 and s["fade"].combine(0.1, 0.2) == pytest.approx(0.3) and s["contrast"].is_neutral(1 + 1e-7)


def test_filter_merge_takes_the_stricter():
    a = FilterValues(min_opacity=0.2, sphere_radius=5, box_min=(0, 0, 0), box_max=(4, 4, 4), box_rot=(1, 0, 0), frustum_pos=(0, 0, 0), frustum_far=50)
    b = FilterValues(max_opacity=0.9, sphere_radius=3, sphere_center=(1, 0, 0), box_min=(1, -1, 1), box_max=(3, 3, 2), frustum_pos=(1, 1, 1), frustum_far=20, invert=True)
    c = a + b
    assert (c.min_opacity, c.max_opacity, c.sphere_radius, c.sphere_center, c.invert) == (0.2, 0.9, 3, (1, 0, 0), True)
    assert (c.box_min, c.box_max, c.box_rot) == ((1, 0, 1), (3, 3, 2), None) and c.frustum_pos == (1, 1, 1)
    assert (a + FilterValues()).frustum_pos == (0, 0, 0) and FilterValues().is_neutral() and not FilterValues(invert=True).is_neutral()
    assert FilterValues(frustum_near=0, frustum_far=-1).clamp().frustum_far == pytest.approx(0.002)


@settings(max_examples=40, deadline=None)
@given(quats, quats)
def test_rotations_agree(p, q):
    m = rot.quaternion_to_rotation_matrix(p)
    assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)
    both = rot.quaternion_multiply(rot.normalize_quaternion(p), rot.normalize_quaternion(q))
    assert np.allclose(rot.quaternion_to_rotation_matrix(both), m @ rot.quaternion_to_rotation_matrix(q))
    back = rot.rotation_matrix_to_quaternion(m)
    assert np.allclose(np.abs(back @ rot.normalize_quaternion(p)), 1)


@settings(max_examples=40, deadline=None)
@given(st.floats(-3, 3), st.floats(-1.4, 1.4), st.floats(-3, 3))
def test_euler_round_trip(x, y, z):
    assert np.allclose(rot.quaternion_to_euler(rot.euler_to_quaternion((x, y, z))), (x, y, z), atol=1e-6)


def test_rotation_edges():
    assert np.allclose(rot.axis_angle_to_quaternion((0, 0, 1e-9)), rot.IDENTITY) and np.isnan(rot.normalize_quaternion((0, 0, 0, 0))).all()
    assert np.allclose(rot.axis_angle_of((0, 0, 0), 2.0), (0, 0, 2.0)) and np.allclose(rot.axis_angle_to_rotation_matrix(None), np.eye(3))
    with pytest.raises(ValueError):
        rot.euler_to_quaternion((0, 0, 0), "ZYX")


def test_transform_composition():
    a = TransformValues.from_rotation_euler(10, 20, 30, center=(1, 2, 3))
    b = TransformValues.from_scale(2.0)
    assert np.allclose((a + b).to_matrix(), b.to_matrix() @ a.to_matrix()) and sum([a, b]).scale == pytest.approx((2, 2, 2))
    p = np.array([1, 2, 3, 1.0])
    assert np.allclose(a.to_matrix() @ p, p)  # its center stays
    assert TransformValues().is_neutral() and np.allclose(TransformValues.from_matrix(np.diag([-1, 1, 1, 1])).scale, (1, 1, 1))


def test_opacity_histogram_and_presets(tmp_path):
    assert OpacityValues.fade(2).scale == 1 and OpacityValues.boost(0.5).scale == 1 and (OpacityValues(0.5) + OpacityValues(0.5)).scale == 0.25
    assert HistogramConfig(8, 0, None) + HistogramConfig(16, -1, 2, True) == HistogramConfig(16, -1, 2, True)
    assert (len(presets.COLOR_PRESETS), len(presets.OPACITY_PRESETS), len(presets.FILTER_PRESETS), len(presets.TRANSFORM_PRESETS)) == (39, 12, 3, 5)
    assert presets.get_color_preset("WARM").temperature == pytest.approx((6500 - 3200) / 4500)
    with pytest.raises(KeyError, match="there are"):
        presets.get_filter_preset("none")
    for v in (presets.get_color_preset("teal_orange"), presets.get_filter_preset("strict"), presets.get_transform_preset("flip_x"), FilterValues(box_min=(0, 0, 0), box_max=(1, 1, 1), invert=True)):
        presets.save_json(v, tmp_path / "v.json")
        assert presets.load_json(type(v), tmp_path / "v.json") == v
    assert from_dict(TransformValues, {"euler": [0, 0, 90]}).rotation == pytest.approx((math.sqrt(0.5), 0, 0, math.sqrt(0.5)))
    assert to_dict(ColorValues()) == {}
    with pytest.raises(KeyError):
        from_dict(ColorValues, {"brigthness": 1})
