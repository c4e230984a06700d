"""Named parameter records, and records as JSON files."""

from __future__ import annotations

import json
from pathlib import Path

from .values import ColorValues as C
from .values import FilterValues, OpacityValues, TransformValues, from_dict, to_dict

_k = C.from_k

# The published looks.
COLOR_PRESETS: dict[str, C] = {
    "warm": _k(3200),
    "cool": _k(8500),
    "neutral": C(),
    "cinematic": _k(4500) + C(contrast=1.1, saturation=0.9, shadows=0.1, highlights=-0.05),
    "vibrant": C(saturation=1.3, vibrance=1.2, brightness=1.05),
    "muted": C(saturation=0.7, vibrance=0.8, contrast=0.95),
    "dramatic": C(contrast=1.25, shadows=0.15, highlights=-0.1),
    "vintage": _k(4000) + C(saturation=0.8, contrast=0.9, gamma=1.1),
    "golden_hour": _k(3000) + C(brightness=1.1, saturation=1.1, shadows=0.05),
    "moonlight": _k(9000) + C(brightness=0.8, contrast=1.1, saturation=0.85),
    "kodak_portra": _k(5200) + C(saturation=1.05, contrast=0.95, shadows=0.08, highlights=-0.03, shadow_tint_hue=-20, shadow_tint_sat=0.15),
    "fuji_velvia": C(saturation=1.4, vibrance=1.3, contrast=1.15, brightness=1.02, shadows=0.1),
    "kodak_ektachrome": _k(5800) + C(saturation=1.2, contrast=1.1, brightness=1.05, highlights=-0.05),
    "ilford_hp5": C(saturation=0.0, contrast=1.2, gamma=1.05, shadows=0.12, highlights=-0.08),
    "cinestill_800t": _k(3200) + C(saturation=1.15, contrast=0.95, highlights=-0.1, highlight_tint_hue=180, highlight_tint_sat=0.25),
    "spring_fresh": _k(6000) + C(brightness=1.08, saturation=1.15, vibrance=1.2, shadows=0.05, shadow_tint_hue=120, shadow_tint_sat=0.1),
    "summer_bright": _k(6500) + C(brightness=1.12, saturation=1.25, vibrance=1.15, contrast=1.05, fade=0.05),
    "autumn_warm": _k(3500) + C(saturation=1.2, contrast=1.08, shadows=0.08, hue_shift=10),
    "winter_cold": _k(8000) + C(brightness=0.95, saturation=0.85, contrast=1.15, shadows=0.1, tint=-0.1),
    "sunrise": _k(2800) + C(brightness=1.05, saturation=1.15, shadows=0.15, highlights=-0.05, shadow_tint_hue=-140, shadow_tint_sat=0.2),
    "midday_sun": _k(5500) + C(brightness=1.1, contrast=1.1, saturation=1.05),
    "sunset": _k(2500) + C(brightness=1.08, saturation=1.2, shadows=0.1, highlight_tint_hue=25, highlight_tint_sat=0.3),
    "blue_hour": _k(12000) + C(brightness=0.85, saturation=1.15, contrast=1.05, tint=-0.15),
    "overcast": _k(7000) + C(saturation=0.9, contrast=0.95, brightness=0.98),
    "high_key": C(brightness=1.15, contrast=0.85, saturation=0.9, fade=0.15, highlights=-0.1),
    "low_key": C(brightness=0.85, contrast=1.35, saturation=0.95, shadows=0.2, highlights=-0.15),
    "teal_orange": C(saturation=1.2, contrast=1.1, shadow_tint_hue=180, shadow_tint_sat=0.3, highlight_tint_hue=30, highlight_tint_sat=0.25),
    "bleach_bypass": C(saturation=0.5, contrast=1.3, brightness=1.05, highlights=-0.15),
    "cross_process": C(saturation=1.4, contrast=1.2, hue_shift=15, shadow_tint_hue=120, shadow_tint_sat=0.2, highlight_tint_hue=-120, highlight_tint_sat=0.15),
    "faded_print": C(saturation=0.75, contrast=0.9, fade=0.12, gamma=1.08),
    "sepia_tone": C(saturation=0.2, temperature=0.4, tint=0.1, contrast=0.95, gamma=1.05),
    "lift_shadows": C(shadows=0.2, brightness=1.02),
    "compress_highlights": C(highlights=-0.2, contrast=1.05),
    "boost_midtones": C(gamma=0.9, contrast=1.05),
    "increase_contrast": C(contrast=1.3, shadows=0.1, highlights=-0.1),
    "decrease_contrast": C(contrast=0.8, gamma=1.1),
    "desaturate_mild": C(saturation=0.7),
    "desaturate_strong": C(saturation=0.3),
    "enhance_colors": C(saturation=1.25, vibrance=1.3, contrast=1.08),
}
#: The published opacity changes.
OPACITY_PRESETS: dict[str, OpacityValues] = {
    "fade_subtle": OpacityValues.fade(0.9),
    "fade_mild": OpacityValues.fade(0.8),
    "fade_moderate": OpacityValues.fade(0.7),
    "fade_strong": OpacityValues.fade(0.5),
    "fade_heavy": OpacityValues.fade(0.3),
    "boost_subtle": OpacityValues.boost(1.1),
    "boost_mild": OpacityValues.boost(1.2),
    "boost_moderate": OpacityValues.boost(1.3),
    "boost_strong": OpacityValues.boost(1.5),
    "ghost_effect": OpacityValues.fade(0.2),
    "translucent": OpacityValues.fade(0.6),
    "semi_transparent": OpacityValues.fade(0.4),
}
#: The published filters.
FILTER_PRESETS: dict[str, FilterValues] = {
    "strict": FilterValues(min_opacity=0.5, max_scale=1.0, sphere_radius=10.0),
    "quality": FilterValues(min_opacity=0.3, max_scale=2.0),
    "cleanup": FilterValues(min_opacity=0.1, max_scale=5.0),
}
#: The published transforms.
TRANSFORM_PRESETS: dict[str, TransformValues] = {
    "double_size": TransformValues.from_scale(2.0),
    "half_size": TransformValues.from_scale(0.5),
    "flip_x": TransformValues.from_rotation_euler(0, 180, 0),
    "flip_y": TransformValues.from_rotation_euler(180, 0, 0),
    "flip_z": TransformValues.from_rotation_euler(0, 0, 180),
}
#: The looks of the step-by-step pipeline, which take a strength.
STEP_PRESETS: dict[str, C] = {
    "cinematic": C(brightness=1.05, contrast=1.15, saturation=0.95, gamma=0.92, temperature=0.05),
    "warm": C(brightness=1.1, temperature=0.3, saturation=1.1, vibrance=1.2),
    "cool": C(brightness=0.95, temperature=-0.2, saturation=0.9, contrast=1.05),
    "vibrant": C(saturation=1.3, vibrance=1.4, contrast=1.1, brightness=1.05),
    "muted": C(saturation=0.7, contrast=0.9, brightness=0.95, gamma=1.1),
    "dramatic": C(contrast=1.3, saturation=1.15, gamma=0.85, vibrance=1.2),
}


def _get(presets: dict, name: str):
    try:
        return presets[name.lower()]
    except KeyError:
        raise KeyError(f"no preset {name!r}; there are {', '.join(presets)}") from None


def get_color_preset(name: str) -> C:
    return _get(COLOR_PRESETS, name)


def get_opacity_preset(name: str) -> OpacityValues:
    return _get(OPACITY_PRESETS, name)


def get_filter_preset(name: str) -> FilterValues:
    return _get(FILTER_PRESETS, name)


def get_transform_preset(name: str) -> TransformValues:
    return _get(TRANSFORM_PRESETS, name)


def save_json(record, path: str) -> None:
    Path(path).write_text(json.dumps(to_dict(record), indent=2))


def load_json(kind: type, path: str):
    return from_dict(kind, json.loads(Path(path).read_text()))
