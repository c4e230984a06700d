"""Geometric transforms: one affine projection for positions, and the matching
change of orientations and scales. Lists of steps fold into one matrix first."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from ..functions import rotation as rot
from ..plans.values import TransformValues
from ..scene_format import POS, QUAT, SCALE, SceneFormat, cols, put


def _affine(df: DataFrame, matrix: np.ndarray, turn, size, fmt: SceneFormat) -> DataFrame:
    """Positions by the matrix; orientations by a quaternion; scales by a factor
    for each axis, which is an addition where scales are logarithms."""
    new = dict(zip(POS, rot.linear(matrix[:3, :3], cols(POS), matrix[:3, 3])))
    if turn is not None and not np.allclose(turn, rot.IDENTITY):
        new |= dict(zip(QUAT, rot.rotate_quaternions(turn, cols(QUAT))))
    size = np.broadcast_to(np.asarray(size, float), (3,))
    if not np.allclose(size, 1):
        new |= {n: c + math.log(s) if fmt.log_scale else c * float(s) for n, c, s in zip(SCALE, cols(SCALE), size)}
    return df.withColumns(new)


def apply_transform(df: DataFrame, v: TransformValues, fmt: SceneFormat = SceneFormat()) -> DataFrame:
    return df if v.is_neutral() else _affine(df, v.to_matrix(), v.rotation, v.scale_vector, fmt)


def apply_matrix(df: DataFrame, matrix, fmt: SceneFormat = SceneFormat(), exact: bool = False) -> DataFrame:
    """A 4x4 matrix. Through scale, rotation and translation, which loses shear;
    or exactly, for positions and orientations, with scales as they are."""
    matrix = np.asarray(matrix, float)
    if exact:
        return _affine(df, matrix, rot.rotation_matrix_to_quaternion(matrix[:3, :3]), 1.0, fmt)
    return apply_transform(df, TransformValues.from_matrix(matrix), fmt)


def translate(df: DataFrame, vector, fmt: SceneFormat = SceneFormat()) -> DataFrame:
    return apply_transform(df, TransformValues.from_translation(*vector), fmt)


def scale_uniform(df: DataFrame, factor: float, fmt: SceneFormat = SceneFormat()) -> DataFrame:
    return apply_transform(df, TransformValues.from_scale(factor), fmt)


def scale_nonuniform(df: DataFrame, factors, fmt: SceneFormat = SceneFormat()) -> DataFrame:
    return apply_transform(df, TransformValues.from_scale(factors), fmt)


def rotate_quaternion(df: DataFrame, q, fmt: SceneFormat = SceneFormat()) -> DataFrame:
    return apply_transform(df, TransformValues(rotation=tuple(rot.normalize_quaternion(q).tolist())), fmt)


def rotate_euler(df: DataFrame, angles, fmt: SceneFormat = SceneFormat(), degrees: bool = True) -> DataFrame:
    return apply_transform(df, (TransformValues.from_rotation_euler if degrees else TransformValues.from_euler_rad)(*angles), fmt)


def rotate_axis_angle(df: DataFrame, axis, angle: float, fmt: SceneFormat = SceneFormat(), degrees: bool = True) -> DataFrame:
    return apply_transform(df, (TransformValues.from_rotation_axis_angle if degrees else TransformValues.from_axis_angle_rad)(axis, angle), fmt)


@dataclass(frozen=True)
class Transform:
    """Steps in the order in which they apply; each method gives a new list.

    Angles are radians unless the name says degrees. A step without a center
    takes the list's, if one is set.
    """

    #: (3x3 matrix, shift, quaternion, scale vector, center or None) of each step.
    steps: tuple = ()
    center: tuple | None = None

    def _with(self, linear=None, shift=(0.0, 0.0, 0.0), turn=rot.IDENTITY, size=(1.0, 1.0, 1.0), center=None) -> Transform:
        linear = np.eye(3) if linear is None else np.asarray(linear, float)
        return replace(self, steps=(*self.steps, (linear, np.asarray(shift, float), np.asarray(turn, float), np.asarray(size, float), center)))

    @classmethod
    def from_srt(cls, scale=1.0, rotation=rot.IDENTITY, translation=(0.0, 0.0, 0.0)) -> Transform:
        return cls().scale(scale).rotate_quat(rotation).translate(translation)

    def translate(self, vector) -> Transform:
        if np.isscalar(vector):
            raise TypeError("a translation has three parts")
        return self._with(shift=vector)

    def rotate_quat(self, q, center=None) -> Transform:
        q = rot.normalize_quaternion(q)
        return self._with(rot.quaternion_to_rotation_matrix(q), turn=q, center=center)

    def rotate_euler(self, angles, center=None) -> Transform:
        return self.rotate_quat(rot.euler_to_quaternion(angles), center)

    def rotate_euler_deg(self, angles, center=None) -> Transform:
        return self.rotate_euler(np.radians(angles), center)

    def rotate_axis_angle(self, axis, angle: float, center=None) -> Transform:
        return self.rotate_quat(rot.axis_angle_to_quaternion(rot.axis_angle_of(axis, angle)), center)

    def rotate_axis_angle_deg(self, axis, angle: float, center=None) -> Transform:
        return self.rotate_axis_angle(axis, math.radians(angle), center)

    def rotate_matrix(self, matrix, center=None) -> Transform:
        return self.rotate_quat(rot.rotation_matrix_to_quaternion(matrix), center)

    def scale(self, factor, center=None) -> Transform:
        size = np.broadcast_to(np.asarray(factor, float), (3,))
        return self._with(np.diag(size), size=size, center=center)

    def matrix(self, matrix) -> Transform:
        """A 4x4 matrix: positions and orientations, not scales."""
        matrix = np.asarray(matrix, float)
        return self._with(matrix[:3, :3], matrix[:3, 3], rot.rotation_matrix_to_quaternion(matrix[:3, :3]))

    def set_center(self, center) -> Transform:
        return replace(self, center=tuple(center))

    def is_identity(self) -> bool:
        return not self.steps

    def compile(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(4x4 matrix, quaternion, scale vector) of all steps."""
        m, turn, size = np.eye(4), rot.quaternion_identity(), np.ones(3)
        for linear, shift, q, s, center in self.steps:
            c = np.asarray(center if center is not None else self.center if self.center is not None else (0.0, 0.0, 0.0), float)
            step = np.eye(4)
            step[:3, :3], step[:3, 3] = linear, shift + c - linear @ c
            m, turn, size = step @ m, rot.quaternion_multiply(q, turn), size * s
        return m, turn, size

    def get_matrix(self) -> np.ndarray:
        return self.compile()[0]

    def __call__(self, df: DataFrame, fmt: SceneFormat = SceneFormat()) -> DataFrame:
        return df if self.is_identity() else _affine(df, *self.compile(), fmt)


def transform_rows(df: DataFrame, rotation_columns) -> DataFrame:
    """Orientations by another quaternion in every row (four column names)."""
    return put(df, QUAT, rot.multiply_columns(cols(rotation_columns), cols(QUAT)))


def axis_angle_to_6d(axis_angle) -> np.ndarray:
    """The first two columns of the rotation matrix, one after the other."""
    return rot.axis_angle_to_rotation_matrix(axis_angle)[:, :2].T.reshape(6)


def rotation_from_6d(six) -> np.ndarray:
    """Gram-Schmidt on both halves, and their cross product."""
    a, b = np.asarray(six, float).reshape(2, 3)
    x = a / np.linalg.norm(a)
    y = b - (x @ b) * x
    y = y / np.linalg.norm(y)
    return np.stack([x, y, np.cross(x, y)], axis=1)
