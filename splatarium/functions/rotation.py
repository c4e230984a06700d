"""Rotations: quaternions (w, x, y, z), matrices, axis-angle and Euler angles.

The first half works on the driver with numpy, for parameters; the second half
gives the same as Columns, for a quaternion in every row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0)
#: Row i of the Hamilton product: (sign, index into p, index into q) of its four terms.
_HAMILTON = (
    ((1, 0, 0), (-1, 1, 1), (-1, 2, 2), (-1, 3, 3)),
    ((1, 0, 1), (1, 1, 0), (1, 2, 3), (-1, 3, 2)),
    ((1, 0, 2), (-1, 1, 3), (1, 2, 0), (1, 3, 1)),
    ((1, 0, 3), (1, 1, 2), (-1, 2, 1), (1, 3, 0)),
)


def quaternion_identity() -> np.ndarray:
    return np.array(IDENTITY)


def normalize_quaternion(q) -> np.ndarray:
    q = np.asarray(q, float)
    with np.errstate(invalid="ignore", divide="ignore"):
        return q / np.linalg.norm(q, axis=-1, keepdims=True)


def quaternion_multiply(p, q) -> np.ndarray:
    """Hamilton product; either side may be one quaternion or rows of them."""
    p, q = np.asarray(p, float), np.asarray(q, float)
    return np.stack([sum(s * p[..., i] * q[..., j] for s, i, j in row) for row in _HAMILTON], axis=-1)


def quaternion_to_rotation_matrix(q) -> np.ndarray:
    """R = (w^2 - v.v) I + 2 v v^T + 2 w [v]x for the normalised quaternion."""
    w, *v = normalize_quaternion(q)
    v = np.array(v)
    return (w * w - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * w * _cross(v)


def _cross(v) -> np.ndarray:
    x, y, z = v
    return np.array([[0.0, -z, y], [z, 0.0, -x], [-y, x, 0.0]])


def rotation_matrix_to_quaternion(r) -> np.ndarray:
    """The eigenvector of the largest eigenvalue of the symmetric 4x4 matrix
    that belongs to r. Its sign: w > 0 if the trace is, else the largest part."""
    r = np.asarray(r, float)[:3, :3]
    k = np.zeros((4, 4))
    k[0, 0] = np.trace(r)
    k[0, 1:] = k[1:, 0] = [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]
    k[1:, 1:] = r + r.T - np.trace(r) * np.eye(3)
    q = np.linalg.eigh(k)[1][:, -1]
    lead = 0 if np.trace(r) > 0 else 1 + int(np.argmax(np.diag(r)))
    return q if q[lead] >= 0 else -q


def axis_angle_to_quaternion(axis_angle) -> np.ndarray:
    """axis times angle in radians; a vector shorter than 1e-8 is no rotation."""
    v = np.asarray(axis_angle, float)
    angle = np.linalg.norm(v)
    if angle < 1e-8:
        return quaternion_identity()
    return np.concatenate([[np.cos(angle / 2)], np.sin(angle / 2) * v / angle])


def quaternion_to_axis_angle(q) -> np.ndarray:
    """The logarithm of a rotation: its axis times its angle from 0 to pi. The half angle comes
    from both parts of the quaternion, so it is exact near 0 and near pi as well."""
    w, *v = normalize_quaternion(q)
    v = np.array(v) * (-1.0 if w < 0 else 1.0)
    s = np.linalg.norm(v)
    return v * (2 * np.arctan2(s, abs(w)) / s if s > 0 else 2.0)


def rotation_matrix_to_axis_angle(r) -> np.ndarray:
    return quaternion_to_axis_angle(rotation_matrix_to_quaternion(r))


def axis_angle_to_rotation_matrix(axis_angle) -> np.ndarray:
    return np.eye(3) if axis_angle is None else quaternion_to_rotation_matrix(axis_angle_to_quaternion(axis_angle))


def euler_to_quaternion(euler, order: str = "XYZ") -> np.ndarray:
    """Radians about x, then y, then z; no other order is known."""
    if order != "XYZ":
        raise ValueError(f"order {order!r} is not supported, only 'XYZ'")
    x, y, z = (axis_angle_to_quaternion(a * e) for a, e in zip(np.asarray(euler, float), np.eye(3)))
    return quaternion_multiply(z, quaternion_multiply(y, x))


def quaternion_to_euler(q) -> np.ndarray:
    w, x, y, z = np.moveaxis(np.asarray(q, float), -1, 0)
    pitch = np.clip(2 * (w * y - z * x), -1.0, 1.0)
    return np.stack([np.arctan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), np.arcsin(pitch), np.arctan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))], axis=-1)


def axis_angle_of(axis, angle: float) -> np.ndarray:
    """axis and angle as one vector; an axis of length 0 is +z."""
    axis = np.asarray(axis, float)
    n = np.linalg.norm(axis)
    return (axis / n if n > 1e-12 else np.array([0.0, 0.0, 1.0])) * angle


# ------------------------------------------------------------------ columns


def linear(matrix, columns, offset=(0.0, 0.0, 0.0)) -> list[Column]:
    """matrix @ columns + offset; terms with a factor 0 are left out."""
    out = []
    for row, add in zip(np.asarray(matrix, float), offset):
        terms = [c if m == 1 else c * float(m) for m, c in zip(row, columns) if m != 0]
        if add != 0 or not terms:
            terms.append(F.lit(float(add)))
        out.append(sum(terms[1:], terms[0]))
    return out


def multiply_columns(p, q) -> list[Column]:
    """Hamilton product of four columns or numbers with four columns."""
    out = []
    for row in _HAMILTON:
        terms = [p[i] * q[j] * s if s < 0 else p[i] * q[j] for s, i, j in row if not (isinstance(p[i], float) and p[i] == 0)]
        out.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return out


def rotate_quaternions(q, columns) -> list[Column]:
    """The rotation q applied before each row's quaternion."""
    return multiply_columns([float(v) for v in q], columns)


def normalize_columns(columns, least: float = 0.0) -> list[Column]:
    """Unit quaternions; null where the norm is not above `least`."""
    norm = F.sqrt(sum((c * c for c in columns[1:]), columns[0] * columns[0]))
    return [F.when(norm > least, c / norm) for c in columns]


def matrix_columns(columns) -> list[list[Column]]:
    """The rotation matrix of each row's quaternion, as nine columns."""
    w, *v = normalize_columns(columns)
    sign = {(0, 1): (-1, 2), (0, 2): (1, 1), (1, 0): (1, 2), (1, 2): (-1, 0), (2, 0): (-1, 1), (2, 1): (1, 0)}
    vv = v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    cell = lambda i, j: (w * w - vv + v[i] * v[i] * 2) if i == j else (v[i] * v[j] + w * v[sign[i, j][1]] * sign[i, j][0]) * 2
    return [[cell(i, j) for j in range(3)] for i in range(3)]


def euler_columns(columns) -> list[Column]:
    """Radians about x, y, z of each row's quaternion."""
    w, x, y, z = columns
    pitch = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (w * y - z * x) * 2))
    return [F.atan2((w * x + y * z) * 2, 1 - (x * x + y * y) * 2), F.asin(pitch), F.atan2((w * z + x * y) * 2, 1 - (y * y + z * z) * 2)]


def axis_angle_columns(columns) -> list[Column]:
    """Axis times angle of each row's quaternion; a quaternion and its negative give the same."""
    w, *v = columns
    s = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    norm = F.sqrt(w * w + s * s)
    k = F.when(s > 0, F.atan2(s, F.abs(w)) * 2 / s).otherwise(F.lit(2.0) / norm) * F.when(w < 0, -1.0).otherwise(1.0)
    return [F.when(norm > 0, c * k) for c in v]
