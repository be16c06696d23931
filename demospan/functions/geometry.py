"""Pixels, cameras, rotations and points as column arithmetic."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import vocab as V


def half_even(x: Column) -> Column:
    """Round half to even, as Python does."""
    return F.bround(x, 0).cast("bigint")


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high) if not isinstance(high, Column) else high), F.lit(low))


def grid_to_pixel(y: Column, x: Column, width, height, grid_width=V.MODEL_GRID, grid_height=V.MODEL_GRID) -> Column:
    """Model grid point (y, x) -> struct(x, y) of a pixel inside the image; null when off the grid."""
    w, h = F.lit(width), F.lit(height)
    on_grid = y.between(0, grid_height) & x.between(0, grid_width)
    return F.when(
        on_grid,
        F.struct(
            clamp(half_even(x / F.lit(float(grid_width)) * w), 0, w - 1).alias("x"),
            clamp(half_even(y / F.lit(float(grid_height)) * h), 0, h - 1).alias("y"),
        ),
    )


def normalized(pixel: Column, size: Column | int) -> Column:
    """Pixel / (size - 1), the online rule."""
    return pixel.cast("double") / F.greatest(F.lit(size) - 1, F.lit(1))


def normalized_by_size(pixel: Column, size: Column | int) -> Column:
    """Pixel / size, the rule of training traces."""
    return pixel.cast("double") / F.lit(size)


def inside_image(x: Column, y: Column, width, height) -> Column:
    return (x >= 0) & (x < F.lit(width)) & (y >= 0) & (y < F.lit(height))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def visible(x: Column, y: Column, depth: Column, width, height) -> Column:
    """Finite, in front of the camera and inside the image."""
    return finite(x) & finite(y) & (depth > V.MIN_DEPTH) & inside_image(x, y, width, height)


def _dot(matrix: Column, row: int, vector: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [matrix[row][i] * v for i, v in enumerate(vector)])


def flip_terms(convention: Column, width, height) -> tuple[Column, Column, Column, Column]:
    """Camera <-> image coordinates as (x scale, x offset, y scale, y offset); each convention undoes
    itself. Unknown conventions give nulls."""
    across = convention.isin(V.HORIZONTAL_FLIP, V.ROTATED_180)
    down = convention == V.ROTATED_180
    known = convention.isin(V.NO_TRANSFORM, V.HORIZONTAL_FLIP, V.ROTATED_180)

    def term(turned: Column, yes, no) -> Column:
        return F.when(known & turned, F.lit(yes).cast("double")).when(known, F.lit(no).cast("double"))

    return term(across, -1, 1), term(across, F.lit(width) - 1, 0), term(down, -1, 1), term(down, F.lit(height) - 1, 0)


def flip(x: Column, y: Column, terms) -> tuple[Column, Column]:
    return x * terms[0] + terms[1], y * terms[2] + terms[3]


def project(x: Column, y: Column, z: Column, matrix, terms):
    """World point -> (image x, image y, depth). ``matrix[i][j]`` gives the entries as columns."""
    point = [x, y, z, F.lit(1.0)]
    depth = _dot(matrix, 2, point)
    over = F.nullif(depth, F.lit(0.0))
    u, v = flip(_dot(matrix, 0, point) / over, _dot(matrix, 1, point) / over, terms)
    return u, v, depth


def reproject(u: Column, v: Column, depth: Column, inverse, terms):
    """Image point and depth -> world (x, y, z); null when the depth is not positive."""
    cx, cy = flip(u, v, terms)
    point = [cx * depth, cy * depth, depth, F.lit(1.0)]
    scale = _dot(inverse, 3, point)
    usable = F.when((depth > 0) & (F.abs(scale) > 1e-12), scale)
    return tuple(_dot(inverse, i, point) / usable for i in range(3))


def pixel_online(x: Column, y: Column, z: Column, matrix, terms, width, height):
    """Rounded pixel inside the image; its centre when the point is not in front of the camera."""
    u, v, depth = project(x, y, z, matrix, terms)
    behind = ~finite(depth) | (depth <= 0)
    w, h = F.lit(width), F.lit(height)
    px = F.when(behind, F.floor(w / 2)).otherwise(half_even(clamp(u, 0, (w - 1).cast("double"))))
    py = F.when(behind, F.floor(h / 2)).otherwise(half_even(clamp(v, 0, (h - 1).cast("double"))))
    return px.cast("bigint"), py.cast("bigint"), depth


class Entries:
    """Matrix entries kept as scalar columns ``<name><row><column>``."""

    def __init__(self, name: str):
        self.name = name

    def __getitem__(self, row: int) -> list[Column]:
        return [F.col(f"{self.name}{row}{c}") for c in range(4)]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def inverse_matrix(matrices: pd.Series) -> pd.Series:
    """Inverse of 4x4 matrices, one Arrow batch at a time. For the camera table: one row per camera."""
    if not len(matrices):
        return pd.Series([], dtype=object)
    stacked = np.array([[list(row) for row in m] for m in matrices], dtype=float)
    return pd.Series(np.linalg.inv(stacked).tolist())


def distance(*differences: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [F.pow(d, F.lit(2.0)) for d in differences]))


def axis_angle(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Quaternion -> rotation vector; w is clipped to [-1, 1] and no rotation gives zeros."""
    c = clamp(w, -1.0, F.lit(1.0))
    length = F.sqrt(1.0 - c * c)
    scale = F.when(length > 1e-9, 2.0 * F.acos(c) / length).otherwise(0.0)
    return F.array(x * scale, y * scale, z * scale)


def state_vector(position: Column, rotation: Column, gripper: Column) -> Column:
    return F.concat(position, rotation, gripper)


def point_xy(xy: Column, pixel: Column, width: Column, height: Column) -> Column:
    """The given point as fractions of the image; without one, the pixel by the image's last column and row."""
    side = lambda i, n: F.get(pixel, F.lit(i)) / F.greatest(n - 1, F.lit(1))
    return F.coalesce(xy, F.when(pixel.isNotNull(), F.array(side(0, width), side(1, height))))


def gripper_label(state: Column) -> Column:
    value = F.try_element_at(state, F.lit(-1))
    return F.when(value > 0, "open").when(value.isNotNull(), "closed")


def uniform_bin(x: Column, bins: int = 256) -> Column:
    """Bin of [-1, 1): -1 below, the last bin from 1 on."""
    half = bins / 2
    guess = F.floor((x + 1) * half)
    down = F.when(guess / half - 1 > x, guess - 1).otherwise(guess)
    return F.when(x < -1, -1).otherwise(F.least(down, F.lit(bins - 1))).cast("bigint")


def overlap_ratio(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes given by x, y, w, h."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    return both / F.nullif(a["w"] * a["h"] + b["w"] * b["h"] - both, F.lit(0.0))


# --- rigid poses ----------------------------------------------------------------------------------


def _rotation_log(q: np.ndarray) -> np.ndarray:
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    q = np.where(q[:, 3:] < 0, -q, q)
    size = np.linalg.norm(q[:, :3], axis=1)
    angle = 2 * np.arctan2(size, q[:, 3])
    scale = np.where(size > 1e-12, angle / np.maximum(size, 1e-300), 2.0)
    return q[:, :3] * scale[:, None]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    av, aw, bv, bw = a[:, :3], a[:, 3:], b[:, :3], b[:, 3:]
    return np.hstack([aw * bv + bw * av + np.cross(av, bv), aw * bw - np.sum(av * bv, axis=1, keepdims=True)])


def _pose_log(position: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Exponential coordinates (rotation vector, then the matching translation)."""
    turn = _rotation_log(rotation)
    angle = np.linalg.norm(turn, axis=1)
    small = angle < 1e-6
    safe = np.where(small, 1.0, angle)
    factor = np.where(small, 1 / 12.0, 1 / safe**2 - 1 / (2 * safe * np.tan(safe / 2)))
    once = np.cross(turn, position)
    return np.hstack([turn, position - 0.5 * once + factor[:, None] * np.cross(turn, once)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def relative_pose(eef_pos: pd.Series, eef_quat: pd.Series, target_pos: pd.Series, target_quat: pd.Series) -> pd.Series:
    """Six numbers: target pose against the gripper's position and its orientation."""
    p, q, t, r = (np.array(s.tolist(), dtype=float) for s in (eef_pos, eef_quat, target_pos, target_quat))
    if not len(p):
        return pd.Series([], dtype=object)
    back = q * np.array([-1.0, -1.0, -1.0, 1.0])
    return pd.Series(list(_pose_log(t - p, _times(back, r))))
