"""Angles, distances, anatomical coordinates and small vectors as column arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bregma voxel (AP, DV, ML) and voxel size in micrometres.
BREGMA = (216.0, 18.0, 228.0)
VOXEL_UM = 25.0


def clamp(value: Column, lo: float | Column, hi: float | Column) -> Column:
    """`value` limited to [lo, hi]; null stays null (least and greatest alone would skip it)."""
    bounds = [b if isinstance(b, Column) else F.lit(b) for b in (lo, hi)]
    return F.when(value.isNotNull(), F.greatest(bounds[0], F.least(bounds[1], value)))


def voxel_to_mm(
    ap: Column, dv: Column, ml: Column, bregma: Sequence[float] = BREGMA, res: float = VOXEL_UM
) -> tuple[Column, Column, Column]:
    """Bregma-centred millimetres with the front positive."""
    scale = res / 1000
    return -(ap - bregma[0]) * scale, (dv - bregma[1]) * scale, (ml - bregma[2]) * scale


def pir_to_lps(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return -z, x, -y


def fold_midline(ml: Column, centre: float = 0.0) -> Column:
    """Both hemispheres onto one."""
    return F.abs(ml - centre)


def angle_deg(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def polar(x: Column, y: Column) -> tuple[Column, Column]:
    """(theta, rho)."""
    return F.atan2(y, x), F.hypot(x, y)


def rescale_angle(theta: Column, pivot: float = -math.pi / 4) -> Column:
    """Distance of an angle from `pivot` as a share of the way to pi (or to -pi below the pivot),
    turned into a score from 0.5 at the pivot to -0.5 at the ends."""
    above = (theta - pivot) / (math.pi - pivot)
    below = (pivot - theta) / (pivot + math.pi)
    return 0.5 - F.when((theta > pivot) & (theta <= math.pi), above).otherwise(below)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * b[0]
    for u, v in zip(a[1:], b[1:]):
        out = out + u * v
    return out


def cross(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column, Column]:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def angle_between(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Degrees between two directions."""
    cosine = dot(a, b) / (norm(a) * norm(b))
    return F.degrees(F.acos(clamp(cosine, -1.0, 1.0)))


def solve3(m: Sequence[Sequence[Column]], v: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Solution of a symmetric 3x3 system by Cramer's rule; null when singular."""
    def det(a, b, c) -> Column:
        return dot(a, cross(b, c))

    columns = [[m[i][j] for i in range(3)] for j in range(3)]
    whole = F.nullif(det(*columns), F.lit(0.0))
    return tuple(
        det(*[v if k == j else columns[k] for k in range(3)]) / whole for j in range(3)
    )


def vector_sum_to(v: Column, total: float = 1000.0) -> Column:
    """Vector scaled so that its entries add up to `total`."""
    size = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(v, lambda x: x * total / size)
