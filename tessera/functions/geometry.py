"""Symmetric 2x2 matrices (xx, xy, yy), grid coordinates, bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def det(xx: Column, xy: Column, yy: Column) -> Column:
    return xx * yy - xy * xy


def repaired(xx: Column, xy: Column, yy: Column, eps: float = 1e-5) -> list[Column]:
    """Where the determinant isn't positive, eps is added to the diagonal."""
    bad = det(xx, xy, yy) <= 0
    return [F.when(bad, xx + eps).otherwise(xx), xy, F.when(bad, yy + eps).otherwise(yy)]


def inverse(xx: Column, xy: Column, yy: Column, eps: float = 1e-5) -> list[Column]:
    a, b, c = repaired(xx, xy, yy, eps)
    d = F.greatest(det(a, b, c), F.lit(eps))
    return [c / d, -b / d, a / d]


def log_det(xx: Column, xy: Column, yy: Column, eps: float = 1e-5) -> Column:
    return F.ln(F.greatest(det(*repaired(xx, xy, yy, eps)), F.lit(eps)))


def eigenvalues(xx: Column, xy: Column, yy: Column) -> list[Column]:
    """Larger, smaller."""
    half = (xx + yy) / 2.0
    root = F.sqrt(F.greatest(half * half - det(xx, xy, yy), F.lit(0.0)))
    return [half + root, half - root]


def wasserstein2(a: list[Column], b: list[Column]) -> Column:
    """Squared 2-Wasserstein distance of two centred Gaussians: tr A + tr B - 2 tr (A^1/2 B A^1/2)^1/2. For 2x2, the trace of the
    root of a product is sqrt(tr(AB) + 2 sqrt(det A det B))."""
    product = a[0] * b[0] + a[1] * b[1] * 2.0 + a[2] * b[2]
    dets = F.sqrt(F.greatest(det(*a) * det(*b), F.lit(0.0)))
    return a[0] + a[2] + b[0] + b[2] - F.sqrt(F.greatest(product + dets * 2.0, F.lit(0.0))) * 2.0


def smoothed(prior: Column, spread: Column, weight: Column, n: Column) -> Column:
    """(weight x prior + spread) / (n + 50 weight + 3)."""
    return (prior * weight + spread) / (n + weight * 50.0 + 3.0)


def reflected(v: Column, size: Column) -> Column:
    """Coordinates outside 0..size-1 mirrored at the border pixel."""
    return F.when(v < 0, -v).when(v > size - 1, (size - 1) * 2 - v).otherwise(v)


def inside(x: Column, y: Column, width: Column, height: Column) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def half_away(v: Column) -> Column:
    """Rounded as C does: halves go away from zero."""
    return F.when(v < 0, F.ceil(v - 0.5)).otherwise(F.floor(v + 0.5)).cast("int")


def nearness(x: Column, y: Column, cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """0 at a centre, less with the squared distance in units of the raster."""
    return -(F.pow((x - cx) / width, 2) + F.pow((y - cy) / height, 2))
