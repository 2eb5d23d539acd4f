"""Colour columns. Channels are red, green, blue unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB to XYZ (D65), its white point, and the way back.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
WHITE_VIDEO = (0.95047, 1.0, 1.08883)
FROM_XYZ = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875992, 0.041556), (0.055648, -0.204043, 1.057311))
# BT.601 luma and chroma, Rec.709 luminance.
YCBCR = ((65.481, 128.553, 24.966, 16.0), (-37.797, -74.203, 112.0, 128.0), (112.0, -93.786, -18.214, 128.0))
REC709 = (0.2126, 0.7152, 0.0722)


def _dot(row, cols) -> Column:
    out = F.lit(0.0)
    for k, c in zip(row, cols, strict=False):
        out = out + c * k
    return out


def linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def gamma(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)


def rgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    """L, a, b, each divided by 100, L with its sign turned."""
    xyz = [_dot(row, [linear(r), linear(g), linear(b)]) / w for row, w in zip(TO_XYZ, WHITE, strict=True)]
    f = [F.when(v > 0.008856, F.pow(v, F.lit(1 / 3))).otherwise((v * 903.3 + 16.0) / 116.0) for v in xyz]
    light = F.when(xyz[1] > 0.008856, f[1] * 116.0 - 16.0).otherwise(xyz[1] * 903.3)
    return [light / -100.0, (f[0] - f[1]) * 5.0, (f[1] - f[2]) * 2.0]


def rgb_to_lab_video(r: Column, g: Column, b: Column) -> list[Column]:
    """As rgb_to_lab by the coarser white point, with one straight piece near black for all three."""
    xyz = [_dot(row, [linear(r), linear(g), linear(b)]) / w for row, w in zip(TO_XYZ, WHITE_VIDEO, strict=True)]
    f = [F.when(v > 0.008856, F.pow(v, F.lit(1 / 3))).otherwise(v * 7.787068965517241 + 4.0 / 29.0) for v in xyz]
    return [(f[1] * 116.0 - 16.0) / -100.0, (f[0] - f[1]) * 5.0, (f[1] - f[2]) * 2.0]


def lab_to_rgb(light: Column, a: Column, b: Column) -> list[Column]:
    """The way back from rgb_to_lab, clamped to 0..1."""
    level = light * -100.0
    fy = (level + 16.0) / 116.0
    fx, fz = fy + a / 5.0, fy - b / 2.0
    cube = lambda v: F.when(v > 0.206893, v * v * v).otherwise((v * 116.0 - 16.0) / 903.3)
    y = F.when(level > 7.9996, fy * fy * fy).otherwise(level / 903.3)
    xyz = [cube(fx) * WHITE[0], y * WHITE[1], cube(fz) * WHITE[2]]
    return [F.least(F.lit(1.0), F.greatest(F.lit(0.0), gamma(_dot(row, xyz)))) for row in FROM_XYZ]


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    """From 0..1, to 0..1."""
    return [(_dot(row[:3], [r, g, b]) + row[3]) / 255.0 for row in YCBCR]


def luminance(r: Column, g: Column, b: Column) -> Column:
    return _dot(REC709, [r, g, b])


def unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


#: Steps of the flow colour circle from red to yellow, green, cyan, blue, magenta and back (Baker et al., A database and evaluation methodology for optical flow).
WHEEL_STEPS = (15, 6, 4, 11, 13, 6)


def wheel() -> list[tuple[float, float, float]]:
    """The colours of the circle in 0..1: in each section one channel rises or falls in even steps."""
    out = []
    for k, n in enumerate(WHEEL_STEPS):
        full, moving = (0, 1, 1, 2, 2, 0)[k], (1, 0, 2, 1, 0, 2)[k]
        for i in range(n):
            c = [0.0, 0.0, 0.0]
            c[full], step = 1.0, int(255 * i / n) / 255
            c[moving] = 1.0 - step if k % 2 else step
            out.append(tuple(c))
    return out


def flow_colour(dx: Column, dy: Column, most: Column) -> list[Column]:
    """Bytes of red, green, blue of a flow: its direction on the circle, its length in units of ``most`` as saturation. A value short of a byte by less than 1e-9
    is that byte, so that the order of sums doesn't matter."""
    circle = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, "rgb", strict=True)]) for c in wheel()])
    n = sum(WHEEL_STEPS)
    u, v = dx / most, dy / most
    length = F.sqrt(u * u + v * v)
    # straight to the right lies the seam of the circle: it belongs to the beginning
    at = F.when((v == 0) & (u > 0), 0.0).otherwise((F.atan2(-v, -u) / math.pi + 1.0) / 2.0 * (n - 1))
    low = F.floor(at).cast("int")
    first, second, part = F.element_at(circle, low + 1), F.element_at(circle, (low + 1) % n + 1), at - low
    mixed = [first[c] * (1.0 - part) + second[c] * part for c in "rgb"]
    return [F.floor(F.when(length <= 1, 1.0 - length * (1.0 - m)).otherwise(m * 0.75) * 255.0 + 1e-9).cast("int") for m in mixed]
