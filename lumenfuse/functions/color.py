"""Colour spaces as column expressions; RGB in 0..255, hue in radians."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# BT.601 luma and chroma weights, D65 white, sRGB to XYZ matrix.
KR, KG, KB = 0.299, 0.587, 0.114
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))


def clip(x: Column, low: float = 0.0, high: float = 255.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def to_byte(x: Column) -> Column:
    """Clipped and cut off, not rounded."""
    return clip(x).cast("int")


def rgb_to_grey(r: Column, g: Column, b: Column) -> Column:
    return F.round(0.2989 * r + 0.5870 * g + 0.1140 * b)


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return KR * r + KG * g + KB * b, -0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    return to_byte(y + 1.402 * (cr - 128)), to_byte(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)), to_byte(y + 1.772 * (cb - 128))


def hue(r: Column, g: Column, b: Column) -> Column:
    """Angle of the colour by the arc cosine form; shared by HSI and HSV."""
    top, below = 0.5 * ((r - g) + (r - b)), F.sqrt(F.pow(r - g, F.lit(2.0)) + (r - b) * (g - b)) + 1e-10
    theta = F.acos(clip(top / below, -1.0, 1.0))
    return F.when(b <= g, theta).otherwise(2 * math.pi - theta)


def rgb_to_hsi(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    i = (r + g + b) / 3.0
    return hue(r, g, b), F.when(i > 0, 1.0 - F.least(r, g, b) / (i + 1e-10)).otherwise(0.0), i


def hsi_to_rgb(h: Column, s: Column, i: Column) -> tuple[Column, Column, Column]:
    """Three sectors; a hue of a full turn or more matches none and gives black."""
    third = 2 * math.pi / 3
    sector = F.when((h >= 0) & (h < third), 0).when((h >= third) & (h < 2 * third), 1).when((h >= 2 * third) & (h < 3 * third), 2)
    turn = h - sector * third
    low, main = i * (1 - s), i * (1 + s * F.cos(turn) / F.cos(math.pi / 3 - turn))
    rest = 3 * i - (low + main)
    pick = lambda x, y, z: to_byte(F.coalesce(F.when(sector == 0, x).when(sector == 1, y).when(sector == 2, z), F.lit(0.0)) * 255)
    return pick(main, low, rest), pick(rest, main, low), pick(low, rest, main)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    v = F.greatest(r, g, b)
    return hue(r, g, b), F.when(v > 0, (v - F.least(r, g, b)) / (v + 1e-10)).otherwise(0.0), v


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    turn = F.pmod(F.degrees(h), F.lit(360.0)) / 60.0
    sector, part = F.floor(turn).cast("int") % 6, turn - F.floor(turn)
    p, q, t = v * (1 - s), v * (1 - part * s), v * (1 - (1 - part) * s)
    pick = lambda *x: to_byte(F.element_at(F.array(*x), sector + 1) * 255)
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def linear_light(u: Column) -> Column:
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def gamma(u: Column) -> Column:
    return F.when(u <= 0.0031308, 12.92 * u).otherwise(1.055 * F.pow(F.greatest(u, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def rgb_to_xyz(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    lin = [linear_light(x / 255.0) for x in (r, g, b)]
    return tuple(m[0] * lin[0] + m[1] * lin[1] + m[2] * lin[2] for m in TO_XYZ)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    d = 6.0 / 29.0
    f = [F.when(t > d**3, F.cbrt(t)).otherwise(t / (3 * d * d) + 4.0 / 29.0) for t in (x / w for x, w in zip(rgb_to_xyz(r, g, b), WHITE))]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def lab_to_rgb(l: Column, a: Column, b: Column) -> tuple[Column, ...]:  # noqa: E741
    d = 6.0 / 29.0
    y = (l + 16) / 116
    xyz = [F.when(t > d, F.pow(t, F.lit(3.0))).otherwise(3 * d * d * (t - 4.0 / 29.0)) * w for t, w in zip((y + a / 500, y, y - b / 200), WHITE)]
    return tuple(to_byte(gamma(clip(m[0] * xyz[0] + m[1] * xyz[1] + m[2] * xyz[2], 0.0, 1.0)) * 255) for m in TO_RGB)


def false_colour(cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Chroma at constant luma 128."""
    return ycbcr_to_rgb(F.lit(128.0), cb, cr)


def hsv8_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Eight-bit HSV with hue in half degrees (0..179) to red, green and blue in 0..1."""
    turn, s, v = h.cast("double") / 30, s / 255.0, v / 255.0
    sector, part = F.floor(turn).cast("int") % 6, turn - F.floor(turn)
    p, q, t = v * (1 - s), v * (1 - part * s), v * (1 - (1 - part) * s)
    pick = lambda *x: F.element_at(F.array(*x), sector + 1)
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def chroma_colour(a: Column, b: Column, base_hue: float = 0.0, full: float = 100.0, least: float = 0.0, brightness: int = 210) -> tuple[Column, Column, Column]:
    """Display colour of the chroma (a, b) of Lab: its angle as hue, turned by ``base_hue`` degrees, its length over ``full`` as saturation.

    Hue and saturation are cut off to eight bits.
    """
    turn = (F.atan2(b, a) + math.pi) / (2 * math.pi)
    turn = F.pmod(turn + base_hue / 360.0, F.lit(1.0)) if base_hue else turn
    length = clip(F.sqrt(a * a + b * b) / full, least, 1.0)
    return hsv8_to_rgb(F.floor(turn * 179), F.floor(length * 255), F.lit(brightness))


def stretched(x: Column, low: Column, high: Column) -> Column:
    """0..255 between two values, cut off; a constant becomes 0.  What colour tables are applied to."""
    return F.when(high > low, to_byte((x - low) / F.nullif(high - low, F.lit(0.0)) * 255)).otherwise(0)
