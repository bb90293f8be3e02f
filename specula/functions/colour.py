"""Colour and tone as column expressions. All inputs and results are doubles; a null input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rec. 709 luma, linear sRGB to XYZ (D65) and back, the D65 white.
LUMA = (0.2126, 0.7152, 0.0722)
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
#: OkLab's matrices.
RGB_TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LMS_TO_OKLAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def srgb_to_linear(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(y: Column) -> Column:
    y = F.greatest(y, F.lit(0.0))
    return F.when(y <= 0.0031308, y * 12.92).otherwise(1.055 * F.pow(y, F.lit(1 / 2.4)) - 0.055)


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def matrix(m, a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    return tuple(a * row[0] + b * row[1] + c * row[2] for row in m)


def _f(t: Column) -> Column:
    return F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116)


lab_curve = _f


def _f_inverse(t: Column) -> Column:
    return F.when(t > 6 / 29, t * t * t).otherwise((t * 116 - 16) / (24389 / 27))


def xyz_to_lab(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    x, y, z = (_f(v / w) for v, w in zip((x, y, z), WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def lab_to_xyz(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    y = (light + 16) / 116
    return tuple(_f_inverse(v) * w for v, w in zip((y + a / 500, y, y - b / 200), WHITE, strict=True))


def linear_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return xyz_to_lab(*matrix(RGB_TO_XYZ, r, g, b))


def lab_to_linear(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    return matrix(XYZ_TO_RGB, *lab_to_xyz(light, a, b))


def lightness(y: Column) -> Column:
    return 116 * _f(y) - 16


def from_lightness(light: Column) -> Column:
    return _f_inverse((light + 16) / 116)


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hue_degrees(a: Column, b: Column) -> Column:
    turn = F.degrees(F.atan2(b, a))
    return F.when(turn < 0, turn + 360).otherwise(turn)


def saturation(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top > 0, (top - low) / top).otherwise(F.lit(0.0))


def smoothstep(x: Column, low, high) -> Column:
    t = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def hue_distance(h: Column, centre) -> Column:
    """Degrees between hues, 0 to 180."""
    d = F.abs(h - centre)
    return F.when(d > 180, 360 - d).otherwise(d)


def hue_weight(h: Column, centre: float, half: float) -> Column:
    """1 up to 0.35 of a band's half width from its centre, falling smoothly to 0 at its edges, round the circle."""
    t = F.least(F.greatest(1 - (hue_distance(h, centre) - half * 0.35) / (half * 0.65), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def retone(r: Column, g: Column, b: Column, new: Column) -> tuple[Column, Column, Column]:
    """Linear colours brought to luminance ``new``; black stays black."""
    y = luma(r, g, b)
    k = F.when(y > 0, new / y).otherwise(F.lit(0.0))
    return r * k, g * k, b * k


def fit_gamut(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Colours with a channel above 1 mixed with their luminance until the largest channel is 1."""
    y, top = luma(r, g, b), F.greatest(r, g, b)
    k = F.when((top > 1) & (top > y), (1 - F.least(y, F.lit(1.0))) / (top - F.least(y, F.lit(1.0)))).otherwise(F.lit(1.0))
    return tuple(y + (c - y) * k for c in (r, g, b))


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return matrix(LMS_TO_OKLAB, *(F.cbrt(v) for v in matrix(RGB_TO_LMS, r, g, b)))


def to_byte(x: Column) -> Column:
    """0 to 255, halves to even."""
    return F.least(F.greatest(F.rint(x * 255), F.lit(0.0)), F.lit(255.0)).cast("int")


def rounded(x: Column, digits: int) -> Column:
    """``round`` to the bit, without a decimal number for each value: only near halves and from 1e12 units on it is left to it."""
    t = x * float(10**digits)
    whole = F.rint(t)
    sure = (F.abs(t - whole) < 0.499) & (F.abs(t) < 1e12)  # the product is off by less than 0.001 there
    return F.when(sure, whole / float(10**digits) + 0.0).otherwise(F.round(x, digits))
