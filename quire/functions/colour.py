"""Device and CIE colours to RGB, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# XYZ (D65) to linear sRGB, the white point of D65, and the cone responses of Bradford with their inverse.
XYZ_TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
D65 = (0.95047, 1.0, 1.08883)
CONES = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
FROM_CONES = ((0.9869929, -0.1470543, 0.1599627), (0.4323053, 0.5183603, 0.0492912), (-0.0085287, 0.0400428, 0.9684867))


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def channel(x: Column) -> Column:
    """0 to 255 of a channel in [0, 1], rounded half up."""
    return F.floor(unit(x) * 255 + 0.5).cast("int")


def gray(g: Column) -> list[Column]:
    return [channel(g)] * 3


def rgb(r: Column, g: Column, b: Column) -> list[Column]:
    return [channel(r), channel(g), channel(b)]


def cmyk(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    """The plain complement: 1 - min(1, ink + black)."""
    return [channel(1 - F.least(F.lit(1.0), unit(x) + unit(k))) for x in (c, m, y)]


def encode(x: Column) -> Column:
    """sRGB's transfer curve."""
    x = unit(x)
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055)


def _times(m, v):
    return [sum(a * b for a, b in zip(row, v)) for row in m]


def adaptation(white: tuple[float, float, float]) -> list[list[float]]:
    """The matrix that takes XYZ under a white point to XYZ under D65, by scaling cone responses; no change for D65 itself."""
    if all(abs(a - b) < 1e-4 for a, b in zip(white, D65)):
        return [[float(i == j) for j in range(3)] for i in range(3)]
    scale = [d / s if s else 1.0 for s, d in zip(_times(CONES, white), _times(CONES, D65))]
    scaled = [[k * x for x in row] for k, row in zip(scale, CONES)]
    return [[sum(a * scaled[k][j] for k, a in enumerate(row)) for j in range(3)] for row in FROM_CONES]


def xyz(x: Column, y: Column, z: Column, white: tuple[float, float, float] = D65) -> list[Column]:
    m = adaptation(white)
    m = [[sum(row[k] * m[k][j] for k in range(3)) for j in range(3)] for row in XYZ_TO_RGB]
    return [channel(encode(a * x + b * y + c * z)) for a, b, c in m]


def lab(lightness: Column, a: Column, b: Column, white: tuple[float, float, float] = D65) -> list[Column]:
    def g(t: Column) -> Column:
        return F.when(t > 6 / 29, t * t * t).otherwise((t - 4 / 29) * (108 / 841))

    m = (lightness + 16) / 116
    return xyz(g(m + a / 500) * white[0], g(m) * white[1], g(m - b / 200) * white[2], white)


def _decoded(x: Column, gamma: float) -> Column:
    return unit(x) if gamma == 1 else F.pow(unit(x), F.lit(float(gamma)))


def cal_gray(g: Column, white: tuple[float, float, float] = D65, gamma: float = 1.0) -> list[Column]:
    a = _decoded(g, gamma)
    return xyz(*[a * w for w in white], white)


def cal_rgb(r: Column, g: Column, b: Column, white: tuple[float, float, float] = D65, gamma=(1.0, 1.0, 1.0), matrix=(1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0)) -> list[Column]:
    """matrix has X, Y and Z of the first component, then of the second and the third."""
    parts = [_decoded(x, k) for x, k in zip((r, g, b), gamma)]
    return xyz(*[sum(p * matrix[3 * i + j] for i, p in enumerate(parts)) for j in range(3)], white)


def tinted(colorants: list[Column], transform, alternate) -> list[Column]:
    """A colour of one or more named inks (a separation has one): transform gives the components of the space alternate, which gives RGB."""
    return alternate(*transform(*colorants))
