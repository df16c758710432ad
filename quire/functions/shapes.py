"""Sampled, exponential and stitched functions, matrices and colour, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def interpolate(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """x from [x0, x1] to [y0, y1]; y0 where the first has no length."""
    return F.lit(float(y0)) if x0 == x1 else y0 + (x - x0) * (y1 - y0) / (x1 - x0)


def exponential(x: Column, c0: list[float], c1: list[float], n: float, domain=(0.0, 1.0)) -> list[Column]:
    t = F.pow(clamp(x, *domain), F.lit(float(n)))
    return [a + t * (b - a) for a, b in zip(c0, c1)]


def stitched(x: Column, parts: list, bounds: list[float], encode: list[tuple[float, float]], domain=(0.0, 1.0)) -> Column:
    """parts[i](x mapped to encode[i]) where i is the first with x < bounds[i], the last where there is none."""
    x = clamp(x, *domain)
    edges = [domain[0], *bounds, domain[1]]
    out = parts[-1](interpolate(x, edges[-2], edges[-1], *encode[-1]))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(x < bounds[i], parts[i](interpolate(x, edges[i], edges[i + 1], *encode[i]))).otherwise(out)
    return out


def sampled(inputs: list[Column], samples: Column, sizes: list[int], domain: list[tuple[float, float]]) -> Column:
    """Multilinear interpolation in an array of samples, the first input running fastest.

    The cell of the last sample is the one before it, so that the upper end of the domain is reached.
    """
    cells, fractions = [], []
    for x, n, (a, b) in zip(inputs, sizes, domain):
        e = clamp(interpolate(clamp(x, a, b), a, b, 0, n - 1), 0, n - 1)
        cell = F.least(F.floor(e), F.lit(max(0, n - 2))).cast("int")
        cells.append(cell)
        fractions.append(e - cell)
    total = F.lit(0.0)
    for corner in range(1 << len(sizes)):
        weight, place, stride = F.lit(1.0), F.lit(0), 1
        for d, n in enumerate(sizes):
            up = corner >> d & 1 if n > 1 else 0
            if n == 1 and corner >> d & 1:
                weight = F.lit(0.0)
            weight = weight * (fractions[d] if up else 1.0 - fractions[d])
            place = place + (cells[d] + up) * stride
            stride *= n
        total = total + weight * F.get(samples, place).cast("double")
    return total


def array(functions: list, x: Column) -> list[Column]:
    """One output from each of several functions of one input and one output, as where an array stands for a function."""
    return [f(x) for f in functions]


def multiply(m: list, n: list) -> list:
    """The matrix (a, b, c, d, e, f) that applies m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u]


def transform(m: list, x: Column, y: Column) -> tuple[Column, Column]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def fixed_times(x: Column, y: Column) -> Column:
    """The product of two numbers in 16.16 fixed point, rounded half up."""
    return F.shiftright(x * y + 32768, 16)
