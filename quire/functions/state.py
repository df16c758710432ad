"""Text state as Column expressions: advances, matrices, boxes, page geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATRIX = ("a", "b", "c", "d", "e", "f")


def advance(width: Column, size: Column, char_space: Column, word_space: Column, scale: Column, space: Column) -> Column:
    """How far a glyph of width (in em) moves the next: ((w * size) + Tc + Tw for a space) * Th."""
    return (width * size + char_space + F.when(space, word_space).otherwise(F.lit(0.0))) * scale


def times(m: dict[str, Column], n: dict[str, Column]) -> dict[str, Column]:
    """m, then n, of matrices [a b c d e f]."""
    return {
        "a": m["a"] * n["a"] + m["b"] * n["c"],
        "b": m["a"] * n["b"] + m["b"] * n["d"],
        "c": m["c"] * n["a"] + m["d"] * n["c"],
        "d": m["c"] * n["b"] + m["d"] * n["d"],
        "e": m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        "f": m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    }


def box(m: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """The upright box around the four corners of [0, width] x [0, height] under m."""
    xs = [m["e"], m["e"] + m["a"] * width, m["e"] + m["c"] * height, m["e"] + m["a"] * width + m["c"] * height]
    ys = [m["f"], m["f"] + m["b"] * width, m["f"] + m["d"] * height, m["f"] + m["b"] * width + m["d"] * height]
    return {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}


def turned(rotate: Column) -> Column:
    """Quarter turns as 0, 90, 180 or 270; what is no multiple of 90 goes to the next lower one."""
    return (F.floor(F.pmod(F.coalesce(rotate, F.lit(0)), F.lit(360)) / 90) * 90).cast("int")


def shown_size(width: Column, height: Column, rotate: Column) -> tuple[Column, Column]:
    """Width and height as shown; a missing box is 612 by 792."""
    w, h = F.coalesce(width, F.lit(612.0)), F.coalesce(height, F.lit(792.0))
    flat = turned(rotate).isin(0, 180)
    return F.when(flat, w).otherwise(h), F.when(flat, h).otherwise(w)


def finite(*values: Column) -> Column:
    out = F.lit(True)
    for x in values:
        out = out & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return out
