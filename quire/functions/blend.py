"""Blend formulas on channels 0 to 255, in integers that truncate, and alpha compositing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The curve of SoftLight for a backdrop b: a polynomial below a quarter, cut to an integer, above it the root, rounded.
_CURVE = "cast(if(b < 64, floor(((16 * (b / 255D) - 12) * (b / 255D) + 4) * b), floor(sqrt(b / 255D) * 255 + 0.5)) as int)"
_HARD = "if({s} < 128, ({s} * {b} * 2) div 255, {b} + (2 * {s} - 255) - ({b} * (2 * {s} - 255)) div 255)"
#: Separable blends of a backdrop b and a source s.
SEPARABLE = {
    "Normal": "s",
    "Multiply": "(b * s) div 255",
    "Screen": "b + s - (b * s) div 255",
    "Overlay": _HARD.format(b="s", s="b"),
    "Darken": "least(b, s)",
    "Lighten": "greatest(b, s)",
    "ColorDodge": "if(s = 255, 255, least(255, (b * 255) div greatest(1, 255 - s)))",
    "ColorBurn": "if(s = 0, 0, 255 - least(255, ((255 - b) * 255) div greatest(1, s)))",
    "HardLight": _HARD.format(b="b", s="s"),
    "SoftLight": f"if(s < 128, b - ((255 - 2 * s) * b * (255 - b)) div 255 div 255, b + ((2 * s - 255) * ({_CURVE} - b)) div 255)",
    "Difference": "abs(b - s)",
    "Exclusion": "b + s - (2 * b * s) div 255",
}
NON_SEPARABLE = ("Hue", "Saturation", "Color", "Luminosity")


def named(mode: str | None) -> str:
    """The mode of a name; a missing or unknown one is Normal."""
    return mode if mode in SEPARABLE or mode in NON_SEPARABLE else "Normal"


def separable(mode: str, backdrop: str, source: str) -> Column:
    """Unknown modes are Normal. Arguments are names of int columns."""
    text = SEPARABLE[named(mode)]
    return F.expr(f"cast({re.sub(r'\bb\b', backdrop, re.sub(r'\bs\b', source, text))} as int)")


def _quotient(a: Column, b) -> Column:
    """a over b, cut to an integer; 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b if isinstance(b, Column) else F.lit(b)), F.lit(0)).cast("int")


def _luminosity(c: list[Column]) -> Column:
    return _quotient(c[0] * 30 + c[1] * 59 + c[2] * 11, 100)


def _saturation(c: list[Column]) -> Column:
    return F.greatest(*c) - F.least(*c)


def _with_saturation(c: list[Column], sat: Column) -> list[Column]:
    """c spread out to another saturation, its least channel at 0; gray becomes black."""
    low, high = F.least(*c), F.greatest(*c)
    return [_quotient((x - low) * sat, high - low) for x in c]


def non_separable(rows: DataFrame, mode: str, backdrop: list[str], source: list[str], out: list[str]) -> DataFrame:
    """rows with the columns out: Hue, Saturation, Color or Luminosity of int channels, what the source gives and the backdrop keeps.

    The colour is moved to its new luminosity and drawn in towards it where it leaves 0 to 255. Each step is a projection of its own,
    which the optimizer doesn't merge where a step's result is used more than once.
    """
    b, s = [F.col(x) for x in backdrop], [F.col(x) for x in source]
    moved, lum = {
        "Hue": lambda: (_with_saturation(s, _saturation(b)), _luminosity(b)),
        "Saturation": lambda: (_with_saturation(b, _saturation(s)), _luminosity(b)),
        "Color": lambda: (s, _luminosity(b)),
        "Luminosity": lambda: (b, _luminosity(s)),
    }[mode]()
    names = [f"_blend_{i}" for i in range(3)]
    c = [F.col(x) for x in names]
    own, low, high, to = (F.col(f"_blend_{x}") for x in ("own", "low", "high", "to"))
    at = rows.select("*", *[x.alias(n) for n, x in zip(names, moved)], lum.alias("_blend_to"))
    at = at.withColumn("_blend_own", to - _luminosity(c))
    at = at.withColumns({n: x + own for n, x in zip(names, c)})
    at = at.withColumns({"_blend_own": _luminosity(c), "_blend_low": F.least(*c), "_blend_high": F.greatest(*c)})
    at = at.withColumns({n: F.when(low < 0, own + _quotient((x - own) * own, own - low)).otherwise(x) for n, x in zip(names, c)})
    done = [F.when(high > 255, own + _quotient((x - own) * (255 - own), high - own)).otherwise(x) for x in c]
    return at.select(*rows.columns, *[x.alias(n) for n, x in zip(out, done)])


def composite(backdrop: Column, source: Column, alpha: Column) -> Column:
    """A source over an opaque backdrop, to the nearest integer."""
    return F.floor(backdrop * (1.0 - alpha) + source * alpha + 0.5).cast("int")


def composite_alpha(backdrop: list[Column], source: list[Column], blended: list[Column]) -> list[Column]:
    """Channels and alpha (0 to 255) of a source over a backdrop that may be transparent itself.

    backdrop and source end in their alpha; blended are the blend's channels. A source of alpha 0 changes nothing.
    """
    ab, asrc = backdrop[-1] / 255.0, source[-1] / 255.0
    union = ab + asrc - ab * asrc
    weight = F.coalesce(F.try_divide(asrc, union), F.lit(0.0))
    whole = lambda x: F.least(F.greatest(F.floor(x + 0.5), F.lit(0)), F.lit(255)).cast("int")
    out = [whole((1 - weight) * b + weight * ((1 - ab) * s + ab * m)) for b, s, m in zip(backdrop[:-1], source[:-1], blended)]
    none = source[-1] == 0
    return [F.when(none, b).otherwise(o) for b, o in zip(backdrop, [*out, whole(union * 255)])]
