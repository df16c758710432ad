"""Bidirectional levels of one paragraph by the implicit rules of Unicode's algorithm, runs, visual order and mirrors.

Embeddings, overrides and isolates are taken as neutral. Levels are per code point.
"""

from __future__ import annotations

import unicodedata
from itertools import groupby

NEUTRAL = ("B", "S", "WS", "ON")
# Pairs that are each other's mirror.
MIRRORS = dict(zip("()[]{}<>«»‹›≤≥", ")(][}{><»«›‹≥≤"))


def base_level(classes: list[str]) -> int:
    """By the first strong character; 0 if there is none."""
    return next((int(c != "L") for c in classes if c in ("L", "R", "AL")), 0)


def levels(text: str | None, base: int | None = None) -> list[int] | None:
    """The level of each code point; null for null, none for an empty text."""
    if text is None:
        return None
    first = [unicodedata.bidirectional(c) or "L" for c in text]
    base = base_level(first) if base is None else base
    c = ["ON" if x in ("LRE", "RLE", "LRO", "RLO", "PDF", "LRI", "RLI", "FSI", "PDI", "BN") else x for x in first]
    edge = "R" if base % 2 else "L"
    last = edge  # marks take the class before them
    for i, x in enumerate(c):
        c[i] = last = last if x == "NSM" else x
    strong = edge  # European digits after Arabic letters are Arabic; then Arabic letters are right-to-left
    for i, x in enumerate(c):
        if x in ("L", "R", "AL"):
            strong = x
        elif x == "EN" and strong == "AL":
            c[i] = "AN"
    c = ["R" if x == "AL" else x for x in c]
    for i in range(1, len(c) - 1):  # one separator between digits of a kind joins them
        if c[i - 1] == c[i + 1] and ((c[i] == "ES" and c[i - 1] == "EN") or (c[i] == "CS" and c[i - 1] in ("EN", "AN"))):
            c[i] = c[i - 1]
    at = 0
    for kind, run in groupby(list(c)):  # terminators beside European digits are digits; what is left of the separators is neutral
        n = len(list(run))
        if kind == "ET":
            beside = (at and c[at - 1] == "EN") or (at + n < len(c) and c[at + n] == "EN")
            c[at : at + n] = ["EN" if beside else "ON"] * n
        at += n
    c = ["ON" if x in ("ES", "CS", "ET") else x for x in c]
    strong = edge  # European digits after left-to-right text go with it
    for i, x in enumerate(c):
        if x in ("L", "R"):
            strong = x
        elif x == "EN" and strong == "L":
            c[i] = "L"
    at = 0
    side = lambda x: "L" if x == "L" else "R"
    for neutral, run in groupby([x in NEUTRAL for x in c]):  # neutrals between equals follow them, others the paragraph
        n = len(list(run))
        if neutral:
            before = side(c[at - 1]) if at else edge
            after = side(c[at + n]) if at + n < len(c) else edge
            c[at : at + n] = [before if before == after else edge] * n
        at += n
    out = [base + {"L": base % 2, "R": 1 - base % 2}.get(x, 2 - base % 2) for x in c]
    tail = True  # separators, and white space before them or at the end, are at the paragraph's level
    for i in reversed(range(len(out))):
        if first[i] in ("B", "S"):
            out[i], tail = base, True
        elif first[i] == "WS" and tail:
            out[i] = base
        else:
            tail = False
    return out


def runs(found: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, level) of the maximal runs of one level."""
    out, at = [], 0
    for level, run in groupby(found):
        n = len(list(run))
        out.append((at, at + n, level))
        at += n
    return out


def visual(text: str | None, base: int | None = None) -> str | None:
    """The text from left to right: runs of a level or higher are turned, from the highest to the lowest odd one, and turned characters mirrored."""
    if not text:
        return text
    found = levels(text, base)
    order = list(range(len(text)))
    for level in range(max(found), 0, -1):
        at = 0
        for high, run in groupby([found[i] >= level for i in order]):
            n = len(list(run))
            if high:
                order[at : at + n] = order[at : at + n][::-1]
            at += n
    return "".join(MIRRORS.get(text[i], text[i]) if found[i] % 2 else text[i] for i in order)


def columns():
    """(levels, visual) as Arrow-batched Column functions of a text column."""
    import pandas as pd
    from pyspark.sql import functions as F

    def of_levels(s: pd.Series) -> pd.Series:
        return s.map(levels, na_action="ignore")

    def of_visual(s: pd.Series) -> pd.Series:
        return s.map(visual, na_action="ignore")

    for f in (of_levels, of_visual):
        f.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(of_levels, "array<int>"), F.pandas_udf(of_visual, "string")
