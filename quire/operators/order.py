"""Reading order of the words of many pages at once, on Arrow arrays: the same rules as the SQL of lines, in time linear in the words but for sorting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules.
BAND, LEAST_BAND = 0.5, 0.01
BUCKETS, MIDDLE, RUN = 200, (66, 134), 5

PLACES = "array<struct<col:int,band:int,at:int>>"


def page_bands(page: np.ndarray, middle: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The line band of each word, from its page, the middle of its box and its size: words are swept from the top, ties in word order.

    Words of one middle and size that follow each other share a band, so that a step is one for all of them.
    """
    order = np.lexsort((-middle, page))
    p, k, s = page[order], -middle[order], size[order]
    heads = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (k[1:] != k[:-1]) | (s[1:] != s[:-1]))) if len(p) else p
    found, last, anchor, tall, n = [], -1, 0.0, 0.0, 0
    for at, mid, high in zip(p[heads].tolist(), k[heads].tolist(), s[heads].tolist()):
        if at != last:
            last, anchor, tall, n = at, mid, high, 0
        elif not mid - anchor <= max(BAND * max(tall, high), LEAST_BAND):
            anchor, tall, n = mid, high, n + 1
        found.append(n)
    out = np.empty(len(page), np.int32)
    out[order] = np.repeat(np.array(found, np.int32), np.diff(np.append(heads, len(p))))
    return out


def gutters(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each page (its first word and the end are in at) the place where it parts into two columns, or NaN."""
    n = len(at) - 1
    out = np.full(n, np.nan)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return out
    heads = at[:-1][some]
    low = np.minimum.reduceat(left, heads)
    step = (np.maximum.reduceat(right, heads) - low) / BUCKETS
    wide = step > 0
    page = np.repeat(np.arange(len(some)), np.diff(at)[some])
    keep = wide[page]
    page = page[keep]
    a, b = (np.clip(np.floor((x[keep] - low[page]) / step[page]), 0, BUCKETS - 1).astype(np.int64) for x in (left, right))
    width = BUCKETS + 1
    edge = np.bincount(page * width + a, minlength=len(some) * width) - np.bincount(page * width + b + 1, minlength=len(some) * width)
    free = np.cumsum(edge.reshape(-1, width), axis=1)[:, MIDDLE[0] : MIDDLE[1]] == 0
    size = free.shape[1]
    run = np.logical_and.reduce([free[:, k : size - RUN + 1 + k] for k in range(RUN)])
    start = run.argmax(axis=1)
    taken = ~free & (np.arange(size) >= start[:, None])
    end = np.where(taken.any(axis=1), taken.argmax(axis=1), size)
    out[some] = np.where(run.any(axis=1) & wide, low + (MIDDLE[0] + start + (end - start) / 2.0) * step, np.nan)
    return out


def page_gutter(left: np.ndarray, right: np.ndarray) -> float | None:
    """The place where a page parts into two columns, or None."""
    cut = gutters(np.array([0, len(left)]), left, right)[0]
    return None if np.isnan(cut) else float(cut)


def places(offsets: np.ndarray, left, bottom, right, top, size, rank=None, columns: bool = True):
    """(col, band, at) of all words, page by page in reading order; at is a word's place in its page."""
    count = np.diff(offsets)
    page = np.repeat(np.arange(len(count)), count)
    band = page_bands(page, (bottom + top) / 2, size)
    col = np.zeros(len(page), np.int32)
    most = int(band.max()) + 1 if len(band) else 1
    if columns and rank is None and len(page):
        cut = gutters(offsets, left, right)
        side = (~((left + right) / 2 < cut[page])).astype(np.int32)
        each = np.unique(((page * 2 + side) * most + band)[~np.isnan(cut)[page]]) // most  # a row for each band of a side
        bands = np.bincount(each, minlength=2 * len(count)).reshape(-1, 2)
        col = np.where((bands >= 2).all(axis=1)[page], side, 0).astype(np.int32)
    group = (page * 2 + col) * most + band
    at = np.arange(len(page)) - offsets[:-1][page] if len(page) else np.zeros(0, np.int64)
    _, group = np.unique(group, return_inverse=True)
    if rank is None:
        high = np.full(len(page), -np.inf)
        np.maximum.at(high, group, top)
        keys = (left, -high[group], col, page)
    else:
        first = np.full(len(page), np.inf)
        np.minimum.at(first, group, np.where(np.isnan(rank), np.inf, rank))
        first[np.isinf(first)] = -np.inf  # a band without a rank comes first, as a missing value does in a sort
        keys = (left, np.where(np.isnan(rank), -np.inf, rank), first[group], col, page)
    order = np.lexsort(keys)
    return col[order], band[order], at[order].astype(np.int32)


def gutter(words: str = "words") -> Column:
    """The place where a page parts into two columns, or null, from its words' left and right edges."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        counts = np.where(left.is_null().to_numpy(zero_copy_only=False), 0, np.diff(np.asarray(left.offsets)))
        cut = gutters(np.append(0, np.cumsum(counts)), *(np.asarray(x.flatten(), dtype=np.float64) for x in (left, right)))
        return pa.array(cut, pa.float64(), mask=np.isnan(cut))

    return F.arrow_udf(run, "double")(F.col(f"{words}.l"), F.col(f"{words}.r"))


def dominant_direction(words: str = "words") -> Column:
    """0 right, 1 up, 2 left, 3 down: the direction with the most letters; of equals the one whose first word comes first; 0 without words."""

    def run(word: pa.Array, letters: pa.Array, dx: pa.Array, dy: pa.Array) -> pa.Array:
        counts = np.where(word.is_null().to_numpy(zero_copy_only=False), 0, np.diff(np.asarray(word.offsets)))
        page = np.repeat(np.arange(len(counts)), counts)
        i, n, x, y = (np.asarray(a.flatten(), dtype=np.float64) for a in (word, letters, dx, dy))
        turn = np.where(np.abs(x) >= np.abs(y), np.where(x >= 0, 0, 2), np.where(y >= 0, 1, 3))
        sums = np.bincount(page * 4 + turn, n, minlength=4 * len(counts)).reshape(-1, 4)
        first = np.full(4 * len(counts), np.inf)
        np.minimum.at(first, page * 4 + turn, i)
        best = np.where(sums == sums.max(axis=1, keepdims=True), first.reshape(-1, 4), np.inf) if len(counts) else sums
        return pa.array(best.argmin(axis=1), pa.int32())

    return F.arrow_udf(run, "int")(*(F.col(f"{words}.{c}") for c in ("word", "n_letters", "dx", "dy")))


def reading_order(words: str = "words", ranks: str | None = None, columns: bool = True) -> Column:
    """PLACES of a page's words in reading order, from arrays of their boxes and sizes alone, which are all that goes to Python."""

    def run(left, bottom, right, top, size, *rank):
        starts = np.asarray(left.offsets)  # a null page has no words
        arrays = [np.asarray(x.flatten(), dtype=np.float64) for x in (left, bottom, right, top, size, *rank)]
        counts = np.where(left.is_null().to_numpy(zero_copy_only=False), 0, np.diff(starts))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        col, band, at = places(offsets, *arrays[:5], arrays[5] if rank else None, columns)
        made = pa.StructArray.from_arrays([pa.array(col, pa.int32()), pa.array(band, pa.int32()), pa.array(at, pa.int32())], names=["col", "band", "at"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made)

    def ordered(left: pa.Array, bottom: pa.Array, right: pa.Array, top: pa.Array, size: pa.Array) -> pa.Array:
        return run(left, bottom, right, top, size)

    def ranked(left: pa.Array, bottom: pa.Array, right: pa.Array, top: pa.Array, size: pa.Array, rank: pa.Array) -> pa.Array:
        return run(left, bottom, right, top, size, rank)

    boxes = [F.col(f"{words}.{c}") for c in ("l", "b", "r", "t", "size")]
    if ranks:
        return F.arrow_udf(ranked, PLACES)(*boxes, F.transform(ranks, lambda x: x.cast("double")))
    return F.arrow_udf(ordered, PLACES)(*boxes)
