"""Byte ranges that a signature covers, and the permissions that a certification grants. No cryptography: shapes only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def verdict(ranges: Column, length: Column, contents: Column | None = None) -> Column:
    """Whole, Partial or Malformed, of [start, length, start, length, ...] against a file of length bytes.

    Malformed: no ranges, an odd number of entries, or a segment that isn't within the file. Whole: two segments, the first from the start of the
    file and the second to its end, with one gap between them, of the size of contents bytes written in hexadecimal if that is given. Else Partial.
    """
    starts = F.filter(ranges, lambda x, i: i % 2 == 0)
    lengths = F.filter(ranges, lambda x, i: i % 2 == 1)
    outside = F.exists(F.zip_with(starts, lengths, lambda a, n: F.coalesce((a < 0) | (n < 0) | (a + n > length), F.lit(True))), lambda x: x)
    a, n, b, m = (F.try_element_at(ranges, F.lit(i)) for i in range(1, 5))
    whole = (F.size(ranges) == 4) & (a == 0) & (b >= n) & (b + m == length)
    if contents is not None:
        whole &= b - n == 2 + 2 * contents
    return F.when(ranges.isNull() | (F.size(ranges) == 0) | (F.size(ranges) % 2 == 1) | outside, "Malformed").when(whole, "Whole").otherwise("Partial")


def covered(ranges: Column) -> Column:
    """The bytes covered: the sum of the ranges' lengths."""
    return F.aggregate(F.filter(ranges, lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, x: s + x)


def modification_level(level: Column) -> Column:
    """What may change after certification, of level 1 to 3; a missing level is 2; others are unknown (null)."""
    p = F.coalesce(level, F.lit(2))
    return F.when(p == 1, "NoChanges").when(p == 2, "FormFilling").when(p == 3, "FormFillingAndAnnotations")
