"""Levels and visual order of small paragraphs."""

import pytest

from quire.functions import bidi

A, B, C = "אבג"
ARABIC = "س"


@pytest.mark.parametrize(
    "text, want",
    [
        ("abc", [0, 0, 0]),
        (f"ab {A}{B}", [0, 0, 0, 1, 1]),
        (f"{A}{B} ab", [1, 1, 1, 2, 2]),
        (f"{A} 12", [1, 1, 2, 2]),
        (f"a {A} 12 b", [0, 0, 1, 1, 2, 2, 0, 0]),
        (f"{A}-{B}", [1, 1, 1]),
        (f"a-{B}", [0, 0, 1]),
        (f"{ARABIC}1", [1, 2]),
        (f"{A}1,2", [1, 2, 2, 2]),
        (f"{A}1+2 ", [1, 2, 2, 2, 1]),
        (f"{A}$1", [1, 2, 2]),
        ("a1", [0, 0]),
        ("", []),
        ("12", [0, 0]),
    ],
)
def test_levels(text, want):
    assert bidi.levels(text) == want


def test_visual():
    assert bidi.visual(f"ab {A}{B}{C}") == f"ab {C}{B}{A}"
    assert bidi.visual(f"{A}({B}) 12") == f"12 ({B}){A}"
    assert bidi.visual(None) is None and bidi.visual("") == "" and bidi.levels(None) is None
    assert bidi.runs([0, 0, 1, 1, 0]) == [(0, 2, 0), (2, 4, 1), (4, 5, 0)]


def test_columns(spark):
    of_levels, of_visual = bidi.columns()
    rows = spark.createDataFrame([(f"a{A}",), ("",), (None,)], "text string").select(of_levels("text").alias("l"), of_visual("text").alias("v")).collect()
    assert [tuple(r) for r in rows] == [([0, 1], f"a{A}"), ([], ""), (None, None)]
