"""Words from positioned letters: gaps between neighbours, inside the page's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled

#: Least cosine of directions, and greatest offset across and gap along the line, in letter sizes.
COSINE, ACROSS, ALONG, LEAST_SIZE = 0.9, 0.35, 0.26, 0.01


def breaks(prev: str, cur: str) -> str:
    """SQL: whether a word ends between two neighbouring letters that aren't blank. A step backwards does not end it."""
    ref = f"greatest({prev}.size, {cur}.size, {LEAST_SIZE}D)"
    ox, oy = f"({cur}.x - {prev}.x)", f"({cur}.y - {prev}.y)"
    return (
        f"({prev}.dx * {cur}.dx + {prev}.dy * {cur}.dy < {COSINE}D"
        f" OR abs({ox} * -{prev}.dy + {oy} * {prev}.dx) > {ACROSS}D * {ref}"
        f" OR {ox} * {prev}.dx + {oy} * {prev}.dy - {prev}.adv > {ALONG}D * {ref})"
    )


def blank(letter: str) -> str:
    white = "'', ' ', '\\t', '\\r', '\\n', '\\u000c', '\\u00a0'"
    long = f"trim(translate({letter}.value, '\\t\\r\\n\\u000c\\u00a0', '     ')) = ''"
    return f"({letter}.value IS NULL OR {letter}.value IN ({white}) OR (length({letter}.value) > 1 AND {long}))"


def _corner(f: str, pick: str, axis: str) -> str:
    along, up = ("a.dx", "- a.size * a.dy") if axis == "x" else ("a.dy", "+ a.size * a.dx")
    end = f"a.{axis} + a.adv * {along}"
    return f"array_{f}(transform(part, a -> {pick}(a.{axis}, {end}, a.{axis} {up}, {end} {up})))"


#: The box of the letters in an array called part.
BOX = f"'l', {_corner('min', 'least', 'x')}, 'b', {_corner('min', 'least', 'y')}, 'r', {_corner('max', 'greatest', 'x')}, 't', {_corner('max', 'greatest', 'y')}"


def marks(letters: str = "letters") -> Column:
    """array<int> for each letter: 2 blank, 1 first of a word, 0 goes on with the word."""
    a = letters
    return F.expr(f"transform({a}, (c, i) -> if({blank('c')}, 2, if(i = 0 OR {blank(f'{a}[i - 1]')} OR {breaks(f'{a}[i - 1]', 'c')}, 1, 0)))")


def words(letters: str = "letters", marked: str = "marks", boxes: bool = True) -> Column:
    """array<struct<word, first, last, text, n_letters, l, b, r, t, size, dx, dy, mcid>> of a page's letters, in content order.

    A blank letter (null, empty or white space) ends a word and belongs to none. Two neighbours part where their
    directions differ, one lies off the other's line, or the gap is wide; fonts don't count. Size, direction and
    mcid are the first letter's; first and last are letter places. No letters give no words; null gives null.
    Without boxes only word, first, last, text and n_letters are made. marked names the column of marks().
    """
    a, m = letters, marked
    places = f"if(size({a}) > 0, sequence(0, size({a}) - 1), cast(array() as array<int>))"
    begin = f"filter({places}, i -> {m}[i] = 1)"
    end = f"filter({places}, i -> {m}[i] <> 2 AND (i = size({a}) - 1 OR {m}[i + 1] <> 0))"
    cut = f"zip_with({begin}, {end}, (b, e) -> named_struct('b', b, 'e', e, 'part', slice({a}, b + 1, e - b + 1)))"
    head = "z.part[0]"
    one = "'word', k, 'first', z.b, 'last', z.e, 'text', array_join(transform(z.part, a -> a.value), ''), 'n_letters', z.e - z.b + 1"
    if boxes:
        one += ", " + BOX.replace("part", "z.part") + f", 'size', {head}.size, 'dx', {head}.dx, 'dy', {head}.dy, 'mcid', {head}.mcid"
    return F.expr(f"transform({cut}, (z, k) -> named_struct({one}))")


def page_words(pages: DataFrame, boxes: bool = True) -> DataFrame:
    """pages (doc_id, page, letters) with words instead of letters. Nothing is shuffled."""
    marked = settled(pages, marks=marks("letters"))
    return settled(marked, words=words("letters", "marks", boxes)).select("doc_id", "page", "words")


def word_rows(pages: DataFrame) -> DataFrame:
    """A row for each word of pages with a column words."""
    return pages.select("doc_id", "page", F.inline("words"))
