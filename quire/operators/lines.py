"""Lines, columns and reading order of a page's words, inside the page's row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled
from .order import BAND, BUCKETS, LEAST_BAND, MIDDLE, RUN, reading_order


def bands(words: str = "words") -> str:
    """SQL: array<int>, the line band of each word (in word order) of an upright page.

    Words are swept by the middle of their box, from the top. A word joins the band if its middle lies within half of
    the larger size of it and the band's first word; else it begins a new band. The anchor is the first word, not the
    neighbour, so a slow drift does not chain lines together.
    """
    key = "(({0}.b + {0}.t) / 2)"
    swept = f"array_sort(transform({words}, w -> named_struct('k', -{key.format('w')}, 'word', w.word, 'size', w.size)))"
    joins = f"s.k - acc.k <= greatest({BAND}D * greatest(acc.size, s.size), {LEAST_BAND}D)"
    fold = (
        f"aggregate({swept}, named_struct('k', cast(null as double), 'size', cast(0 as double), 'n', -1, 'out', cast(array() as array<struct<word: int, band: int>>)), "
        f"(acc, s) -> if(acc.n >= 0 AND {joins}, "
        "named_struct('k', acc.k, 'size', acc.size, 'n', acc.n, 'out', concat(acc.out, array(named_struct('word', s.word, 'band', acc.n)))), "
        "named_struct('k', s.k, 'size', s.size, 'n', acc.n + 1, 'out', concat(acc.out, array(named_struct('word', s.word, 'band', acc.n + 1))))), "
        "acc -> transform(array_sort(acc.out), x -> x.band))"
    )
    return fold


def with_bands(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, words) with bands, an int for each word."""
    return settled(pages, bands=F.expr(bands())).select("doc_id", "page", "words", "bands")


def gutter(words: str = "words") -> str:
    """SQL: the place where a page parts into two columns, or null.

    The words' extent is cut into 200 buckets; a run of 5 or more that no word covers, which begins in the middle third,
    is a gutter, parted at its middle. The first such run counts.
    """
    low, high = f"array_min(transform({words}, w -> w.l))", f"array_max(transform({words}, w -> w.r))"
    covered = (
        f"array_distinct(flatten(transform({words}, w -> sequence(greatest(0, least({BUCKETS - 1}, cast(floor((w.l - e.lo) / e.step) as int))), "
        f"greatest(0, least({BUCKETS - 1}, cast(floor((w.r - e.lo) / e.step) as int)))))))"
    )
    free = f"array_except(sequence({MIDDLE[0]}, {MIDDLE[1] - 1}), {covered})"
    runs = f"filter(transform(array(f), y -> y)[0], b -> NOT array_contains(f, b - 1) AND forall(sequence(0, {RUN - 1}), k -> array_contains(f, b + k)))"
    start = f"array_min({runs})"
    length = f"size(filter(f, b -> b >= s AND forall(sequence(s, b), k -> array_contains(f, k))))"
    inner = (
        f"transform(array(named_struct('lo', {low}, 'step', ({high} - {low}) / {BUCKETS})), e -> if(e.step > 0, "
        f"transform(array({free}), f -> transform(array({start}), s -> if(s IS NULL, cast(null as double), e.lo + (s + {length} / 2.0D) * e.step))[0])[0], cast(null as double)))[0]"
    )
    return f"if(size({words}) > 0, {inner}, cast(null as double))"


def in_reading_order(pages: DataFrame, ranks: str | None = None, columns: bool = True, keep: list[str] | None = None) -> DataFrame:
    """pages with ordered: array<struct<col, band, left, word, text>>, the words in reading order.

    A gutter counts only if each side has two bands or more; then all of the first column comes before the second.
    Within a column, bands go from the top (by the highest word), words from the left. With ranks, the name of an array
    column of a rank for each word, bands go by their least rank and words by rank, then from the left. Without columns no gutter is
    looked for. Columns to keep stay, and with any words does too.
    """
    at = settled(pages, _places=reading_order("words", ranks, columns))
    one = "named_struct('col', p.col, 'band', p.band, 'left', words[p.at].l, 'word', words[p.at].word, 'text', words[p.at].text)"
    return at.select("doc_id", "page", *(["words", *keep] if keep else []), F.expr(f"transform(_places, p -> {one})").alias("ordered"))


def page_text(ordered: str = "ordered") -> str:
    """SQL: the page's words in reading order, lines parted by a newline."""
    sep = f"if(i = 0, '', if({ordered}[i - 1].band = w.band AND {ordered}[i - 1].col = w.col, ' ', '\\n'))"
    return f"array_join(transform({ordered}, (w, i) -> concat({sep}, w.text)), '')"


def document_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, page, page_text): pages in order, parted by newlines."""
    parts = F.array_sort(F.collect_list(F.struct("page", "page_text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["page_text"]), "\n").alias("text"))
