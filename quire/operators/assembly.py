"""Words, bands and texts of many pages at once, on Arrow arrays: the rules of words, lines and order, where no nested pages are wanted."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import order
from .words import ACROSS, ALONG, COSINE, LEAST_SIZE

BLANKS = " \t\r\n\x0c\u00a0"
NUMBERS = ("x", "y", "adv", "size", "dx", "dy")
BOX = ("l", "b", "r", "t")
#: Bytes of text that are worked on at a time.
PIECE = 1 << 20

_SOLID = np.ones(256, np.bool_)
_SOLID[[ord(c) for c in BLANKS if ord(c) < 128]] = False


class Letters(NamedTuple):
    """Letters of pages, one page after the other: at has each page's first letter and the end; numbers are arrays of as many as values."""

    at: np.ndarray
    values: pa.Array
    x: np.ndarray
    y: np.ndarray
    adv: np.ndarray
    size: np.ndarray
    dx: np.ndarray
    dy: np.ndarray


class Words(NamedTuple):
    """Words of pages: at has each page's first word and the end; first and last are letters; box has l, b, r and t, or nothing."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    texts: pa.Array
    box: tuple


class Source(NamedTuple):
    """Pages that Python makes of a frame's batches: read gives (doc_id, page, Letters), nested the pages (doc_id, page, letters) of some keys (doc_id, page), or all."""

    frame: DataFrame
    kinds: tuple[str, str]
    read: Callable[[pa.RecordBatch], Iterator[tuple[pa.Array, pa.Array, Letters]]]
    nested: Callable[[DataFrame | None], DataFrame]


def source(pages: DataFrame | Source) -> Source:
    """The source of pages (doc_id, page, letters)."""
    if isinstance(pages, Source):
        return pages
    kinds = dict(pages.dtypes)
    flat = pages.selectExpr("doc_id", "page", *[f"letters.{c} AS {c}" for c in ("value", *NUMBERS)])
    held = lambda keys: pages if keys is None else pages.join(keys.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    return Source(flat, (kinds["doc_id"], kinds["page"]), _flat, held)


def _flat(batch: pa.RecordBatch):
    for part in pieces(batch, "value"):
        lists = part.column("value")
        count = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(np.asarray(lists.offsets)))
        numbers = [np.asarray(pc.cast(part.column(c).flatten(), pa.float64()).to_numpy(zero_copy_only=False)) for c in NUMBERS]
        yield part.column("doc_id"), part.column("page"), Letters(np.append(0, np.cumsum(count)), lists.flatten().cast(pa.string()), *numbers)


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """batch in slices whose column (texts, or lists) holds about PIECE bytes or items at most, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)) if pa.types.is_string(batch.column(column).type) or pa.types.is_binary(batch.column(column).type) else pc.list_value_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array."""
    _, places, data = values.buffers()
    off = np.frombuffer(places, np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def blanks(values: pa.Array) -> np.ndarray:
    """Whether each letter is null, empty or white space."""
    off, data = _bytes(values)
    low = int(off[0])
    data = data[low : int(off[-1])]
    solid = _SOLID[data]
    if len(data) > 1:
        wide = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] == 0xA0))
        solid[wide] = solid[wide + 1] = False
    if len(data) == len(values) and not values.null_count and (np.diff(off) == 1).all():
        return ~solid
    held = np.append(0, np.cumsum(solid, dtype=np.int32))
    blank = held[off[1:] - low] == held[off[:-1] - low]
    return blank | values.is_null().to_numpy(zero_copy_only=False) if values.null_count else blank


def starts_and_blanks(first: np.ndarray, values: pa.Array, x, y, adv, size, dx, dy) -> tuple[np.ndarray, np.ndarray]:
    """Whether each letter begins a word, and whether it is blank; first tells the first letter of each page. Missing numbers end no word."""
    blank = blanks(values)
    cut = first.copy()
    if len(cut) > 1:
        reach = np.fmax(np.fmax(size[1:], size[:-1]), LEAST_SIZE)
        ox, oy, px, py = x[1:] - x[:-1], y[1:] - y[:-1], dx[:-1], dy[:-1]
        cut[1:] |= blank[:-1] | (px * dx[1:] + py * dy[1:] < COSINE) | (np.abs(oy * px - ox * py) > ACROSS * reach) | (ox * px + oy * py - adv[:-1] > ALONG * reach)
    return cut & ~blank, blank


def assembled(letters: Letters, boxes: bool = True) -> Words:
    """The words of each page, in content order: what words.words gives."""
    n = len(letters.values)
    begins = np.zeros(n, np.bool_)
    begins[letters.at[:-1][np.diff(letters.at) > 0]] = True
    start, blank = starts_and_blanks(begins, *letters[1:])
    first = np.flatnonzero(start)
    shown = np.flatnonzero(~blank)
    heads = np.searchsorted(shown, first)
    last = shown[np.append(heads[1:], len(shown))[: len(heads)] - 1]
    off, data = _bytes(letters.values)
    low = int(off[0])
    mine = np.repeat(~blank, np.diff(off)) if n else np.zeros(0, np.bool_)
    long = np.append(0, np.cumsum(off[last + 1] - off[first], dtype=np.int64)).astype(np.int32)
    texts = pa.StringArray.from_buffers(len(first), pa.py_buffer(long), pa.py_buffer(data[low : int(off[-1])][mine]))
    box = ()
    if boxes:
        x, y, adv, size, dx, dy = (v[shown] for v in letters[2:])
        ex, ey, ux, uy = x + adv * dx, y + adv * dy, -size * dy, size * dx
        low_high = []
        for a, b, u in ((x, ex, ux), (y, ey, uy)):
            c, d = a + u, b + u
            low_high.append([np.minimum(np.minimum(a, b), np.minimum(c, d)), np.maximum(np.maximum(a, b), np.maximum(c, d))])
        (l, r), (b, t) = low_high
        box = tuple(f.reduceat(c, heads) if len(heads) else c[:0] for f, c in ((np.minimum, l), (np.minimum, b), (np.maximum, r), (np.maximum, t)))
    return Words(np.searchsorted(first, letters.at), first, last, texts, box)


def _pages(at: np.ndarray) -> np.ndarray:
    """The page of each item."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def _mapped(pages: DataFrame | Source, columns: str, make) -> DataFrame:
    """Batches of (doc_id, page) and columns: make(letters) gives the page of each row, and the columns' arrays."""
    held = source(pages)
    read = held.read
    names = ["doc_id", "page", *(c.split()[0] for c in columns.split(", "))]

    def run(batches):
        for batch in batches:
            for doc, page, letters in read(batch):
                of, *arrays = make(letters)
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays([doc.take(take), page.take(take), *arrays], names=names)

    return held.frame.mapInArrow(run, f"doc_id {held.kinds[0]}, page {held.kinds[1]}, {columns}")


def word_rows(pages: DataFrame | Source, boxes: bool = True) -> DataFrame:
    """(doc_id, page, word, text, n_letters) and, with boxes, l, b, r and t: a row for each word of pages (doc_id, page, letters), in content order.

    What words.page_words and words.word_rows give, by arrays: only the letters' columns go to Python, and rows of words come back.
    """

    def make(letters: Letters):
        found = assembled(letters, boxes)
        of = _pages(found.at)
        return of, pa.array(np.arange(len(of)) - found.at[of], pa.int32()), found.texts, pa.array(found.last - found.first + 1, pa.int32()), *map(pa.array, found.box)

    return _mapped(pages, "word int, text string, n_letters int" + (", l double, b double, r double, t double" if boxes else ""), make)


def lists(at: np.ndarray, arrays: dict[str, pa.Array]) -> pa.Array:
    """A list of structs for each page."""
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(list(arrays.values()), names=list(arrays)))


def word_votes(pages: DataFrame | Source) -> DataFrame:
    """(doc_id, page, words: array<struct<word, n_letters>>): a row a page with the lengths of its words, in content order."""

    def make(letters: Letters):
        found = assembled(letters, False)
        word = np.arange(len(found.first)) - found.at[_pages(found.at)]
        held = {"word": pa.array(word, pa.int32()), "n_letters": pa.array(found.last - found.first + 1, pa.int32())}
        return np.arange(len(found.at) - 1), lists(found.at, held)

    return _mapped(pages, "words array<struct<word:int,n_letters:int>>", make)


def _bands(letters: Letters, found: Words) -> np.ndarray:
    return order.page_bands(_pages(found.at), (found.box[1] + found.box[3]) / 2, letters.size[found.first])


def band_rows(pages: DataFrame | Source) -> DataFrame:
    """(doc_id, page, word, band): the line band of each word, as lines.with_bands gives it."""

    def make(letters: Letters):
        found = assembled(letters)
        of = _pages(found.at)
        return of, pa.array(np.arange(len(of)) - found.at[of], pa.int32()), pa.array(_bands(letters, found), pa.int32())

    return _mapped(pages, "word int, band int", make)


def _joined(texts: pa.Array, page: np.ndarray, line: np.ndarray, pages: int) -> pa.Array:
    """A text a page of words in order: a blank between words of a line, a newline between lines. page and line don't fall."""
    if not len(texts):
        return pa.array([""] * pages, pa.string())
    heads = np.flatnonzero(np.append(True, (np.diff(page) != 0) | (np.diff(line) != 0)))
    rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(heads, len(texts)), pa.int32()), texts), " ")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(page[heads], np.arange(pages + 1)), pa.int32()), rows), "\n")


def band_texts(pages: DataFrame | Source) -> DataFrame:
    """(doc_id, page, page_text): lines of each page that has words by bands, and their words from the left."""

    def make(letters: Letters):
        found = assembled(letters)
        page, band = _pages(found.at), _bands(letters, found)
        by = np.lexsort((found.box[0], band, page))
        text = _joined(found.texts.take(pa.array(by)), page, band[by], len(found.at) - 1)
        some = np.flatnonzero(np.diff(found.at))
        return some, text.take(pa.array(some))

    return _mapped(pages, "page_text string", make)


def read_texts(pages: DataFrame | Source, columns: bool = True) -> DataFrame:
    """(doc_id, page, text): the words of every page in reading order, as lines.in_reading_order and lines.page_text give them."""

    def make(letters: Letters):
        found = assembled(letters)
        col, band, at = order.places(found.at, *found.box, letters.size[found.first], columns=columns)
        page = _pages(found.at)
        line = np.cumsum(np.append(False, (np.diff(col) != 0) | (np.diff(band) != 0))) if len(page) else page
        return np.arange(len(found.at) - 1), _joined(found.texts.take(pa.array(found.at[page] + at)), page, line, len(found.at) - 1)

    return _mapped(pages, "text string", make)

