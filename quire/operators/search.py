"""Literal and pattern search in texts, boxes of matches, and regions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import kept
from ..sources.tables import settled
from . import assembly, lines, words
from .assembly import Source

#: Needles that are broadcast at a time.
NEEDLES = 10_000
#: Matches that a search may give before it is an error.
MATCHES = 10_000


def _plain(text: str) -> str:
    """text with each character in upper case, where that is one character: places stay."""
    up = text.upper()
    return up if len(up) == len(text) else "".join(u if len(u := c.upper()) == 1 else c for c in text)


class Finder:
    """Literals and patterns (target, text, whether a pattern) that are looked for together in one pass over a text, and one for each pattern."""

    def __init__(self, targets: list[tuple], case: bool = True):
        self.case, self._ready = case, None
        self.patterns = [(t, x) for t, x, pattern in targets if pattern and x]
        self.literals: dict[str, list] = {}
        for t, x, pattern in targets:
            if not pattern and x:
                self.literals.setdefault(x if case else _plain(x), []).append(t)

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def __call__(self, text: str) -> list[tuple]:
        """(target, start, length) of matches, of each target from the left and without overlap; matches of no length don't count."""
        if self._ready is None:
            automaton = None
            if self.literals:
                import ahocorasick

                automaton = ahocorasick.Automaton()
                for x in self.literals:
                    automaton.add_word(x, x)
                automaton.make_automaton()
            self._ready = automaton, [(t, re.compile(x, 0 if self.case else re.I)) for t, x in self.patterns]
        automaton, patterns = self._ready
        out, free = [], {}
        if automaton is not None:
            for end, x in automaton.iter(text if self.case else _plain(text)):
                start = end - len(x) + 1
                if start >= free.get(x, 0):
                    free[x] = end + 1
                    out += [(t, start, len(x)) for t in self.literals[x]]
        out += [(t, m.start(), m.end() - m.start()) for t, p in patterns for m in p.finditer(text) if m.end() > m.start()]
        return out


def find_matches(texts: DataFrame, targets: DataFrame, key: str, case: bool = True) -> DataFrame:
    """(key, target, start, length): matches of every target (target, needle, pattern) in every text (key, text).

    Targets (a redaction's; some thousands) are counted and go to the tasks in blocks of about NEEDLES. All literals of a block are found in one
    pass over a text, whatever their number. An empty needle and a null text match nothing. Without case, letters of either case are equal.
    """
    blocks = -(-targets.count() // NEEDLES) or 1
    kinds = dict(targets.select("target").dtypes) | dict(texts.select(key).dtypes)
    parts = []
    for i in range(blocks):
        some = targets.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == i) if blocks > 1 else targets
        parts.append(texts.select(key, "text").mapInArrow(_searched(Finder([tuple(r) for r in some.select("target", "needle", "pattern").collect()], case), key, some.schema["target"].dataType), f"{key} {kinds[key]}, target {kinds['target']}, start int, length int"))
    return reduce(DataFrame.union, parts)


def _searched(finder: Finder, key: str, kind):
    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text and (some := finder(text)):
                    rows += [i] * len(some)
                    found += some
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(rows, pa.int64())), pa.array(columns[0], to_arrow_type(kind)), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())],
                names=[key, "target", "start", "length"],
            )

    return run


def literal_matches(texts: DataFrame, needles: DataFrame, key: str, case: bool = True) -> DataFrame:
    """(key, target, start, length): matches of every needle (target, needle) in every text (key, text)."""
    return find_matches(texts, needles.withColumn("pattern", F.lit(False)), key, case)


def indexed_text(pages: DataFrame, columns: bool = True) -> DataFrame:
    """pages (doc_id, page, letters) with text, the page's words in reading order, and of, for each of its characters the place of the letter it comes from.

    Blanks and line ends between words come from no letter (null). Without columns, pages are not parted by gutters.
    """
    marked = settled(pages.select("doc_id", "page", "letters"), marks=words.marks("letters"))
    made = settled(marked, words=words.words("letters", "marks")).select("doc_id", "page", "letters", "words")
    ordered = lines.in_reading_order(made, columns=columns, keep=["letters"])
    own = "flatten(transform(sequence(words[w.word].first, words[w.word].last), k -> array_repeat(k, length(letters[k].value))))"
    of = f"flatten(transform(ordered, (w, i) -> concat(if(i = 0, cast(array() AS array<int>), array(cast(null AS int))), {own})))"
    return ordered.select("doc_id", "page", "letters", F.expr(lines.page_text()).alias("text"), F.expr(of).alias("of"))


def match_boxes(indexed: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target, start, l, b, r, t): the box of the letters that each match covers; a match of blanks alone has none.

    indexed as indexed_text gives it; matches (keys, target, start, length) count its text's characters.
    """
    part = "transform(filter(slice(of, start + 1, length), k -> k IS NOT NULL), k -> letters[k])"
    met = settled(matches.join(indexed.select(*keys, "letters", "of"), keys), part=F.expr(part)).where("size(part) > 0")
    return met.select(*keys, "target", "start", F.expr(f"named_struct({words.BOX})").alias("_b")).select(*keys, "target", "start", "_b.*")


def regions(pages: DataFrame | Source, targets: DataFrame, case: bool = True, columns: bool = True, most: int = MATCHES) -> tuple[DataFrame, DataFrame]:
    """(regions, matches) of a redaction: targets (target, needle, pattern) and, where needle is null, boxes (page, l, b, r, t) of every document that has the page.

    Texts and patterns are looked for in the text in reading order, their boxes and the given ones are united where they overlap. A
    document with more matches than most is an error, and so is a box on a page that no document has. Pages are read for their text, and
    those with a match again for the boxes.
    """
    held = assembly.source(pages)
    at = assembly.read_texts(held, columns).select(F.struct("doc_id", "page").alias("at"), "text")
    texts = targets.where("needle IS NOT NULL").select("target", "needle", "pattern")
    found = kept(capped(find_matches(at, texts, "at", case).select("at.doc_id", "at.page", "target", "start", "length"), "doc_id", most))
    every = match_boxes(indexed_text(held.nested(found), columns), found, ["doc_id", "page"])
    given = kept(targets.where("needle IS NULL").select("target", F.col("page").alias("_page"), "l", "b", "r", "t"))
    if not given.isEmpty():
        listed = held.nested(None).select("doc_id", "page")
        missing = given.join(listed, F.col("_page") == F.col("page"), "left_anti").first()
        if missing:
            raise ValueError(f"no document has page {missing['_page']}")
        every = every.unionByName(listed.join(F.broadcast(given), F.col("_page") == F.col("page")).select("doc_id", "page", "target", F.lit(None).cast("int").alias("start"), "l", "b", "r", "t"))
    every = kept(every)
    united = kept(closure_2d(every.select(F.struct("doc_id", "page").alias("at"), "l", "b", "r", "t"), "at").select("at.doc_id", "at.page", "l", "b", "r", "t"))
    return united, every


def redact(pages: DataFrame | Source, targets: DataFrame, annotations: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, regions, summary): pages without the letters that overlap a region, the regions, and (doc_id, matches, regions, letters, annotations) removed.

    annotations (doc_id, page, id, l, b, r, t) that overlap a region go as a whole. Letters go by their box, touching is not enough. Documents
    without a match are not in the summary, for which only pages with a region are read.
    """
    held = assembly.source(pages)
    united, every = regions(held, targets, **options)
    per_page = united.groupBy("doc_id", "page").agg(F.collect_list(F.struct("l", "b", "r", "t")).alias("_regions"))  # a page's regions, which don't overlap
    box = words.BOX.replace("part", "array(c)")
    hit = f"exists(_regions, q -> exists(array(named_struct({box})), p -> {overlaps('p', 'q')}))"
    left = F.expr(f"if(_regions IS NULL, letters, filter(letters, c -> NOT coalesce({hit}, false)))")
    removed = held.nested(united).join(per_page, ["doc_id", "page"]).withColumn("_left", left).groupBy("doc_id").agg(F.sum(F.size("letters") - F.size("_left")).alias("letters"))
    counts = every.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matches"))
    counts = counts.join(united.groupBy("doc_id").agg(F.count(F.lit(1)).alias("regions")), "doc_id").join(removed, "doc_id")
    if annotations is None:
        counts = counts.withColumn("annotations", F.lit(0).cast("long"))
    else:
        gone = united.withColumnsRenamed({c: f"_{c}" for c in ("l", "b", "r", "t")}).join(annotations, ["doc_id", "page"]).where("_l < r AND l < _r AND _b < t AND b < _t")
        wiped = gone.select("doc_id", "id").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("annotations"))
        counts = counts.join(wiped, "doc_id", "left").withColumn("annotations", F.coalesce("annotations", F.lit(0)))
    kept = held.nested(None).join(per_page, ["doc_id", "page"], "left").select("doc_id", "page", left.alias("letters"))
    return kept, united, counts.select("doc_id", "matches", "regions", "letters", "annotations")


def overlaps(a: str, b: str) -> str:
    """SQL: whether two boxes share more than an edge."""
    return f"{a}.l < {b}.r AND {b}.l < {a}.r AND {a}.b < {b}.t AND {b}.b < {a}.t"


def overlap_join(left: DataFrame, right: DataFrame, key: str, cell: float) -> DataFrame:
    """Pairs of boxes (key, id, l, b, r, t) with equal key that overlap, as (key, left_id, right_id).

    A box goes to the cells, two at most on each axis, of the least width and the least height cell * 2**k that are no less than its own, and
    looks for wider and higher ones in the cells of each greater width and height that some box has (these, some dozens at most, are listed first). cell is
    the least width and height. Boxes of a cell meet by an equi-join; a pair counts in the cell of the wider width and the
    greater height where the later of the two left edges and of the two lower ones lie, so it is found once.
    """
    grade = lambda low, high: F.ceil(F.log2(F.greatest(F.abs(F.col(high) - F.col(low)) / cell, F.lit(1.0)))).cast("int")
    sides = [x.select(key, "id", "l", "b", "r", "t", grade("l", "r").alias("_w"), grade("b", "t").alias("_h")) for x in (left, right)]
    listed = [{tuple(r) for r in x.where("_w IS NOT NULL AND _h IS NOT NULL").select("_w", "_h").distinct().collect()} for x in sides]

    def levels(k: int):
        """Of one axis those of any box that are no less than a box's own."""
        all_ = sorted({x[k] for side in listed for x in side})
        own = F.col(("_w", "_h")[k])
        return F.filter(F.array(*map(F.lit, all_)) if all_ else F.array().cast("array<int>"), lambda x: x >= own)

    strip = lambda c, k: f"cast(floor({c} / ({cell}D * shiftleft(1L, {k}))) as bigint)"

    def dealt(side: DataFrame, name: str) -> DataFrame:
        rows = side.select(key, F.struct("id", "l", "b", "r", "t", "_w", "_h").alias(name), levels(0).alias("_ws"), levels(1).alias("_hs"))
        rows = rows.select(key, name, F.explode("_ws").alias("_i"), "_hs").select(key, name, "_i", F.explode("_hs").alias("_j"))
        rows = rows.select("*", F.explode(F.expr(f"array_distinct(array({strip(name + '.l', '_i')}, {strip(name + '.r', '_i')}))")).alias("_x"))
        return rows.select("*", F.explode(F.expr(f"array_distinct(array({strip(name + '.b', '_j')}, {strip(name + '.t', '_j')}))")).alias("_y"))

    met = dealt(sides[0], "p").join(dealt(sides[1], "q"), [key, "_i", "_j", "_x", "_y"])
    hit = (
        f"_i = greatest(p._w, q._w) AND _j = greatest(p._h, q._h) AND {overlaps('p', 'q')}"
        f" AND _x = {strip('greatest(p.l, q.l)', '_i')} AND _y = {strip('greatest(p.b, q.b)', '_j')}"
    )
    return met.where(hit).select(key, F.col("p.id").alias("left_id"), F.col("q.id").alias("right_id"))


def closure_1d(spans: DataFrame, key: list[str]) -> DataFrame:
    """(key, l, r): spans (key, l, r) with overlapping ones united until none overlap. Touching spans stay apart."""
    order = W.partitionBy(*key).orderBy("l", "r")
    reach = F.max("r").over(order.rowsBetween(W.unboundedPreceding, -1))
    flagged = spans.select(*key, "l", "r", F.when(reach.isNull() | (F.col("l") >= reach), 1).otherwise(0).alias("_new"))
    island = flagged.select(*key, "l", "r", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("_k"))
    return island.groupBy(*key, "_k").agg(F.min("l").alias("l"), F.max("r").alias("r")).drop("_k")


def closure_2d(boxes: DataFrame, key: str) -> DataFrame:
    """(key, l, b, r, t): boxes of a page united while any two overlap, until none do. The result doesn't depend on order.

    A page's boxes are in one task (pages hold few regions); pages spread over tasks. Each pass grows every box by those that overlap it, which
    a sweep from the left finds, so that passes grow with the logarithm of the longest chain; equal boxes are one.
    """

    def sweep(pdf):
        import numpy as np
        import pandas as pd

        at = np.unique(pdf[["l", "b", "r", "t"]].to_numpy(float), axis=0)  # in order of l
        while True:
            grown = at.copy()
            ends = np.searchsorted(at[:, 0], at[:, 2], side="left")  # boxes from here on start right of the box
            for i in range(len(at)):
                near = at[i + 1 : ends[i]]
                hit = np.flatnonzero((near[:, 2] > at[i, 0]) & (near[:, 1] < at[i, 3]) & (at[i, 1] < near[:, 3])) + i + 1
                if len(hit):
                    low, high = at[hit, :2].min(axis=0), at[hit, 2:].max(axis=0)
                    grown[i, :2], grown[i, 2:] = np.minimum(grown[i, :2], low), np.maximum(grown[i, 2:], high)
                    grown[hit, :2], grown[hit, 2:] = np.minimum(grown[hit, :2], at[i, :2]), np.maximum(grown[hit, 2:], at[i, 2:])
            grown = np.unique(grown, axis=0)
            if grown.shape == at.shape and (grown == at).all():
                break
            at = grown
        return pd.DataFrame({"_p": pdf["_p"].iloc[0], **dict(zip("lbrt", at.T))})

    kind = dict(boxes.dtypes)[key]
    packed = boxes.select(F.to_json(F.struct(key)).alias("_p"), "l", "b", "r", "t")
    united = packed.groupBy("_p").applyInPandas(sweep, "_p string, l double, b double, r double, t double")
    return united.select(F.from_json("_p", f"{key} {kind}")[key].alias(key), "l", "b", "r", "t")


def capped(matches: DataFrame, key: str, most: int = MATCHES) -> DataFrame:
    """matches, or an error as it runs if a key has more than most."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    checked = F.when(n > most, F.raise_error(F.lit("more matches than allowed")).cast("boolean")).otherwise(True)
    return matches.withColumn("_ok", checked).where("_ok").drop("_ok")


def scrub(surfaces: dict[str, DataFrame], pattern: str, by: str) -> DataFrame:
    """(surface, id, scrubbed, value): values (id, value) of all surfaces with matches of pattern replaced, and how many there were."""
    parts = [
        d.select(F.lit(s).alias("surface"), "id", F.regexp_count("value", F.lit(pattern)).alias("scrubbed"), F.regexp_replace("value", pattern, by).alias("value"))
        for s, d in surfaces.items()
    ]
    return reduce(DataFrame.unionByName, parts)
