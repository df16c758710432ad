"""Operator 2: benchmark decontamination by spaced seeds, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, table

#: A leak: an aligned run of so many tokens of which so many are equal (0.8 of 13 is over 10); of a shorter item, all its tokens and the same share of them.
WINDOW, EQUAL = 13, 11
#: Positions, out of each run of tokens, that a seed hashes; the others may differ. Together the two
#: hit every run of 13 tokens of which any two differ (tests/llm tries all pairs).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))


def need(n: int) -> int:
    """The tokens of an item of n that must be equal in a run of least(n, 13): one of 7 to 12 may differ, none of fewer."""
    return -(-min(n, WINDOW) * EQUAL // WINDOW)


def masks(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks that hit an item of n tokens with as many others as it may have.

    Of a short item every second position, or the rest: a token that differs spoils one of the two. Where none may, all positions.
    """
    if n >= WINDOW:
        return MASKS
    return (tuple(range(0, n, 2)), tuple(range(1, n, 2))) if need(n) < n else (tuple(range(n)),)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _seeds(df: DataFrame, keys: list[str], sizes: list[int], whole: bool) -> DataFrame:
    """A row (keys, pos, seed) for each mask of items of sizes at each place of the column words (long hashes of tokens).

    whole: words are an item's, which has the masks of its own size alone, a short one at its first place alone.
    """
    marked = [(n, m, mask) for n in sizes for m, mask in enumerate(masks(n))]
    shortest = 1 + min(max(mask) for _, _, mask in marked)

    def at(i):
        # a mask of long items may run over the end at the last places: get() gives null there, which no whole run has on both sides
        out = []
        for n, m, mask in marked:
            seed = F.xxhash64(F.lit(n), F.lit(m), *[F.get("words", i + k) for k in mask])
            if whole:
                seed = F.when(F.size("words") >= WINDOW if n >= WINDOW else (F.size("words") == n) & (i == 0), seed)
            elif n < WINDOW and max(mask) >= shortest:
                seed = F.when(i + max(mask) < F.size("words"), seed)
            out.append(seed)
        return F.array(*out)

    last = F.size("words") - shortest
    spots = F.when(last >= 0, F.flatten(F.transform(F.sequence(F.lit(0), last), at)))
    found = df.select(*keys, F.posexplode(spots).alias("_k", "seed"))
    return found.where("seed IS NOT NULL").select(*keys, F.expr(f"_k div {len(marked)}").cast("int").alias("pos"), "seed")


def _hashed(df: DataFrame, text: str, *keys: Column) -> DataFrame:
    return df.select(*keys, tokens(F.col(text)).alias("tokens")).select(
        "*", F.transform("tokens", lambda w: F.xxhash64(w)).alias("words")
    )


FOUND = "doc_id {}, text_key long, item_id long, item_ids array<bigint>, n_equal long, window long, similarity double"


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, text_key, item_id, item_ids, n_equal, window, similarity): each document and benchmark item that share a leak.

    A leak is a run of 13 tokens of an item, set against 13 tokens of the document, of which 11 or more
    are equal; of an item of fewer tokens, all of them, of which the same share must be equal: one may differ in 7 to
    12, none in fewer. Case and punctuation don't count. Items of equal tokens count as one, item_id, the
    smallest of item_ids, which has all in order.
    Null or empty texts match nothing. Null ids stay null in the result. Repeated documents (equal
    id and text) give one row for each item; text_key (a hash of the text) tells apart rows that
    share an id. n_equal is of the best run. Empty tables: no rows. Other columns are not read.

    Documents are exploded to seeds within their task and meet the items' seeds in a join whose
    smaller side is broadcast only after its rows are counted; seeds that hit are reduced to
    (document, item, diagonal) before a shuffle, and only candidates are verified.
    """
    scratch = Scratch(docs.sparkSession)
    items = (
        _hashed(benchmark, item_text, F.col(item_id).cast("long").alias("item_id"))
        .where(F.size("words") > 0)
        .groupBy("tokens", "words")
        .agg(F.min("item_id").alias("item_id"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    )
    items = scratch.keep(items.select("item_id", "item_ids", F.monotonically_increasing_id().alias("item"), "tokens", "words"))
    sizes = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW)).alias("n")).distinct().collect())  # 13 at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], FOUND.format(docs.select(F.col(doc_id)).schema[0].dataType.simpleString()))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keyed = [F.col("doc_id"), F.xxhash64("text").alias("text_key")]

    probes = _seeds(_hashed(rows, "text", *keyed), ["doc_id", "text_key"], sizes, False)
    seeds = _seeds(items, ["item"], sizes, True).select("item", F.col("pos").alias("item_pos"), "seed").distinct()
    hits = probes.join(bounded(scratch.keep(seeds)), "seed").select("doc_id", "text_key", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    hits = scratch.keep(hits)

    small = bounded(hits.select("doc_id", "text_key").distinct().withColumnsRenamed({"doc_id": "_d", "text_key": "_t"}))
    found = (
        rows.withColumn("text_key", F.xxhash64("text"))
        .join(small, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left_semi")
        .dropDuplicates(["doc_id", "text_key"])
    )
    found = scratch.keep(_hashed(found, "text", F.col("doc_id"), F.col("text_key")).drop("tokens"))
    there = hits.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "item", "shift")
    lined = (
        there.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")))
        .join(items.select("item", "item_id", "item_ids", F.col("words").alias("item_words")), "item")
        .select(
            "doc_id",
            "text_key",
            "item_id",
            "item_ids",
            F.least(F.size("item_words"), F.lit(WINDOW)).alias("window"),
            F.expr("transform(item_words, (w, i) -> if(i + shift >= 0 and get(words, i + shift) <=> w, 1, 0))").alias("equal"),
        )
    )
    best = F.expr(
        "aggregate(sequence(0, size(equal) - window), 0, (m, i) -> greatest(m, aggregate(slice(equal, i + 1, window), 0, (a, x) -> a + x)))"
    )
    least = F.ceil(F.col("window") * EQUAL / WINDOW)
    return (
        lined.select("doc_id", "text_key", "item_id", "item_ids", "window", best.alias("n_equal"))
        .where(F.col("n_equal") >= least)
        .groupBy("doc_id", "text_key", "item_id", "item_ids")
        .agg(F.max("n_equal").cast("long").alias("n_equal"), F.max("window").cast("long").alias("window"))
        .withColumn("similarity", F.col("n_equal") / F.col("window"))
    )


def remove(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """docs without the rows that leaks (a result of contaminated) names; all columns stay. Null ids match null ids."""
    bad = leaks.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_d"]) & (F.xxhash64(docs["text"]) == bad["_t"]), "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"), "n_equal", "window", "similarity", F.lit(True).alias("contaminated"))


#: Brute force: every equal token pair on every diagonal, then the best run of 13.
OP2_SQL = r"""
WITH dt AS (
  SELECT doc_id, hash(text) AS k, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM documents
), bt AS (
  SELECT min(item_id) AS item_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, t FROM (
    SELECT DISTINCT item_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM benchmark)
  WHERE t <> '' GROUP BY t
), d AS (
  SELECT doc_id, k, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS pos FROM dt WHERE t <> ''
), b AS (
  SELECT item_id, item_ids, len(string_split(t, ' ')) AS n, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS pos FROM bt
), m AS (
  SELECT d.doc_id, d.k, b.item_id, b.item_ids, b.n, b.pos, d.pos - b.pos AS shift FROM d JOIN b USING (w)
), r AS (
  SELECT *, least(n, 13) AS win,
    count(*) OVER (PARTITION BY doc_id, k, item_id, item_ids, shift ORDER BY pos RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS c
  FROM m
)
SELECT doc_id, item_id, item_ids, max(least(c, win)) AS n_equal, CAST(max(win) AS BIGINT) AS "window",
  CAST(max(least(c, win)) AS DOUBLE) / max(win) AS similarity, TRUE AS contaminated
FROM r GROUP BY doc_id, k, item_id, item_ids HAVING max(c) >= ceil(max(win) * 11 / 13.0)
"""
