"""Operator 9: substring dedup by level-wise doubling of repeated windows of words."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, table

#: Words of a window.
WINDOW = 13
#: Words of the first level's windows, which are doubled (here once: 7, then 13 = 2 * 7 - 1).
SEED = 7
#: Entries of the memory of word hashes in a task, after which it starts anew.
MEMORY = 500_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _Words(dict):
    """Word to its XXH64."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[k]
    return x ^ (x >> np.uint64(29))


def _windows(hashes: np.ndarray, length: int, k: int = 0) -> np.ndarray:
    """A hash of each window of length words, by doubling: that of 2n words from those of n and n, a rest overlapping."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    level, n = _mix(hashes, k), 1
    while n < length:
        step = min(n, length - n)
        a, b = level[: len(level) - step], level[step:]
        level, n = _mix(a * _MIX[(k + 1) % 4] + b, (k + 2) % 4), n + step
    return level


def _minimizers(seeds: np.ndarray, per: int) -> np.ndarray:
    """For each run of per seeds the place of its least (the first of equals)."""
    if len(seeds) < per:
        return np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(seeds, per)
    return runs.argmin(axis=1) + np.arange(len(runs))


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at the six ASCII spaces alone


def _hashes(words: list[bytes], memory: _Words) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


def _read(batch, memory: _Words):
    """(doc_id, hashes, marks) of each row that has an id and, where the batch has marks, some of them. Copies are left out."""
    marks = batch.column("marks").to_pylist() if "marks" in batch.schema.names else [True] * batch.num_rows
    for doc, copy, text, kept in zip(batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist(), batch.column("text").to_pylist(), marks):
        if doc is not None and kept and not copy:
            yield doc, _hashes(_split(text), memory), kept


def _pair(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """80 bits for each window: a long and a short."""
    return _windows(hashes, length).view(np.int64), (_windows(hashes, length, 1) >> np.uint64(49)).astype(np.int16)


def _alive(hashes: np.ndarray, length: int, marks) -> np.ndarray:
    """Which windows of length words are among marks (their hashes)."""
    return np.isin(_windows(hashes, length).view(np.int64), np.array(marks, np.int64))


SPOT = "hash long, check short, doc_id long, apart long, known boolean"


def _spots(chunks):
    """Rows of one batch: each document's distinct windows, with what the batch alone can tell of them.

    known: another document of the batch has the window. A document that isn't the smallest of the batch to have it
    needs no meeting with other batches; apart (its id) deals its row elsewhere. So one row a window and batch meets,
    whatever the number of documents that share it.
    """
    import pyarrow as pa

    h, c, d = (np.concatenate([x[i] for x in chunks]) if chunks else np.zeros(0, t) for i, t in enumerate((np.int64, np.int16, np.int64)))
    order = np.lexsort((d, c, h))
    h, c, d = h[order], c[order], d[order]
    first = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])) if len(h) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    low, high = d[starts][group], d[np.append(starts[1:], len(d)) - 1][group] if len(d) else d
    return pa.RecordBatch.from_arrays(
        [pa.array(h), pa.array(c), pa.array(d), pa.array(d, mask=d == low), pa.array(low < high)], names=[x.split()[0] for x in SPOT.split(", ")]
    )


def _chunk(a: np.ndarray, b: np.ndarray, doc: int):
    _, once = np.unique(a, return_index=True)
    return a[once], b[once], np.full(len(once), doc)


def _first_level(window: int, seed: int):
    """Spots of the minimizing seeds: of the windows of seed words in each window, that of the least hash.

    48 bits tell seeds apart; two that share them only make windows that the next level drops.
    """

    def run(batches):
        memory = _Words()
        for batch in batches:
            chunks = []
            for doc, hashes, _ in _read(batch, memory):
                level = _windows(hashes, seed) >> np.uint64(16)
                at = np.unique(_minimizers(level, window - seed + 1))
                chunks.append(_chunk(level[at].view(np.int64), np.zeros(len(at), np.int16), doc))
            yield _spots(chunks)

    return run


def _second_level(window: int, seed: int):
    """Spots of the windows whose minimizing seed is repeated (marks)."""

    def run(batches):
        memory = _Words()
        for batch in batches:
            chunks = []
            for doc, hashes, kept in _read(batch, memory):
                level = _windows(hashes, seed) >> np.uint64(16)
                at = _minimizers(level, window - seed + 1)
                alive = np.isin(level[at].view(np.int64), np.array(kept, np.int64))
                a, b = _pair(hashes, window)
                chunks.append(_chunk(a[alive], b[alive], doc))
            yield _spots(chunks)

    return run


def _doubled(length: int):
    """Spots of the windows of twice length words whose halves are both repeated (marks)."""

    def run(batches):
        memory = _Words()
        for batch in batches:
            chunks = []
            for doc, hashes, kept in _read(batch, memory):
                if len(hashes) < 2 * length:
                    continue
                alive = _alive(hashes, length, kept)
                alive = alive[:-length] & alive[length:]
                a, b = _pair(hashes, 2 * length)
                chunks.append(_chunk(a[alive], b[alive], doc))
            yield _spots(chunks)

    return run


def _met(spots: DataFrame) -> DataFrame:
    meet = W.partitionBy("hash", "check", "apart")
    return spots.withColumns({"low": F.min("doc_id").over(meet), "high": F.max("doc_id").over(meet)})


def _shared(spots: DataFrame) -> DataFrame:
    """Spots of windows that several documents have."""
    return _met(spots).where("known OR low < high")


def _later(spots: DataFrame) -> DataFrame:
    """Spots of windows that a smaller document has."""
    return _met(spots).where("apart IS NOT NULL OR low < doc_id")


def _marked(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """docs (doc_id, text, copy) with marks: the hashes of windows of spots that the document has, null for none.

    Marks belong to a doc_id, so rows that share one may get each other's: whether a smaller document
    has a window does not depend on the row. A document has no more marks than words.
    """
    marks = spots.groupBy("doc_id").agg(F.collect_list("hash").alias("marks"))
    return docs.join(marks, "doc_id", "left").select("doc_id", "text", "copy", "marks")


def _texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text, copy): copy is true for a row whose whole text a smaller doc_id has.

    A copy's windows are all repeated, and its smallest original has them too, so copies stay out of the levels. Only
    hashes of texts (128 bits) meet; groups are counted where they are read, and the join back is between written
    tables, which adaptive execution broadcasts or splits where one text has very many copies.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = scratch.keep(docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("k"), F.xxhash64(F.lit(1), "text").alias("k1")))
    first = ids.groupBy("k", "k1").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    copies = ids.join(scratch.keep(first), ["k", "k1"]).where("low < doc_id").groupBy("doc_id").agg(F.collect_set("k").alias("ks"))
    copies = scratch.keep(copies)
    rows = docs.join(copies, "doc_id", "left")
    return rows.select("doc_id", "text", F.coalesce(F.array_contains("ks", F.xxhash64("text")), F.lit(False)).alias("copy"))


def _windows_at(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """Spots of windows after two levels: seeds, then windows of twice that length (or less)."""
    seeds = _shared(docs.mapInArrow(_first_level(window, seed), SPOT))
    return _marked(docs, seeds).mapInArrow(_second_level(window, seed), SPOT)


def _cover(window: int):
    def run(batches):
        import pyarrow as pa

        memory = _Words()
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            for text, copy, marks in zip(*(batch.column(c).to_pylist() for c in ("text", "copy", "marks"))):
                words = kept = _split(text)
                if copy and len(words) >= window:
                    kept = []
                elif marks and not copy:
                    at = np.flatnonzero(_alive(_hashes(words, memory), window, marks))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): a row for each row of docs, without words that a smaller document has too.

    Words are runs of other characters than ASCII white space. A word goes if it lies in a window of
    ``window`` words that also starts in a document with a smaller doc_id; windows are judged on the input.
    kept_text joins the other words by one space. Null or empty text: no words and an empty text. A null
    doc_id is no document: its row loses nothing and takes nothing from others. Rows that repeat a
    doc_id don't count against each other. No rows give no rows. Only doc_id and text are read.

    Levels: of each window the seed (7 words) with the least hash; the windows around seeds that
    several documents have; of those, the ones of a smaller document. Windows are told apart by 80 bits of hash.
    Whole copies are known beforehand. Texts are shuffled once, by id, and all levels read that shuffle; a task
    holds one batch.
    """
    texts = _texts(docs, Scratch(docs.sparkSession))
    spots = _later(_windows_at(texts, window, seed))
    return _marked(texts, spots).mapInArrow(_cover(window), "doc_id long, n_words long, n_removed long, kept_text string")


def longest_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, length) of documents with windows that other documents have: the greatest of window, 2 * window, ... words.

    Doubles the length until no candidate survives; each level's survivors are a written table. Lengths
    between two levels count as the lower one. Rules for nulls and repeated rows as in remove_repeats.
    """
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("copy"))
    alive = scratch.keep(_shared(_windows_at(plain, window, seed)).select("doc_id", "hash"))
    length, found = window, None
    while not alive.isEmpty():
        level = alive.select("doc_id", F.lit(length).cast("long").alias("length")).distinct()
        found = level if found is None else found.union(level)
        spots = _marked(plain, alive).where("marks IS NOT NULL").mapInArrow(_doubled(length), SPOT)
        alive = scratch.keep(_shared(spots).select("doc_id", "hash"))
        length *= 2
    if found is None:
        return alive.select("doc_id", F.lit(length).cast("long").alias("length"))
    return found.groupBy("doc_id").agg(F.max("length").alias("length"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), m AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS low FROM p) WHERE low < doc_id
), c AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM m, (SELECT unnest(range(0, 13)) AS k)
), t AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM d
), k AS (
  SELECT t.doc_id, string_agg(x, ' ' ORDER BY t.pos) AS kept, count(*) AS n FROM t ANTI JOIN c ON t.doc_id = c.doc_id AND t.pos = c.pos GROUP BY t.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
