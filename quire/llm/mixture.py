"""Operator 6: mixing sources to target weights along a time-varying curriculum, in DataFrame functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, Scratch, free_name, table

#: Weights of the sources in their order, repeated; share of all words to take; most passes over a source.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: How a source's weight moves over the run: its density at position t is 1 + tilt * (2t - 1), tilts in source order, repeated.
TILTS = (0.5, -0.5, 0.0)
#: Documents of a source are ordered in buckets of about this many, each of which is summed in one task.
BUCKET_ROWS = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_size, weight, tilt, target) from (source, size): one row for every source.

    Sources stand in code-point order, null last, and take the weights in turn. The targets share
    ``share`` times all words by weight; none is above ``passes`` times its source's size, and the excess is
    shared again by weight: target = min(passes * size, weight * level). With the sources in order of
    size by weight, the level follows from running sums, without rounds. A sum of sizes of 0 gives targets of 0.
    The windows here order one row a source, whatever the number of documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.select("source", "source_size", nth.alias("nth"))
    per = per.select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).alias("weight"),
        F.element_at(F.array(*map(F.lit, TILTS)), (F.col("nth") % len(TILTS) + 1).cast("int")).alias("tilt"),
    )
    order = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    full = (F.lit(passes) * F.col("source_size")).cast("double")
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    spent = budget - F.lit(passes) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    per = per.select("*", spent.alias("_spent"), left.alias("_left"))
    # the first source, in this order, that the level does not fill sets the level of all after it
    open_ = full * F.col("_left") >= F.col("_spent") * F.col("weight")
    nth_open = F.row_number().over(order)
    per = per.select("*", F.when(open_, nth_open).alias("_open"))
    per = per.select("*", F.min("_open").over(every).alias("_first"), nth_open.alias("_at"))
    at_level = F.col("_at") == F.col("_first")
    spent1, left1 = (F.max(F.when(at_level, F.col(c))).over(every) for c in ("_spent", "_left"))
    target = F.when(F.col("_at") < F.col("_first"), full).otherwise(F.col("weight") * spent1 / left1)
    return per.select("source", "source_size", "weight", "tilt", target.alias("target"))


def place(rows: DataFrame, sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """rows with mix_source_size, mix_target, mix_takes and mix_positions (an entry for each pass).

    rows has doc_id, source, mix_size and any other columns; sizes is (doc_id, source, size) of the same
    rows, as a written table. A source's documents stand in order of the MD5 of their id, then id and
    size; pass p takes those of whose running sum the target covers p source sizes and the rest, the last
    in part, so that a source's taken words are its target rounded to whole words and no document
    exceeds ``passes`` times its size. The position (0 to 1) of a document's first word in a pass is where the
    integral of the source's weight, target * ((1 - tilt) t + tilt t^2), meets the words that the
    source gives before it; null where the pass takes nothing of it.

    Running sums go by buckets of the order's first digits: sums of buckets are added up, then each
    bucket on its own, so that a source with a third of all rows has as many tasks as buckets. Null ids
    order as an empty text; rows equal in id and size stand side by side in any order.
    """
    n = sizes.count()
    digits = max(1, min(8, math.ceil(math.log(max(1, n / BUCKET_ROWS), 16))))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sums = sizes.groupBy("source", F.substring(key, 1, digits).alias("_b")).agg(F.sum("size").alias("bucket_size"))
    start = F.sum("bucket_size").over(W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("source", "_b", F.coalesce(start, F.lit(0)).alias("_start"))
    goal = targets(sizes, weights, share, passes).withColumnRenamed("source", "_s")
    sums = sums.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnRenamed("source", "_s")
    sums = scratch.keep(sums.select(*[F.col(c).alias(f"_mix{c if c[0] == '_' else '_' + c}") for c in ("_s", "_b", "_start", "source_size", "tilt", "target")]))
    rows = rows.withColumns({"_mix_key": key, "_mix_bucket": F.substring(key, 1, digits)})
    within = W.partitionBy("source", "_mix_bucket").orderBy("_mix_key", "doc_id", "mix_size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_mix_before", F.coalesce(F.sum("mix_size").over(within), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_bucket") == F.col("_mix_b")))
    at = F.col("_mix_start") + F.col("_mix_before")
    firsts = [F.lit(p) * F.col("_mix_source_size") + at for p in range(passes)]
    takes = [F.greatest(F.lit(0), F.least(F.col("mix_size"), F.round("_mix_target").cast("long") - x)).cast("long") for x in firsts]
    a = F.col("_mix_tilt")
    positions = []
    for first, take in zip(firsts, takes):
        given = F.try_divide(first, F.col("_mix_target"))
        curve = (a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * given)) / F.nullif(2 * a, F.lit(0.0))
        positions.append(F.when(take > 0, F.when(a == 0, given).otherwise(curve)))
    return rows.withColumns(
        {"mix_source_size": F.col("_mix_source_size"), "mix_target": F.col("_mix_target"), "mix_takes": F.array(*takes), "mix_positions": F.array(*positions)}
    ).drop(*[f"_mix_{c}" for c in ("key", "bucket", "before", "s", "b", "start", "source_size", "tilt", "target")])


def measured(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, source, size) of documents as a written table: texts are read once for it. Null text: size 0."""
    return scratch.keep(docs.select("doc_id", "source", words(F.col("text")).alias("size")))


def mix(docs: DataFrame) -> DataFrame:
    """The training order: docs' columns with mix_pass, mix_words and mix_position, a row for each pass over a document.

    Rows are sorted by position over range partitions. A document of which the mix takes nothing has no row. All columns
    of docs stay as they are; where one has a name of the three, the added one gets an underscore behind its name.
    """
    scratch = Scratch(docs.sparkSession)
    sizes = measured(docs, scratch)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), "doc_id", "source", words(F.col("text")).alias("mix_size"))
    placed = place(rows, sizes, scratch)
    parts = F.posexplode(F.arrays_zip(F.col("mix_takes").alias("t"), F.col("mix_positions").alias("p")))
    rows = placed.select("row", "doc_id", parts.alias("mix_pass", "_x")).where("_x.t > 0")
    rows = rows.select("row", "doc_id", "mix_pass", F.col("_x.t").alias("mix_words"), F.col("_x.p").alias("mix_position"))
    added = [F.col(c).alias(free_name(c, docs.columns)) for c in ("mix_pass", "mix_words", "mix_position")]
    return rows.orderBy("mix_position", "doc_id", "mix_pass").select("row.*", *added)


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document with the words that the mix takes of it, in order of its first position (null last)."""
    scratch = Scratch(spark)
    sizes = measured(table(spark, sf_dir, "documents"), scratch)
    placed = place(sizes.withColumnRenamed("size", "mix_size"), sizes, scratch)
    return placed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.expr("aggregate(mix_takes, 0L, (a, x) -> a + x)").alias("taken"),
        F.round(F.element_at("mix_positions", 1), 9).alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


#: The position is of the first pass.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][nth % 3 + 1] AS weight, CAST([0.5, -0.5, 0.0][nth % 3 + 1] AS DOUBLE) AS tilt FROM s
), l AS (
  SELECT *, row_number() OVER o AS pos_,
    CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) - 2 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_,
    CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_
  FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST)
), f AS (
  SELECT min(pos_) AS first_ FROM l WHERE 2 * source_size * left_ >= spent_ * weight
), t AS (
  SELECT l.*, CASE WHEN pos_ < first_ THEN CAST(2 * source_size AS DOUBLE)
    ELSE weight * (SELECT spent_ FROM l CROSS JOIN f WHERE pos_ = first_) / (SELECT left_ FROM l CROSS JOIN f WHERE pos_ = first_) END AS target
  FROM l CROSS JOIN f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.tilt,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, greatest(0, least(size, CAST(round(target) AS BIGINT) - pos_)) AS t0,
    greatest(0, least(size, CAST(round(target) AS BIGINT) - source_size - pos_)) AS t1, pos_ / target AS given_ FROM p
)
SELECT doc_id, size, source_size, target, CAST(t0 + t1 AS BIGINT) AS taken,
  round(CASE WHEN t0 > 0 THEN CASE WHEN tilt = 0 THEN given_ ELSE (tilt - 1 + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * given_)) / (2 * tilt) END END, 9) AS position
FROM q
"""
