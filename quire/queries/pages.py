"""Page algebra over conversations: a conversation is a document, a turn a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages
from ..sources.tables import table
from . import query


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")


@query("SELECT conv_id % 10 AS target, conv_id, turn, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) - 1 AS place FROM conversations")
def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.merge_by(_turns(spark, sf_dir), "conv_id", "turn", F.expr("conv_id % 10")).select("target", "conv_id", "turn", "place")


@query("SELECT conv_id || '-' || turn AS new_doc, role FROM conversations")
def split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.split(_turns(spark, sf_dir), "conv_id", "turn").select("new_doc", "role")


@query("""WITH x AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n <= 3 THEN p WHEN p = 0 THEN 3 WHEN p <= 3 THEN p - 1 ELSE p END AS place FROM x""")
def move_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.move(_turns(spark, sf_dir), "conv_id", "turn", 0, 3).select("conv_id", "turn", "place")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE role <> 'system' AND turn % 3 <> 1")
def remove_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.remove(_turns(spark, sf_dir), "conv_id", "turn", F.expr("role = 'system' OR turn % 3 = 1")).select("conv_id", "turn", "place")


@query("""WITH x AS (SELECT conv_id, turn, role, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 >= 2 THEN 2 ELSE 0 END AS part FROM conversations
UNION ALL SELECT DISTINCT conv_id, -1, 'cover', 1 FROM conversations)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) - 1 AS place FROM x""")
def insert_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    cover = turns.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("cover").alias("role"))
    return pages.insert(turns, cover, "conv_id", "turn", 2)


@query("SELECT l_suppkey, batch, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM (SELECT l_suppkey, l_quantity, CAST(floor((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) / 100) AS BIGINT) AS batch FROM lineitem) GROUP BY l_suppkey, batch")
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pages.pack(table(spark, sf_dir, "lineitem"), F.struct("l_orderkey", "l_linenumber", "l_partkey"), 100, "l_suppkey")
    return packed.groupBy("l_suppkey", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn) AS entries FROM conversations GROUP BY conv_id")
def number_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's sorted map of numbers to values, as text."""
    entries = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_join(F.transform(entries, lambda x: F.concat_ws(":", x["turn"], x["role"])), ",").alias("entries"))


@query("SELECT DISTINCT conv_id FROM conversations WHERE role = 'system' EXCEPT SELECT conv_id FROM conversations WHERE turn >= 5")
def kept_except_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return turns.where("role = 'system'").select("conv_id").distinct().join(turns.where("turn >= 5").select("conv_id").distinct(), "conv_id", "left_anti")


@query("SELECT conv_id FROM conversations WHERE role = 'system' INTERSECT SELECT conv_id FROM conversations WHERE turn >= 5")
def widgets_on_imported_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return turns.where("role = 'system'").select("conv_id").distinct().join(turns.where("turn >= 5").select("conv_id").distinct(), "conv_id", "left_semi")
