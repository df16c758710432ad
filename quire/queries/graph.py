"""Trees, references and revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.revisions import last_wins, live
from ..sources.tables import table
from . import query

#: The tree of regions, nations, customers and orders, as one id space.
_TREE_SQL = """tree AS (
  SELECT CAST(r_regionkey AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, CAST(r_regionkey AS BIGINT) AS pos, r_name AS name, CAST(NULL AS VARCHAR) AS attr FROM region
  UNION ALL SELECT 1000 + n_nationkey, n_regionkey, n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'n' || n_nationkey END FROM nation
  UNION ALL SELECT 1000000 + c_custkey, 1000 + c_nationkey, c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END FROM customer
  UNION ALL SELECT 1000000000 + o_orderkey, 1000000 + o_custkey, o_orderkey, CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 11 = 0 THEN o_orderpriority END FROM orders
)"""
_FLAT_SQL = f"""{_TREE_SQL}, flat AS (
  SELECT node, parent, pos, name, attr, 0 AS level, name AS full_name FROM tree WHERE parent IS NULL
  UNION ALL
  SELECT t.node, t.parent, t.pos, t.name, coalesce(t.attr, f.attr), f.level + 1, f.full_name || '.' || t.name FROM tree t JOIN flat f ON t.parent = f.node
)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("region", "nation", "customer", "orders"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"_tree_{name}")
    return spark.sql(
        """SELECT cast(r_regionkey as bigint) AS node, cast(null as bigint) AS parent, cast(r_regionkey as bigint) AS pos, r_name AS name, cast(null as string) AS attr FROM _tree_region
        UNION ALL SELECT 1000L + n_nationkey, cast(n_regionkey as bigint), cast(n_nationkey as bigint), n_name, CASE WHEN n_nationkey % 3 = 0 THEN concat('n', n_nationkey) END FROM _tree_nation
        UNION ALL SELECT 1000000L + c_custkey, 1000L + c_nationkey, c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END FROM _tree_customer
        UNION ALL SELECT 1000000000L + o_orderkey, 1000000L + o_custkey, o_orderkey, cast(o_orderkey as string), CASE WHEN o_orderkey % 11 = 0 THEN o_orderpriority END FROM _tree_orders"""
    )


@query(f"WITH RECURSIVE {_FLAT_SQL} SELECT node, parent, CAST(level AS INTEGER) AS level FROM flat")
def page_tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.flatten(_tree(spark, sf_dir), []).select("node", "parent", "level")


@query(f"WITH RECURSIVE {_FLAT_SQL} SELECT node, attr FROM flat")
def inherited_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.flatten(_tree(spark, sf_dir), ["attr"]).select("node", "attr")


_OUTLINE_SQL = f"""WITH RECURSIVE {_TREE_SQL}, up AS (
  SELECT node, parent, CASE WHEN node % 4 <> 1 THEN node END AS anchor FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.node, t.parent, CASE WHEN t.node % 4 <> 1 THEN t.node ELSE u.anchor END FROM tree t JOIN up u ON t.parent = u.node
) SELECT a.node, b.anchor AS parent FROM up a LEFT JOIN up b ON a.parent = b.node WHERE a.node % 4 <> 1"""


@query(_OUTLINE_SQL)
def outline_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.promote(_tree(spark, sf_dir).withColumn("keep", F.expr("node % 4 <> 1")), "keep").select("node", "parent")


@query(f"""WITH RECURSIVE {_TREE_SQL}, leaf AS (
  SELECT t.node, t.parent FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.parent = t.node) AND t.node % 10 <> 0
), up AS (SELECT node, parent FROM leaf UNION SELECT t.node, t.parent FROM tree t JOIN up ON up.parent = t.node)
SELECT DISTINCT node FROM up""")
def structure_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.prune(_tree(spark, sf_dir).withColumn("gone", F.expr("node % 10 = 0")), "gone")


_EDGES_SQL = """ed AS (
  SELECT 1000000 + c_custkey AS src, 1000000000 + o_orderkey AS dst FROM customer JOIN orders ON c_custkey = o_custkey
  UNION ALL SELECT DISTINCT 1000000000 + l_orderkey, 2000000000 + l_partkey FROM lineitem
)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    owns = orders.join(table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey"), "o_custkey", "left_semi")
    return owns.selectExpr("1000000L + o_custkey AS src", "1000000000L + o_orderkey AS dst").union(
        items.selectExpr("1000000000L + l_orderkey AS src", "2000000000L + l_partkey AS dst").distinct()
    )


_REACH_SQL = f"""WITH RECURSIVE {_EDGES_SQL}, reach AS (
  SELECT 1000000 + c_custkey AS node FROM customer WHERE c_custkey % 50 = 7
  UNION SELECT dst FROM ed JOIN reach ON ed.src = reach.node
)"""


def _reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "customer").where("c_custkey % 50 = 7").selectExpr("1000000L + c_custkey AS node")
    return graph.reachable(roots, _edges(spark, sf_dir))


@query(f"{_REACH_SQL} SELECT CAST(node AS BIGINT) AS node FROM reach")
def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reach(spark, sf_dir)


@query(f"{_REACH_SQL} SELECT CAST(dst AS BIGINT) AS node FROM (SELECT DISTINCT dst FROM ed) WHERE dst NOT IN (SELECT node FROM reach)")
def excluded_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select(F.col("dst").alias("node")).distinct().join(_reach(spark, sf_dir), "node", "left_anti")


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, event_id, event_type, value FROM x WHERE k = 1""")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_wins(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""SELECT user_id, CAST(arg_max(event_id, value * 1000000 + event_id) AS BIGINT) AS event_id FROM events WHERE event_type = 'view' OR value > 10 GROUP BY user_id""")
def recovery_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's last occurrence of an object (by offset) counts."""
    found = table(spark, sf_dir, "events").where("event_type = 'view' OR value > 10").withColumn("offset", F.expr("value * 1000000 + event_id"))
    return last_wins(found, ["user_id"], ["offset", "event_id"]).select("user_id", "event_id")


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, event_id FROM x WHERE k = 1 AND event_type <> 'click'""")
def live_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "click").select("user_id", "event_id")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, text) AS canonical FROM documents")
def dedup_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of equal dictionary (lang), length and payload digest under the smallest number; digests meet, texts don't move."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n"), F.sha2("text", 256).alias("h"))
    lows = keyed.groupBy("lang", "n", "h").agg(F.min("doc_id").alias("canonical"))
    return keyed.join(lows, ["lang", "n", "h"]).select("doc_id", "canonical")


@query("""WITH p AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS c FROM part),
s AS (SELECT l_orderkey, min(c) AS c FROM lineitem JOIN p ON l_partkey = p_partkey GROUP BY l_orderkey),
o AS (SELECT l_orderkey, min(l_orderkey) OVER (PARTITION BY c) AS c FROM s)
SELECT CAST(p_partkey AS BIGINT) AS obj, CAST(c AS BIGINT) AS canonical FROM p
UNION ALL SELECT 1000000000 + l_orderkey, 1000000000 + c FROM o""")
def dedup_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of equal brand and size merge, then orders whose (least) part has merged."""
    part, items = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    parts = part.selectExpr("cast(p_partkey as bigint) AS obj", "concat(p_brand, '/', p_size) AS payload", "min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS low")
    of = items.join(parts, items["l_partkey"] == parts["obj"]).groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("low", "l_partkey")).alias("dst"))
    refs = of.selectExpr("1000000000L + l_orderkey AS src", "0 AS pos", "dst")
    return graph.dedup_fixpoint(parts.select("obj", "payload").union(refs.selectExpr("src", "'order'")), refs)
