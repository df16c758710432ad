"""References, destinations, names, merges of dictionaries and forms, signatures' coverage, sinks' orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import coverage, pages, references, revisions, rules
from ..sources.tables import table
from . import query
from .forms import _FIELDS_SQL, _fields
from .graph import _TREE_SQL, _tree


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM
(SELECT *, l_orderkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS ref FROM lineitem) LEFT JOIN orders ON ref = o_orderkey""")
def reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_orderkey + if(l_linenumber = 7, 1000000000L, 0L) AS ref"
    )
    objects = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return references.lookup(rows, "ref", objects, "o_orderkey").drop("ref", "o_orderkey")


_CHAIN = "CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 25 THEN event_id + 10 WHEN event_id % 97 = 3 THEN -1 ELSE event_id - 1 - user_id % 2 END"


@query(f"""WITH RECURSIVE o AS (SELECT event_id AS obj, {_CHAIN} AS ref FROM events), r AS (
  SELECT obj, obj AS cur, 0 AS h FROM o
  UNION ALL SELECT r.obj, o.ref, r.h + 1 FROM r JOIN o ON r.cur = o.obj WHERE o.ref IS NOT NULL AND r.h < 32
), e AS (SELECT r.obj, r.cur FROM r JOIN o ON r.cur = o.obj WHERE o.ref IS NULL)
SELECT o.obj, e.cur AS target FROM o LEFT JOIN e ON o.obj = e.obj""")
def reference_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.chase(table(spark, sf_dir, "events").selectExpr("event_id AS obj", f"{_CHAIN} AS ref"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_extendedprice < 1000 THEN 0 WHEN l_extendedprice < 5000 THEN 1
WHEN l_extendedprice < 20000 THEN 2 WHEN l_extendedprice < 10000 THEN 3 WHEN l_extendedprice < 80000 THEN 4 ELSE 5 END AS place FROM lineitem""")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = references.interval(F.col("l_extendedprice"), [1000.0, 5000.0, 20000.0, 10000.0, 80000.0])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", place.alias("place"))


@query("""WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 100 AS INTEGER) END AS explicit, CAST(o_custkey % 300 AS VARCHAR) AS dest FROM orders),
d AS (SELECT CAST(c_custkey AS VARCHAR) AS name, c_nationkey AS page FROM customer WHERE c_custkey % 3 = 0),
t AS (SELECT CAST(p_partkey % 200 AS VARCHAR) AS name, min(p_size) AS page FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT o_orderkey, coalesce(explicit, d.page, t.page) AS page, CASE WHEN explicit IS NOT NULL THEN 'explicit' WHEN d.page IS NOT NULL THEN 'dictionary' WHEN t.page IS NOT NULL THEN 'tree' ELSE 'missing' END AS how
FROM l LEFT JOIN d ON dest = d.name LEFT JOIN t ON dest = t.name""")
def destination_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 4 = 0 THEN cast(o_orderkey % 100 AS int) END AS explicit", "cast(o_custkey % 300 AS string) AS dest"
    )
    names = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").selectExpr("cast(c_custkey AS string) AS name", "c_nationkey AS page")
    tree = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").selectExpr("cast(p_partkey % 200 AS string) AS name", "p_size AS page")
    return references.destinations(links, "explicit", "dest", names, tree).select("o_orderkey", "page", "how")


@query(f"""WITH RECURSIVE {_TREE_SQL}, r AS (SELECT node FROM tree WHERE node IN (1, 3) UNION ALL SELECT t.node FROM tree t JOIN r ON t.parent = r.node)
SELECT node, 2000000000 + row_number() OVER (ORDER BY node) - 1 AS copy FROM r""")
def import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    edges = tree.select(F.col("parent").alias("src"), F.col("node").alias("dst")).where("src IS NOT NULL")
    return references.copy_closure(tree.where("node IN (1, 3)").select("node"), edges, 2_000_000_000)


@query("""WITH r AS (SELECT user_id % 20 AS target, event_id, event_type AS name, CAST(floor(value) AS BIGINT) % 5 AS value FROM events),
f AS (SELECT target, name, value, min(event_id) AS event_id FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY target, name ORDER BY event_id) AS k FROM f)
SELECT target, event_id, name, value, CASE WHEN k = 1 THEN name ELSE name || '_' || k END AS merged FROM k""")
def resource_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id % 20 AS target", "event_id", "event_type AS name", "floor(value) % 5 AS value")
    return references.union_renamed(rows, "target", "event_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def key_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return references.keep_first(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT c_nationkey, min(c_name) AS first, max(c_name) AS last, CAST(count(*) AS BIGINT) AS entries FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY c_nationkey")
def name_tree_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_name", "c_mktsegment")
    return references.prune_names(rows, "c_nationkey", "c_name", F.col("c_mktsegment") == "BUILDING")


#: A signature of each order: its segments (one to three of them, some cut off or out of the file), the file's length and the size of its contents.
_SEGMENTS = "CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS a, o_custkey AS n, o_custkey + 2 + 2 * (o_orderkey % 7) AS b, o_custkey % 500 AS m, o_custkey + 2 + 2 * (o_orderkey % 7) + o_custkey % 500 + CASE WHEN o_orderkey % 13 = 0 THEN 40 ELSE o_orderkey % 3 - 1 END AS len, o_orderkey % 7 + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS held, o_orderkey % 13 AS shape"


@query(f"""SELECT o_orderkey, CASE WHEN shape = 5 THEN 'Malformed' WHEN shape = 6 THEN 'Malformed' WHEN shape = 0 AND (a + n > len OR b + m > len OR b + m + 10 > len) THEN 'Malformed' WHEN shape = 4 AND a + n > len THEN 'Malformed'
  WHEN shape NOT IN (0, 4) AND (a + n > len OR b + m > len) THEN 'Malformed' WHEN shape IN (0, 4) THEN 'Partial' WHEN a = 0 AND b + m = len AND b - n = 2 + 2 * held THEN 'Whole' ELSE 'Partial' END AS verdict,
CAST(CASE shape WHEN 0 THEN n + m + 10 WHEN 4 THEN n WHEN 5 THEN n WHEN 6 THEN 0 ELSE n + m END AS BIGINT) AS covered FROM (SELECT o_orderkey, {_SEGMENTS} FROM orders)""")
def byte_range_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *_SEGMENTS.split(", "))
    each = "CASE shape WHEN 0 THEN array(a, n, b, m, b + m, 10) WHEN 4 THEN array(a, n) WHEN 5 THEN array(a, n, b) WHEN 6 THEN array() ELSE array(a, n, b, m) END"
    rows = rows.withColumn("ranges", F.expr(f"cast({each} AS array<bigint>)"))
    return rows.select("o_orderkey", coverage.verdict(F.col("ranges"), F.col("len"), F.col("held")).alias("verdict"), coverage.covered(F.col("ranges")).alias("covered"))


@query("""WITH c AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'signup')
SELECT user_id, CASE coalesce(CASE WHEN value >= 100 THEN CAST(floor(value / 100) AS INTEGER) END, 2) WHEN 1 THEN 'NoChanges' WHEN 2 THEN 'FormFilling' WHEN 3 THEN 'FormFillingAndAnnotations' END AS level FROM c WHERE k = 1""")
def certification_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    signatures = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", "ts", "event_id", "value")
    first = references.keep_first(signatures, ["user_id"], ["ts", "event_id"])
    level = F.when(F.col("value") >= 100, F.floor(F.col("value") / 100).cast("int"))
    return first.select("user_id", coverage.modification_level(level).alias("level"))


@query(f"WITH RECURSIVE {_FIELDS_SQL} SELECT node, full_name FROM fl WHERE ft = 'Sig'")
def signature_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).where(strings.field_kind(F.col("ft"), F.col("ff")) == "Signature").select("node", "full_name")


@query("""SELECT c_nationkey, bit_or(c_custkey % 8) AS flags, bool_or(c_acctbal < 0) AS need_appearances, arg_min(c_mktsegment, c_custkey) AS appearance FROM customer GROUP BY c_nationkey""")
def form_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.groupBy("c_nationkey").agg(
        F.bit_or(F.expr("c_custkey % 8")).alias("flags"), F.bool_or(F.col("c_acctbal") < 0).alias("need_appearances"), F.min_by("c_mktsegment", "c_custkey").alias("appearance")
    )


@query("""WITH v AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT c_custkey, coalesce(o_orderpriority, c_mktsegment) AS value FROM customer LEFT JOIN v ON c_custkey = o_custkey AND k = 1""")
def fill_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    newest = revisions.last_wins(given, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    fields = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return fields.join(newest, "c_custkey", "left").select("c_custkey", F.coalesce("o_orderpriority", "c_mktsegment").alias("value"))


@query("""WITH o AS (SELECT conv_id AS page, 0 AS part, turn AS seq, role AS op FROM conversations
UNION ALL SELECT c_nationkey, 1, c_custkey, 'widget' FROM customer WHERE c_custkey & 2 = 0 AND c_custkey & 4 <> 0)
SELECT page, seq, op, row_number() OVER (PARTITION BY page ORDER BY part, seq) - 1 AS place FROM o""")
def flatten_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = table(spark, sf_dir, "conversations").selectExpr("conv_id AS page", "0 AS part", "turn AS seq", "role AS op")
    shown = table(spark, sf_dir, "customer").where(strings.annotation_visible(F.col("c_custkey"), printing=True))
    widgets = shown.selectExpr("cast(c_nationkey AS bigint) AS page", "1 AS part", "c_custkey AS seq", "'widget' AS op")
    return pages.renumber(content.unionByName(widgets), "page", F.struct("part", "seq")).drop("part")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 'NotChecked' WHEN (CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END) IS NOT DISTINCT FROM (CASE WHEN c_custkey % 5 <> 0 THEN o_orderpriority END) THEN 'Pass' ELSE 'Fail' END AS status
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def info_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    rows = table(spark, sf_dir, "orders").join(customer, F.expr("o_custkey = c_custkey"), "left")
    info, packet = F.expr("if(o_orderkey % 3 <> 0, o_orderpriority, null)"), F.expr("if(c_custkey % 5 <> 0, o_orderpriority, null)")
    return rules.findings(rows, "o_orderkey", {"info": (info.eqNullSafe(packet), F.expr("o_orderkey % 2 = 0"))}).select("o_orderkey", "status")


@query("SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events WHERE value > 90")
def dirty_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.numbered(table(spark, sf_dir, "events").where("value > 90").select("event_id", "user_id"), "event_id", "place")


@query("""SELECT event_id, '01' || lpad(hex(event_id * 37), 8, '0') || lpad(hex(user_id), 4, '0') AS entry FROM events""")
def xref_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = lambda c, n: F.lpad(F.hex(c), n, "0")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("01"), wide(F.expr("event_id * 37"), 8), wide(F.col("user_id"), 4)).alias("entry"))
