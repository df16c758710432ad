"""Form fields and conformance rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import forms, rules
from ..sources.tables import table
from . import query
from .graph import _TREE_SQL, _tree

_FIELDS_SQL = f"""{_TREE_SQL}, fd AS (
  SELECT node, parent, CASE WHEN node % 13 = 0 THEN 'Field' || node ELSE name END AS name,
    CASE WHEN node < 1000 THEN 'Tx' WHEN node < 1000000 AND node % 4 = 1 THEN 'Btn' WHEN node < 1000000 AND node % 4 = 2 THEN 'Ch' WHEN node % 50 = 3 THEN 'Sig' END AS ft,
    CASE WHEN node < 1000 THEN 0 WHEN node % 3 = 0 THEN (node * 32768) % 262144 END AS ff FROM tree
), fl AS (
  SELECT node, name AS full_name, ft, ff FROM fd WHERE parent IS NULL
  UNION ALL SELECT d.node, f.full_name || '.' || d.name, coalesce(d.ft, f.ft), coalesce(d.ff, f.ff) FROM fd d JOIN fl f ON d.parent = f.node
)"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tree(spark, sf_dir).selectExpr(
        "node", "parent", "if(node % 13 = 0, null, name) AS name",
        "CASE WHEN node < 1000 THEN 'Tx' WHEN node < 1000000 AND node % 4 = 1 THEN 'Btn' WHEN node < 1000000 AND node % 4 = 2 THEN 'Ch' WHEN node % 50 = 3 THEN 'Sig' END AS ft",
        "CASE WHEN node < 1000 THEN 0L WHEN node % 3 = 0 THEN (node * 32768) % 262144 END AS ff",
    )
    return forms.full_names(rows)


@query(f"WITH RECURSIVE {_FIELDS_SQL} SELECT node, full_name FROM fl")
def field_full_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("node", "full_name")


@query(f"""WITH RECURSIVE {_FIELDS_SQL} SELECT node, CASE ft WHEN 'Tx' THEN 'Text' WHEN 'Sig' THEN 'Signature'
  WHEN 'Btn' THEN CASE WHEN (ff >> 16) & 1 = 1 THEN 'PushButton' WHEN (ff >> 15) & 1 = 1 THEN 'RadioButton' ELSE 'CheckBox' END
  WHEN 'Ch' THEN CASE WHEN (ff >> 17) & 1 = 1 THEN 'ComboBox' ELSE 'ListBox' END ELSE 'Unknown' END AS kind FROM fl""")
def field_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("node", strings.field_kind(F.col("ft"), F.col("ff")).alias("kind"))


@query(f"""WITH RECURSIVE {_FIELDS_SQL},
ex AS (SELECT full_name, max(node) AS node FROM fl GROUP BY full_name),
tl AS (SELECT regexp_replace(list_last(string_split(full_name, '.')), '\\[[0-9]+\\]$', '') AS s, min(node) AS node, count(*) AS n FROM fl GROUP BY 1),
w AS (SELECT DISTINCT r_name AS want FROM region UNION SELECT n_name FROM nation UNION SELECT r_name || '.' || n_name FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT c_name FROM customer UNION SELECT 'nothing')
SELECT want, coalesce(ex.node, CASE WHEN tl.n = 1 THEN tl.node END) AS node,
  CASE WHEN ex.node IS NOT NULL OR tl.n = 1 THEN 'found' WHEN tl.n > 1 THEN 'ambiguous' ELSE 'missing' END AS status
FROM w LEFT JOIN ex ON want = full_name LEFT JOIN tl ON want = s""")
def field_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    dotted = region.join(nation, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat_ws(".", "r_name", "n_name"))
    wanted = region.select(F.col("r_name").alias("want")).union(nation.select("n_name")).union(dotted).union(customer.select("c_name")).union(spark.sql("SELECT 'nothing'")).distinct()
    return forms.lookup(_fields(spark, sf_dir), wanted)


@query("SELECT c_nationkey, c_custkey, c_mktsegment AS name, c_mktsegment || CASE WHEN k = 1 THEN '' ELSE '~' || k END AS \"unique\" FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS k FROM customer)")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_mktsegment").alias("name"))
    return forms.unique_names(names, "c_nationkey", "c_custkey")


_RULES_SQL = """rl AS (
  SELECT o_orderkey, 'identification' AS rule, CASE WHEN o_orderkey % 4 BETWEEN 1 AND 3 THEN 'Pass' ELSE 'Fail' END AS status FROM orders
  UNION ALL SELECT o_orderkey, 'encryption', CASE WHEN o_orderstatus <> 'P' THEN 'Pass' ELSE 'Fail' END FROM orders
  UNION ALL SELECT o_orderkey, 'version', CASE WHEN o_orderkey % 4 = 0 THEN 'NotChecked' WHEN 1 + (o_orderkey % 9) / CAST(10 AS DOUBLE) <= CASE o_orderkey % 4 WHEN 1 THEN 1.4 ELSE 1.7 END THEN 'Pass' ELSE 'Fail' END FROM orders
  UNION ALL SELECT o_orderkey, 'appearances', CASE WHEN o_totalprice > 400000 THEN 'Fail' ELSE 'Pass' END FROM orders
  UNION ALL SELECT o_orderkey, 'filters', CASE WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'Fail' ELSE 'Pass' END ELSE 'NotChecked' END FROM orders
)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumns({"part": F.expr("cast(o_orderkey % 4 as int)"), "version": F.expr("1 + (o_orderkey % 9) / 10D")})
    return rules.findings(
        orders, "o_orderkey",
        {
            "identification": (F.col("part").between(1, 3),),
            "encryption": (F.col("o_orderstatus") != "P",),
            "version": (rules.version_within(F.col("part"), F.col("version")),),
            "appearances": (~(F.col("o_totalprice") > 400000),),
            "filters": (~F.col("o_orderpriority").startswith("1"), F.col("part") == 1),
        },
    )


@query(f"WITH {_RULES_SQL} SELECT o_orderkey, rule, status FROM rl")
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


@query(f"WITH {_RULES_SQL} SELECT o_orderkey, NOT bool_or(status = 'Fail') AS conformant, count(*) FILTER (WHERE status = 'Fail') AS failures, count(*) FILTER (WHERE status = 'NotChecked') AS not_checked FROM rl GROUP BY o_orderkey")
def conformance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rollup(_found(spark, sf_dir), "o_orderkey")
