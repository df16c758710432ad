"""Scalar functions over lineitem, events and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blend, postscript, shapes, strings
from ..sources.tables import table
from . import query

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYS = ", ".join(_KEY)


def _items(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_KEY, *[F.round(c, 6).alias(n) if n[0] != "_" else c.alias(n[1:]) for n, c in columns.items()])


@query(f"""SELECT {_KEYS},
  round(CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity / l_discount END, 6) AS a,
  round(sqrt(greatest(l_quantity - 20, 0)) + sin(radians(l_quantity * 7)) * cos(radians(l_quantity)), 6) AS b,
  round(CASE WHEN degrees(atan2(l_tax - 0.04, l_discount - 0.05)) < 0 THEN degrees(atan2(l_tax - 0.04, l_discount - 0.05)) + 360 ELSE degrees(atan2(l_tax - 0.04, l_discount - 0.05)) END, 6) AS c,
  CAST(CASE WHEN l_quantity > 25 AND l_tax < 0.05 THEN floor(0.5 - l_quantity / 4) ELSE l_linenumber % 3 END AS DOUBLE) AS d,
  CAST((CAST(l_quantity AS BIGINT) & 12) * 4 AS DOUBLE) AS e
FROM lineitem""")
def ps_calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, t, n = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber")

    def one(program, *inputs):
        return postscript.calculate(program, *inputs)[0]

    return _items(
        spark, sf_dir,
        a=one("{ div }", q, d),
        b=one("{ dup 20 sub sqrt exch dup 7 mul sin exch cos mul add }", q),
        c=one("{ exch 0.04 sub exch 0.05 sub atan }", t, d),
        d=one("{ 3 copy pop 0.05 lt exch 25 gt and { pop pop 4 div neg round } { exch pop exch pop 3 mod } ifelse }", q, t, n),
        e=one("{ 12 and 2 bitshift }", q),
    )


@query(f"SELECT {_KEYS}, round(0.1 + power(l_discount * 10, 1.7) * (0.9 - 0.1), 6) AS r, round(1 + power(l_discount * 10, 1.7) * (0.25 - 1), 6) AS g FROM lineitem")
def fn_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g = shapes.exponential(F.col("l_discount") * 10, [0.1, 1.0], [0.9, 0.25], 1.7, (0.0, 2.0))
    return _items(spark, sf_dir, r=r, g=g)


@query(f"""SELECT {_KEYS}, round(CASE WHEN x < 0.25 THEN power((x - 0) * 1 / 0.25, 2) WHEN x < 0.75 THEN 1 + (1 + (x - 0.25) * (0 - 1) / 0.5) * (0.2 - 1) ELSE 0.2 + ((x - 0.75) * 1 / 0.25) * 0.3 END, 6) AS y
FROM (SELECT *, least(greatest(l_tax * 12.5, 0), 1) AS x FROM lineitem)""")
def fn_stitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [lambda x: F.pow(x, F.lit(2.0)), lambda x: 1.0 + x * (0.2 - 1.0), lambda x: 0.2 + x * 0.3]
    return _items(spark, sf_dir, y=shapes.stitched(F.col("l_tax") * 12.5, parts, [0.25, 0.75], [(0, 1), (1, 0), (0, 1)]))


@query("""SELECT vec_id, round(CASE WHEN e >= 63 THEN embedding[64] ELSE embedding[CAST(floor(e) AS INTEGER) + 1] * (1 - (e - floor(e))) + embedding[CAST(floor(e) AS INTEGER) + 2] * (e - floor(e)) END, 5) AS y
FROM (SELECT *, CAST(vec_id % 100 AS DOUBLE) / 99 * 63 AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings))""")
def fn_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.expr("cast(vec_id % 100 as double)") / 99
    y = shapes.sampled([x], F.col("embedding"), [64], [(0.0, 1.0)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(y, 5).alias("y"))


_B, _S = "CAST(floor(l_discount * 2550) AS INTEGER)", "CAST(floor(l_tax * 3187.5) AS INTEGER)"


#: Written out for DuckDB from the formulas of the imaging model, apart from those that the operator runs.
_BLEND_SQL = """SELECT KEYS, s AS normal, s * b // 255 AS multiply, s + b - s * b // 255 AS screen,
  CASE WHEN b >= 128 THEN s + (2 * b - 255) - s * (2 * b - 255) // 255 ELSE 2 * b * s // 255 END AS overlay,
  CASE WHEN b < s THEN b ELSE s END AS darken, CASE WHEN b < s THEN s ELSE b END AS lighten,
  CASE WHEN s = 255 THEN 255 WHEN b * 255 // (255 - s) > 255 THEN 255 ELSE b * 255 // (255 - s) END AS colordodge,
  CASE WHEN s = 0 THEN 0 WHEN (255 - b) * 255 // s > 255 THEN 0 ELSE 255 - (255 - b) * 255 // s END AS colorburn,
  CASE WHEN s >= 128 THEN b + (2 * s - 255) - b * (2 * s - 255) // 255 ELSE 2 * s * b // 255 END AS hardlight,
  CASE WHEN s >= 128 THEN b + (2 * s - 255) * (CAST(CASE WHEN b >= 64 THEN round(255 * sqrt(b / 255.0::DOUBLE)) ELSE floor(255 * (16 * pow(b / 255.0::DOUBLE, 3) - 12 * pow(b / 255.0::DOUBLE, 2) + 4 * b / 255.0::DOUBLE) + 1e-9) END AS INTEGER) - b) // 255
    ELSE b - (255 - 2 * s) * b * (255 - b) // 255 // 255 END AS softlight,
  CASE WHEN b < s THEN s - b ELSE b - s END AS difference, b + s - 2 * b * s // 255 AS exclusion FROM x"""


@query(f"WITH x AS (SELECT *, CAST(l_extendedprice * 100 AS BIGINT) % 256 AS b, (CAST(l_orderkey AS BIGINT) * 7 + l_partkey) % 256 AS s FROM lineitem), r AS ({_BLEND_SQL.replace('KEYS', _KEYS)}) SELECT {_KEYS}, " + ", ".join(f"CAST({n.lower()} AS INTEGER) AS {n.lower()}" for n in blend.SEPARABLE) + " FROM r")
def blend_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*_KEY, F.expr("cast(cast(round(l_extendedprice * 100) as bigint) % 256 as int)").alias("b"), F.expr("cast((l_orderkey * 7 + l_partkey) % 256 as int)").alias("s"))
    return rows.select(*_KEY, *[blend.separable(n, "b", "s").alias(n.lower()) for n in blend.SEPARABLE])


_BACK = {"br": "(l_orderkey * 7) % 256", "bg": "(l_partkey * 3) % 256", "bb": "(l_suppkey * 11 + l_linenumber) % 256"}
_SOURCE = {"sr": "(l_partkey * 5) % 256", "sg": "(l_orderkey * 13 + l_suppkey) % 256", "sb": "(l_linenumber * 36) % 256"}


def _non_separable_sql() -> str:
    """Each mode: the colour that is moved (c), and the luminosity that it gets (t); then moved, then clipped below, then above."""
    sat = "CASE WHEN greatest({0}r, {0}g, {0}b) = least({0}r, {0}g, {0}b) THEN 0 ELSE ({0}{2} - least({0}r, {0}g, {0}b)) * (greatest({1}r, {1}g, {1}b) - least({1}r, {1}g, {1}b)) // (greatest({0}r, {0}g, {0}b) - least({0}r, {0}g, {0}b)) END"
    lum = "({0}r * 30 + {0}g * 59 + {0}b * 11) // 100"
    kinds = {"hue": ("s", "b", "b"), "saturation": ("b", "s", "b"), "color": ("s", None, "b"), "luminosity": ("b", None, "s")}
    rows = " UNION ALL ".join(
        f"SELECT {_KEYS}, '{k}' AS mode, " + ", ".join(f"{sat.format(c, of, x) if of else c + x} AS c{x}" for x in "rgb") + f", {lum.format(t)} AS t FROM x" for k, (c, of, t) in kinds.items()
    )
    cast = ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in (_BACK | _SOURCE).items())
    return f"""WITH x AS (SELECT {_KEYS}, {cast} FROM lineitem), c AS ({rows}),
d AS (SELECT {_KEYS}, mode, {", ".join(f"c{x} + t - {lum.format('c')} AS d{x}" for x in "rgb")} FROM c),
e AS (SELECT *, {lum.format("d")} AS l, least(dr, dg, db) AS lo, greatest(dr, dg, db) AS hi FROM d),
f AS (SELECT *, {", ".join(f"CASE WHEN lo < 0 THEN l + (d{x} - l) * l // (l - lo) ELSE d{x} END AS e{x}" for x in "rgb")} FROM e)
SELECT {_KEYS}, mode, {", ".join(f"CAST(CASE WHEN hi > 255 THEN l + (e{x} - l) * (255 - l) // (hi - l) ELSE e{x} END AS INTEGER) AS {x}" for x in "rgb")} FROM f"""


@query(_non_separable_sql())
def blend_nonseparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes that need the three channels at once, a row for each."""
    rows = table(spark, sf_dir, "lineitem").select(*_KEY, *[F.expr(f"cast({v} as int)").alias(k) for k, v in (_BACK | _SOURCE).items()])
    for m in blend.NON_SEPARABLE:
        rows = blend.non_separable(rows, m, list(_BACK), list(_SOURCE), [f"{m}_{x}" for x in "rgb"])
    found = [F.struct(F.lit(m.lower()).alias("mode"), *[F.col(f"{m}_{x}").alias(x) for x in "rgb"]) for m in blend.NON_SEPARABLE]
    return rows.select(*_KEY, F.explode(F.array(*found)).alias("m")).select(*_KEY, "m.*")


@query(f"""WITH x AS (SELECT {_KEYS}, l_partkey % 256 AS b, (l_orderkey * 3) % 256 AS s, (l_suppkey * 5) % 256 AS ba, (l_linenumber * 40) % 256 AS sa FROM lineitem),
y AS (SELECT *, b * s // 255 AS m, ba / 255.0::DOUBLE AS p, sa / 255.0::DOUBLE AS q FROM x), z AS (SELECT *, p + q - p * q AS u FROM y)
SELECT {_KEYS}, CAST(CASE WHEN sa = 0 THEN b ELSE floor((1 - q / u) * b + (q / u) * ((1 - p) * s + p * m) + 0.5) END AS INTEGER) AS c, CAST(CASE WHEN sa = 0 THEN ba ELSE floor(u * 255 + 0.5) END AS INTEGER) AS a FROM z""")
def composite_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiply over a backdrop that is transparent itself."""
    rows = table(spark, sf_dir, "lineitem").select(*_KEY, *[F.expr(f"cast({v} as int)").alias(k) for k, v in (("b", "l_partkey % 256"), ("s", "(l_orderkey * 3) % 256"), ("ba", "(l_suppkey * 5) % 256"), ("sa", "(l_linenumber * 40) % 256"))])
    c, a = blend.composite_alpha([F.col("b"), F.col("ba")], [F.col("s"), F.col("sa")], [blend.separable("Multiply", "b", "s")])
    return rows.select(*_KEY, c.alias("c"), a.alias("a"))


@query(f"SELECT {_KEYS}, CAST(floor({_B} * (1 - l_quantity / 50) + {_S} * (l_quantity / 50) + 0.5) AS INTEGER) AS c FROM lineitem")
def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, s = F.floor(F.col("l_discount") * 2550), F.floor(F.col("l_tax") * 3187.5)
    return table(spark, sf_dir, "lineitem").select(*_KEY, blend.composite(b, s, F.col("l_quantity") / 50).alias("c"))


@query(f"SELECT {_KEYS}, round((l_quantity * 2 + l_tax * 0.5 + 3) * 1.5 + 7, 6) AS x, round((l_quantity * 0.25 + l_tax * 4 + 1) * 0.5 - 2, 6) AS y FROM lineitem")
def matrix_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = shapes.multiply([2.0, 0.25, 0.5, 4.0, 3.0, 1.0], [1.5, 0.0, 0.0, 0.5, 7.0, -2.0])
    x, y = shapes.transform([F.lit(v) for v in m], F.col("l_quantity"), F.col("l_tax"))
    return _items(spark, sf_dir, x=x, y=y)


@query("""SELECT event_id, CASE WHEN event_id % 10 = 9 THEN NULL
  ELSE to_timestamp(epoch(date_trunc('second', CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) WHEN event_id % 3 = 1 THEN ts ELSE ts - INTERVAL 90 MINUTE END))) AT TIME ZONE 'UTC' END AS at FROM events""")
def pdf_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' times written as documents write dates: days alone, in UTC, with an offset, or without a year."""
    day, full = F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "yyyyMMddHHmmss")
    text = F.when(F.expr("event_id % 10 = 9"), "D:19").when(F.expr("event_id % 3 = 0"), F.concat(F.lit("D:"), day)).when(F.expr("event_id % 3 = 1"), F.concat(F.lit("D:"), full, F.lit("Z"))).otherwise(F.concat(full, F.lit("+01'30'")))
    return table(spark, sf_dir, "events").select("event_id", strings.document_date(text).alias("at"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 THEN 3900 ELSE (event_id * 37) & 3900 END AS INTEGER) AS bits FROM events")
def permission_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("if(event_id % 7 = 0, null, cast(event_id * 37 as int))")
    return table(spark, sf_dir, "events").select("event_id", strings.permissions(raw).alias("bits"))


@query("SELECT event_id, (event_id & 2) = 0 AND (event_id & 4) <> 0 AS printed, (event_id & 2) = 0 AND (event_id & 32) = 0 AS viewed FROM events")
def annotation_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.col("event_id").cast("int")
    return table(spark, sf_dir, "events").select("event_id", strings.annotation_visible(flags, True).alias("printed"), strings.annotation_visible(flags, False).alias("viewed"))
