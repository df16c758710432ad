"""Text state, matrices, page geometry, colours, filters, digests and orders of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import colour, shapes, state, strings
from ..operators import search
from ..sources.tables import table
from . import query

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYS = ", ".join(_KEY)


@query(f"""WITH a AS (SELECT *, ((l_discount * 10 * l_quantity) + l_tax + CASE WHEN l_linenumber % 3 = 0 THEN CAST(2.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * CAST(0.75 AS DOUBLE) AS adv FROM lineitem)
SELECT {_KEYS}, round(sum(adv) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) - adv, 4) AS x FROM a""")
def run_advances(spark: SparkSession, sf_dir: str) -> DataFrame:
    adv = state.advance(F.expr("l_discount * 10"), F.col("l_quantity"), F.col("l_tax"), F.lit(2.5), F.lit(0.75), F.expr("l_linenumber % 3 = 0"))
    run = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(W.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "lineitem").select(*_KEY, adv.alias("adv"))
    return rows.select(*_KEY, F.round(F.sum("adv").over(run) - F.col("adv"), 4).alias("x"))


_M = {"a": "l_quantity / 10", "b": "l_discount * 5", "c": "0 - l_tax * 5", "d": "l_quantity / 20", "e": "l_extendedprice / 100", "f": "l_linenumber * 12.0"}
_N = {"a": "l_tax * 10", "b": "1 + l_discount", "c": "l_discount - 1", "d": "l_tax * 10", "e": "l_discount * 100", "f": "l_tax * 100"}


def _product_sql() -> str:
    m, n = ({k: f"CAST({v} AS DOUBLE) AS {p}{k}" for k, v in x.items()} for p, x in (("m", _M), ("n", _N)))
    inner = ", ".join([*m.values(), *n.values()])
    product = "ma*na+mb*nc AS a, ma*nb+mb*nd AS b, mc*na+md*nc AS c, mc*nb+md*nd AS d, me*na+mf*nc+ne AS e, me*nb+mf*nd+nf AS f"
    xs, ys = "e, e + a*w, e + c*h, e + a*w + c*h", "f, f + b*w, f + d*h, f + b*w + d*h"
    return f"""WITH p AS (SELECT {_KEYS}, {inner} FROM lineitem), q AS (SELECT {_KEYS}, {product}, CAST(6 AS DOUBLE) AS w, CAST(10 AS DOUBLE) AS h FROM p)
SELECT {_KEYS}, round(least({xs}), 6) AS x0, round(least({ys}), 6) AS y0, round(greatest({xs}), 6) AS x1, round(greatest({ys}), 6) AS y1 FROM q"""


@query(_product_sql())
def letter_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, n = ({k: F.expr(f"cast({v} AS double)") for k, v in x.items()} for x in (_M, _N))
    rows = table(spark, sf_dir, "lineitem").select(*_KEY, *[v.alias(k) for k, v in state.times(m, n).items()])
    found = state.box({k: F.col(k) for k in state.MATRIX}, F.lit(6.0), F.lit(10.0))
    return rows.select(*_KEY, *[F.round(v, 6).alias(k) for k, v in found.items()])


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS w, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS h, (o_orderkey % 17) * 45 - 360 AS r FROM orders),
q AS (SELECT o_orderkey, coalesce(w, CAST(612 AS DOUBLE)) AS w, coalesce(h, CAST(792 AS DOUBLE)) AS h, CAST(((r % 360 + 360) % 360) // 90 * 90 AS INTEGER) AS rotate FROM p)
SELECT o_orderkey, rotate, CASE WHEN rotate IN (0, 180) THEN w ELSE h END AS width, CASE WHEN rotate IN (0, 180) THEN h ELSE w END AS height FROM q""")
def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "if(o_orderkey % 5 <> 0, o_totalprice, null) AS w", "if(o_orderkey % 7 <> 0, cast(o_custkey AS double), null) AS h", "(o_orderkey % 17) * 45 - 360 AS r"
    )
    width, height = state.shown_size(F.col("w"), F.col("h"), F.col("r"))
    return rows.select("o_orderkey", state.turned(F.col("r")).alias("rotate"), width.alias("width"), height.alias("height"))


_X = "CASE WHEN l_discount = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_tax = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 2 THEN NULL ELSE l_extendedprice END"


@query(f"SELECT {_KEYS}, x FROM (SELECT *, {_X} AS x FROM lineitem) WHERE x IS NOT NULL AND isfinite(x)")
def finite_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_KEY, F.expr(_X).alias("x")).where(state.finite(F.col("x")))


_CHANNEL = "CAST(floor(least(greatest({}, 0.0), 1.0) * 255 + 0.5) AS INTEGER)"


def _ink(x: str) -> str:
    return _CHANNEL.format(f"1 - least(CAST(1 AS DOUBLE), least(greatest({x}, 0.0), 1.0) + least(greatest(l_linenumber / 20.0::DOUBLE, 0.0), 1.0))")


@query(f"""SELECT {_KEYS}, {_CHANNEL.format("l_discount * 10")} AS gray, {_CHANNEL.format("l_tax * 12.5")} AS red, {_CHANNEL.format("l_quantity / 40")} AS green,
{_CHANNEL.format("l_discount * 10 - 0.25")} AS blue, {_ink("l_discount * 10")} AS r, {_ink("l_tax * 12.5")} AS g, {_ink("l_quantity / 50")} AS b FROM lineitem""")
def device_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = [F.expr(x) for x in ("l_discount * 10", "l_tax * 12.5D", "l_quantity / 40", "l_discount * 10 - 0.25D")]
    red, green, blue = colour.rgb(*one[1:])
    r, g, b = colour.cmyk(one[0], one[1], F.expr("l_quantity / 50"), F.expr("l_linenumber / 20.0D"))
    named = {"gray": colour.gray(one[0])[0], "red": red, "green": green, "blue": blue, "r": r, "g": g, "b": b}
    return table(spark, sf_dir, "lineitem").select(*_KEY, *[v.alias(k) for k, v in named.items()])


_D50 = (0.9642, 1.0, 0.8249)
_SRGB = (0.4124, 0.2126, 0.0193, 0.3576, 0.7152, 0.1192, 0.1805, 0.0722, 0.9505)


def _cie_sql() -> str:
    """Written out step by step: XYZ, its cone responses scaled from the white point to D65's, linear RGB, the curve."""
    d = lambda x: f"CAST({x} AS DOUBLE)"
    dot = lambda m, v: " + ".join(f"{d(a)} * {x}" for a, x in zip(m, v))
    cones = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
    back = ((0.9869929, -0.1470543, 0.1599627), (0.4323053, 0.5183603, 0.0492912), (-0.0085287, 0.0400428, 0.9684867))
    rgb = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
    cube = "CASE WHEN {0} > 6 / 29::DOUBLE THEN {0} * {0} * {0} ELSE 3 * (6 / 29::DOUBLE) * (6 / 29::DOUBLE) * ({0} - 4 / 29::DOUBLE) END"
    g = [f"pow(least(greatest({x}, 0::DOUBLE), 1::DOUBLE), {d(k)})" for x, k in (("c1", 2.2), ("c2", 1.8), ("c3", 2.4))]
    spaces = {
        "lab": [f"({cube.format(t)}) * {d(w)}" for t, w in zip(("m + a_ / 500", "m", "m - b_ / 200"), _D50)],
        "gray": [f"{g[0]} * {d(w)}" for w in _D50],
        "cal": [" + ".join(f"{d(_SRGB[3 * i + j])} * {g[i]}" for i in range(3)) for j in range(3)],
    }
    spaces["lab"] = [f"({cube.format('(' + t + ')')}) * {d(w)}" for t, w in zip(("m + a_ / 500", "m", "m - b_ / 200"), _D50)]
    white = {"lab": "w50", "gray": "w50", "cal": "w65"}
    rows = " UNION ALL ".join(f"SELECT {_KEYS}, '{k}' AS space, '{white[k]}' AS w, {', '.join(f'{e} AS {n}' for e, n in zip(v, 'xyz'))} FROM i" for k, v in spaces.items())
    out = ", ".join(f"CAST(floor(255 * CASE WHEN u{i} <= 0.0031308 THEN u{i} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow(u{i}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END + 0.5) AS INTEGER) AS {n}" for i, n in enumerate("rgb"))
    scale = [f"CASE WHEN w = 'w65' THEN 1::DOUBLE ELSE ({dot(c, [d(0.95047), d(1), d(1.08883)])}) / ({dot(c, [d(v) for v in _D50])}) END" for c in cones]
    return f"""WITH i AS (SELECT {_KEYS}, (l_quantity * 2 + 16) / 116 AS m, l_discount * 1000 - 50 AS a_, l_tax * 1000 - 40 AS b_, l_discount * 10 AS c1, l_tax * 12.5 AS c2, l_quantity / 50 AS c3 FROM lineitem),
v AS ({rows}), k AS (SELECT *, {", ".join(f"({dot(c, 'xyz')}) * ({s}) AS k{i}" for i, (c, s) in enumerate(zip(cones, scale)))} FROM v),
a AS (SELECT *, {", ".join(f"CASE WHEN w = 'w65' THEN {n} ELSE {dot(b, ['k0', 'k1', 'k2'])} END AS a{i}" for i, (b, n) in enumerate(zip(back, 'xyz')))} FROM k),
u AS (SELECT *, {", ".join(f"least(greatest({dot(r, ['a0', 'a1', 'a2'])}, 0::DOUBLE), 1::DOUBLE) AS u{i}" for i, r in enumerate(rgb))} FROM a) SELECT {_KEYS}, space, {out} FROM u"""


@query(_cie_sql())
def cie_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab and calibrated gray under D50, calibrated RGB under D65."""
    c = [F.expr(x) for x in ("l_discount * 10", "l_tax * 12.5D", "l_quantity / 50")]
    found = {
        "lab": colour.lab(F.expr("l_quantity * 2"), F.expr("l_discount * 1000 - 50"), F.expr("l_tax * 1000 - 40"), _D50),
        "gray": colour.cal_gray(c[0], _D50, 2.2),
        "cal": colour.cal_rgb(*c, gamma=(2.2, 1.8, 2.4), matrix=_SRGB),
    }
    parts = [F.struct(F.lit(k).alias("space"), *[x.alias(n) for n, x in zip("rgb", v)]) for k, v in found.items()]
    return table(spark, sf_dir, "lineitem").select(*_KEY, F.explode(F.array(*parts)).alias("p")).select(*_KEY, "p.*")


_TINT = "CAST(floor(least(greatest({}, 0.0), 1.0) * 255 + 0.5) AS INTEGER)"


@query(f"""WITH i AS (SELECT {_KEYS}, least(greatest(l_discount * 10, 0), 1) AS t, least(greatest(l_tax * 12.5, 0), 1) AS u FROM lineitem)
SELECT {_KEYS}, {_TINT.format("1 - least(CAST(1 AS DOUBLE), t * 0.2 + t * 0.1)")} AS r, {_TINT.format("1 - least(CAST(1 AS DOUBLE), t * 0.9 + t * 0.1)")} AS g, {_TINT.format("1 - least(CAST(1 AS DOUBLE), t * 0.5 + t * 0.1)")} AS b,
{_TINT.format("1 * (1 - t) * (1 - u) + 0.25 * t * (1 - u) + 0.5 * (1 - t) * u + 0.0 * t * u")} AS dr, {_TINT.format("sqrt(t)")} AS dg FROM i""")
def ink_tints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A separation into CMYK by an exponential function, and two inks into RGB by a sampled one and an array of functions."""
    t, u = F.expr("l_discount * 10"), F.expr("l_tax * 12.5D")
    one = colour.tinted([t], lambda x: shapes.exponential(x, [0.0] * 4, [0.2, 0.9, 0.5, 0.1], 1.0), colour.cmyk)
    grid = F.array(*map(F.lit, (1.0, 0.25, 0.5, 0.0)))
    root = shapes.array([lambda x: shapes.exponential(x, [0.0], [1.0], 0.5)[0]], t)
    two = colour.tinted([t, u], lambda x, y: [shapes.sampled([x, y], grid, [2, 2], [(0.0, 1.0)] * 2), *root, F.lit(0.0)], colour.rgb)
    return table(spark, sf_dir, "lineitem").select(*_KEY, *[x.alias(n) for n, x in zip("rgb", one)], two[0].alias("dr"), two[1].alias("dg"))


@query("""SELECT o_orderkey, CASE WHEN last IS NULL THEN 'Raw' WHEN last = 'FlateDecode' THEN 'Flate' WHEN last = 'LZWDecode' THEN 'Lzw' WHEN last = 'RunLengthDecode' THEN 'RunLength' WHEN last = 'DCTDecode' THEN 'Jpeg' WHEN last = 'JPXDecode' THEN 'Jpeg2000' ELSE 'Other' END AS family
FROM (SELECT o_orderkey, list_last(list_filter([CASE o_orderstatus WHEN 'F' THEN 'ASCIIHexDecode' WHEN 'O' THEN 'FlateDecode' ELSE 'DCTDecode' END,
CASE WHEN o_orderpriority LIKE '1%' THEN 'RunLengthDecode' WHEN o_orderpriority LIKE '2%' THEN 'ASCII85Decode' WHEN o_orderpriority LIKE '3%' THEN 'LZWDecode' WHEN o_orderpriority LIKE '4%' THEN 'A85' ELSE 'Custom' END],
lambda f: f NOT IN ('ASCIIHexDecode', 'AHx', 'ASCII85Decode', 'A85'))) AS last FROM orders)""")
def encoding_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = F.expr("""array(CASE o_orderstatus WHEN 'F' THEN 'ASCIIHexDecode' WHEN 'O' THEN 'FlateDecode' ELSE 'DCTDecode' END,
      CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'RunLengthDecode' WHEN '2' THEN 'ASCII85Decode' WHEN '3' THEN 'LZWDecode' WHEN '4' THEN 'A85' ELSE 'Custom' END)""")
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.encoding_family(filters).alias("family"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, n_chars FROM documents")
def text_string_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))
    raw = F.when(F.expr("doc_id % 2 = 0"), wide).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
    decoded = strings.text_string(raw)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce(decoded, F.lit("")).cast("binary"), 256).alias("digest"), "n_chars")


@query("SELECT doc_id, sha256(text) AS digest, CAST(strlen(text) AS INTEGER) AS bytes, sha256('lang=' || lang || ';source=' || source) AS dictionary FROM documents")
def payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").alias("bytes"), strings.dictionary_digest(["lang", "source"]).alias("dictionary")
    )


_ELIGIBLE = "lang <> 'en' OR n_chars > 200"


@query(f"""WITH e AS (SELECT doc_id, source, strlen(text) AS bytes, row_number() OVER (PARTITION BY lang, strlen(text), sha256(text) ORDER BY doc_id) AS k FROM documents WHERE {_ELIGIBLE})
SELECT source, CAST(count(*) AS BIGINT) AS duplicates, CAST(sum(bytes) AS BIGINT) AS bytes FROM e WHERE k > 1 GROUP BY source""")
def duplicate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(_ELIGIBLE)
    keyed = rows.select("doc_id", "source", "lang", F.octet_length("text").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    # A group is (copies by source, first id and its source): its members need not meet in one task.
    by_source = keyed.groupBy("lang", "bytes", "digest", "source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"))
    groups = by_source.groupBy("lang", "bytes", "digest").agg(F.min(F.struct("low", "source")).alias("kept"), F.collect_list(F.struct("source", "n")).alias("parts"))
    left = groups.select("bytes", "kept", F.inline("parts")).withColumn("n", F.col("n") - F.when(F.col("source") == F.col("kept.source"), 1).otherwise(0))
    return left.where("n > 0").groupBy("source").agg(F.sum("n").alias("duplicates"), F.sum(F.col("bytes") * F.col("n")).alias("bytes"))


@query("""SELECT lang, source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(doc_id) AS first, CAST(row_number() OVER (ORDER BY sum(strlen(text)) DESC, min(doc_id)) - 1 AS BIGINT) AS place FROM documents GROUP BY lang, source""")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("first"))
    return groups.withColumn("place", (F.row_number().over(W.orderBy(F.desc("bytes"), "first")) - 1).cast("long"))  # a row for each language and source


@query("SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes FROM documents ORDER BY bytes DESC, doc_id LIMIT 32")
def largest_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("bytes")).orderBy(F.desc("bytes"), "doc_id").limit(32)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice) FILTER (WHERE l_linenumber = 1) / sum(l_quantity) FILTER (WHERE l_linenumber = 1), 6) AS ratio FROM lineitem GROUP BY ALL")
def sampled_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = lambda c: F.sum(F.when(F.col("l_linenumber") == 1, F.col(c)))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(sampled("l_extendedprice") / sampled("l_quantity"), 6).alias("ratio"))


_SURFACES = {"body": ("documents", "doc_id", "text"), "page": ("pages", "page_id", "html"), "item": ("benchmark", "item_id", "text")}
_SECRET = "[0-9]{3,}"


@query(" UNION ALL ".join(f"SELECT '{s}' AS surface, {k} AS id, CAST(len(regexp_extract_all({c}, '{_SECRET}')) AS INTEGER) AS scrubbed, sha256(regexp_replace({c}, '{_SECRET}', '#', 'g')) AS digest FROM {t}" for s, (t, k, c) in _SURFACES.items()))
def metadata_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scrub({s: table(spark, sf_dir, t).select(F.col(k).alias("id"), F.col(c).alias("value")) for s, (t, k, c) in _SURFACES.items()}, _SECRET, "#").select(
        "surface", "id", "scrubbed", F.sha2(F.col("value").cast("binary"), 256).alias("digest")
    )


_SCRIPTS = r"[A-Za-z\x{00C0}-\x{024F}]+|[\x{0370}-\x{03FF}]+|[\x{0400}-\x{04FF}]+|[\x{0590}-\x{08FF}]+|[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]+|[^A-Za-z\x{00C0}-\x{024F}\x{0370}-\x{03FF}\x{0400}-\x{04FF}\x{0590}-\x{08FF}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]+"


@query(f"SELECT doc_id, CAST(len(r) AS INTEGER) AS runs, coalesce(list_max(list_transform(r, lambda x: length(x))), 0)::INTEGER AS longest FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SCRIPTS}') AS r FROM documents)")
def script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = strings.script_runs(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(runs).alias("runs"), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).alias("longest"))


@query(f"SELECT {_KEYS}, (CAST(floor(l_extendedprice * 65536) AS BIGINT) * CAST(floor(l_discount * 65536) AS BIGINT) + 32768) >> 16 AS product FROM lineitem")
def fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_KEY, shapes.fixed_times(F.expr("floor(l_extendedprice * 65536)"), F.expr("floor(l_discount * 65536)")).alias("product"))
