"""Search, redaction targets and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, search
from ..sources.tables import letters_sql, page_texts, placed, table
from . import query
from .text import WORDS_SQL


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five words of each benchmark item as literal targets."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("target"), F.substring_index("text", " ", 5).alias("needle"))


_TARGETS_SQL = "tg AS (SELECT item_id AS target, array_to_string(string_split(text, ' ')[1:5], ' ') AS needle FROM benchmark)"
_STARTS_SQL = """
hit AS (SELECT doc_id, target, needle, string_split(text, needle) AS p FROM documents JOIN tg ON contains(text, needle)),
m AS (
  SELECT doc_id, target, CAST(k * length(needle) + list_sum(list_transform(p[1 : k + 1], lambda x: length(x))) AS INTEGER) AS start, CAST(length(needle) AS INTEGER) AS length
  FROM (SELECT *, unnest(range(0, len(p) - 1)) AS k FROM hit)
)"""


@query(f"WITH {_TARGETS_SQL}, {_STARTS_SQL} SELECT doc_id, target, start, length FROM m")
def literal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.literal_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), _targets(spark, sf_dir), "doc_id")


@query(r"""
SELECT doc_id, i AS nth, matched FROM (
  SELECT doc_id, unnest(a) AS matched, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{3}[-. ]?[0-9]{4}') AS a FROM documents))
""")
def regex_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.posexplode(F.regexp_extract_all("text", F.lit(r"[0-9]{3}[-. ]?[0-9]{4}"), F.lit(0))).alias("nth", "matched")
    return table(spark, sf_dir, "documents").select("doc_id", found)


_PATTERN = "[0-9]{3}[-. ]?[0-9]{4}"
#: Text of pages in reading order (one column, a row of letters is a line), where each letter stands in it, and the matches of literals in any case and of a pattern.
_READ_SQL = f"""{letters_sql()}, {WORDS_SQL}, {_TARGETS_SQL},
o AS (SELECT h.doc_id, h.page, h.i, h.c, h.x, h.y, w.l, w.word, h.i = w.first_ AS starts FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, page, island) AS f FROM h) h
  JOIN w ON h.doc_id = w.doc_id AND h.page = w.page AND h.f = w.first_),
rd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC, l, word, i) + dense_rank() OVER (PARTITION BY doc_id, page ORDER BY y DESC, l, word) - 2 AS pos,
  lag(y) OVER (PARTITION BY doc_id, page ORDER BY y DESC, l, word, i) AS before_ FROM o),
pt AS (SELECT doc_id, page, string_agg(CASE WHEN NOT starts OR before_ IS NULL THEN '' WHEN before_ = y THEN ' ' ELSE chr(10) END || c, '' ORDER BY pos) AS text FROM rd GROUP BY doc_id, page),
hit AS (SELECT doc_id, page, target, length(needle) AS n, string_split(lower(text), lower(needle)) AS p FROM pt JOIN tg ON contains(lower(text), lower(needle))),
pa AS (SELECT doc_id, page, regexp_extract_all(text, '{_PATTERN}') AS m, regexp_split_to_array(text, '{_PATTERN}') AS g FROM pt),
ma AS (
  SELECT doc_id, page, target, n, k * n + list_sum(list_transform(p[1 : k + 1], lambda x: length(x))) AS start FROM (SELECT *, unnest(range(0, len(p) - 1)) AS k FROM hit)
  UNION ALL SELECT doc_id, page, -1, length(m[k]), list_sum(list_transform(g[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0) FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM pa)
), bx AS (
  SELECT ma.doc_id, ma.page, target, CAST(start AS INTEGER) AS start, min(x) AS l, min(y) AS b, max(x) + 6 AS r, max(y) + 10 AS t
  FROM ma JOIN rd ON ma.doc_id = rd.doc_id AND ma.page = rd.page AND rd.pos >= start AND rd.pos < start + n GROUP BY ma.doc_id, ma.page, target, start
)"""


def _redacted(spark: SparkSession, sf_dir: str) -> tuple[assembly.Source, DataFrame]:
    """Pages, and the targets: literals, and numbers of seven digits."""
    number = spark.createDataFrame([(-1, _PATTERN, True)], "target long, needle string, pattern boolean")
    named = _targets(spark, sf_dir).select(F.col("target").cast("long"), "needle", F.lit(False).alias("pattern")).union(number)
    boxes = [F.lit(None).cast(t).alias(c) for c, t in (("page", "int"), ("l", "double"), ("b", "double"), ("r", "double"), ("t", "double"))]
    return placed(table(spark, sf_dir, "documents")), named.select("*", *boxes)


@query(f"WITH {_READ_SQL} SELECT doc_id, page, target, start, round(l, 4) AS l, round(b, 4) AS b, round(r, 4) AS r, round(t, 4) AS t FROM bx")
def match_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, targets = _redacted(spark, sf_dir)
    _, boxes = search.regions(pages, targets, case=False, columns=False)
    return boxes.select("doc_id", "page", "target", "start", *[F.round(c, 4).alias(c) for c in ("l", "b", "r", "t")])


def _closure_sql(boxes: str, keys: str) -> str:
    """Boxes (keys, id, l, b, r, t) grown, round by round, by all that overlap them; 20 rounds settle chains of a million."""
    k = [x.strip() for x in keys.split(",")]
    same = " AND ".join(f"p.{x} = q.{x}" for x in k)
    own = ", ".join(f"p.{x}" for x in k)
    return f"""cl AS (
  SELECT {keys}, id, l, b, r, t, 0 AS round FROM {boxes}
  UNION ALL SELECT {own}, p.id, min(q.l), min(q.b), max(q.r), max(q.t), any_value(p.round) + 1 FROM cl p JOIN cl q ON {same} AND p.l < q.r AND q.l < p.r AND p.b < q.t AND q.b < p.t WHERE p.round < 20 GROUP BY {own}, p.id
), un AS (SELECT DISTINCT {keys}, l, b, r, t FROM cl WHERE round = 20)"""


@query(f"""WITH RECURSIVE {_READ_SQL}, ids AS (SELECT doc_id, page, row_number() OVER () AS id, l, b, r, t FROM bx), {_closure_sql("ids", "doc_id, page")},
gone AS (SELECT DISTINCT l.doc_id, l.page, l.i FROM l JOIN un ON l.doc_id = un.doc_id AND l.page = un.page AND l.x < un.r AND un.l < l.x + 6 AND l.y < un.t AND un.b < l.y + 10)
SELECT m.doc_id, matches, regions, coalesce(letters, 0) AS letters, annotations FROM (SELECT doc_id, count(*) AS matches FROM bx GROUP BY doc_id) m
JOIN (SELECT doc_id, count(*) AS regions FROM un GROUP BY doc_id) u ON m.doc_id = u.doc_id LEFT JOIN (SELECT doc_id, count(*) AS letters FROM gone GROUP BY doc_id) g ON m.doc_id = g.doc_id
JOIN (SELECT un.doc_id, count(DISTINCT CASE WHEN l < 300 AND r > 250 AND b < 740 AND t > 700 THEN page END) AS annotations FROM un GROUP BY un.doc_id) a ON m.doc_id = a.doc_id""")
def redact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A redaction from targets to what goes; each page has one annotation."""
    pages, targets = _redacted(spark, sf_dir)
    notes = page_texts(table(spark, sf_dir, "documents")).select("doc_id", "page", F.col("page").alias("id"), F.lit(250.0).alias("l"), F.lit(700.0).alias("b"), F.lit(300.0).alias("r"), F.lit(740.0).alias("t"))
    return search.redact(pages, targets, notes, case=False, columns=False)[2]


_SURFACES = {"email": r"[a-z0-9._]+@[a-z0-9.]+", "number": r"[0-9]{5,}", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "notice": r"[Ll]icen[sc]e"}


@query("SELECT surface, CAST(sum(n) AS BIGINT) AS matches, CAST(count(*) AS BIGINT) AS documents FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS surface, len(regexp_extract_all(text, '{v}')) AS n FROM documents" for k, v in _SURFACES.items()) + ") WHERE n > 0 GROUP BY surface")
def redaction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by surface, counted where the text is read; only counts are shuffled."""
    docs = table(spark, sf_dir, "documents")
    counts = F.explode(F.create_map(*[x for k, v in _SURFACES.items() for x in (F.lit(k), F.regexp_count("text", F.lit(v)))])).alias("surface", "n")
    return docs.select(counts).where("n > 0").groupBy("surface").agg(F.sum("n").cast("long").alias("matches"), F.count(F.lit(1)).alias("documents"))


_BOX = "l_partkey % {m} AS page, {id} AS id, CAST({x} AS DOUBLE) AS l, CAST({y} AS DOUBLE) AS b, CAST({x} + {w} AS DOUBLE) AS r, CAST({y} + {h} AS DOUBLE) AS t"
_ID = "l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey"
_REGIONS = "SELECT p_partkey % 97 AS page, p_partkey AS id, CAST(p_retailprice % 500 AS DOUBLE) AS l, CAST(p_size * 10 AS DOUBLE) AS b, CAST(p_retailprice % 500 + p_size AS DOUBLE) AS r, CAST(p_size * 10 + 25 AS DOUBLE) AS t FROM part"
_MARKS = f"SELECT DISTINCT l_partkey % 97 AS page, {_ID} AS id, CAST(l_extendedprice % 500 AS DOUBLE) AS l, CAST(l_quantity * 10 AS DOUBLE) AS b, CAST(l_extendedprice % 500 + 2 AS DOUBLE) AS r, CAST(l_quantity * 10 + 8 AS DOUBLE) AS t FROM lineitem"


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, item = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    regions = part.selectExpr("p_partkey % 97 AS page", "p_partkey AS id", "p_retailprice % 500 AS l", "cast(p_size * 10 as double) AS b", "p_retailprice % 500 + p_size AS r", "cast(p_size * 10 + 25 as double) AS t")
    marks = item.selectExpr("l_partkey % 97 AS page", f"{_ID} AS id", "l_extendedprice % 500 AS l", "l_quantity * 10 AS b", "l_extendedprice % 500 + 2 AS r", "l_quantity * 10 + 8 AS t").distinct()
    return regions, marks


@query(f"WITH p AS ({_REGIONS}), q AS ({_MARKS}) SELECT p.page, p.id AS left_id, q.id AS right_id FROM p JOIN q ON p.page = q.page AND p.l < q.r AND q.l < p.r AND p.b < q.t AND q.b < p.t")
def region_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, marks = _boxes(spark, sf_dir)
    return search.overlap_join(regions, marks, "page", 50.0)


@query(f"""WITH q AS ({_REGIONS}),
f AS (SELECT page, l, r, max(r) OVER (PARTITION BY page ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q),
k AS (SELECT page, l, r, sum(CASE WHEN reach IS NULL OR l >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT page, round(min(l), 6) AS l, round(max(r), 6) AS r FROM k GROUP BY page, k""")
def region_closure_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, _ = _boxes(spark, sf_dir)
    return search.closure_1d(regions, ["page"]).select("page", F.round("l", 6).alias("l"), F.round("r", 6).alias("r"))


@query(f"WITH RECURSIVE bx AS ({_REGIONS}), {_closure_sql('bx', 'page')} SELECT page, round(l, 6) AS l, round(b, 6) AS b, round(r, 6) AS r, round(t, 6) AS t FROM un")
def region_closure_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, _ = _boxes(spark, sf_dir)
    return search.closure_2d(regions, "page").select("page", *[F.round(c, 6).alias(c) for c in "lbrt"])
