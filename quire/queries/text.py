"""Words, lines and text of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, lines, order
from ..sources.tables import letters_sql, placed, spread, table
from . import query

#: Words of the flat letters: w(doc_id, page, word, text, n_letters, l, b, r, t).
WORDS_SQL = """
g AS (
  SELECT *, c IN (' ', chr(9), chr(10), chr(12), chr(13), chr(160)) AS bl, lag(x) OVER o AS px, lag(y) OVER o AS py,
    lag(c) OVER o IN (' ', chr(9), chr(10), chr(12), chr(13), chr(160)) AS pbl
  FROM l WINDOW o AS (PARTITION BY doc_id, page ORDER BY i)
), h AS (
  SELECT *, sum(CASE WHEN px IS NULL OR pbl OR abs(y - py) > CAST(0.35 AS DOUBLE) * 10 OR x - px - 6 > CAST(0.26 AS DOUBLE) * 10 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id, page ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM g WHERE NOT bl
), w AS (
  SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY min(i)) - 1 AS INTEGER) AS word, string_agg(c, '' ORDER BY i) AS text,
    CAST(count(*) AS INTEGER) AS n_letters, min(x) AS l, min(y) AS b, max(x) + 6 AS r, max(y) + 10 AS t, min(i) AS first_
  FROM h GROUP BY doc_id, page, island
)"""


def _pages(spark: SparkSession, sf_dir: str, leading: float = 12.0) -> assembly.Source:
    return placed(table(spark, sf_dir, "documents"), leading)


@query(f"WITH {letters_sql()}, {WORDS_SQL} SELECT doc_id, page, word, text, n_letters FROM w")
def word_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.word_rows(_pages(spark, sf_dir), boxes=False)


@query(f"WITH {letters_sql()}, {WORDS_SQL} SELECT doc_id, page, word, round(l, 4) AS l, round(b, 4) AS b, round(r, 4) AS r, round(t, 4) AS t FROM w")
def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assembly.word_rows(_pages(spark, sf_dir))
    return rows.select("doc_id", "page", "word", *[F.round(c, 4).alias(c) for c in ("l", "b", "r", "t")])


#: Bands of words by the anchor rule (all sizes 10): each band starts at the highest middle over 5 below the last start.
BANDS_SQL = """
m AS (SELECT DISTINCT doc_id, page, (b + t) / 2 AS k FROM w),
a AS (
  SELECT doc_id, page, 0 AS band, max(k) AS k FROM m GROUP BY doc_id, page
  UNION ALL
  SELECT a.doc_id, a.page, a.band + 1, (SELECT max(m.k) FROM m WHERE m.doc_id = a.doc_id AND m.page = a.page AND m.k < a.k - 5) FROM a
  WHERE EXISTS (SELECT 1 FROM m WHERE m.doc_id = a.doc_id AND m.page = a.page AND m.k < a.k - 5)
), wb AS (
  SELECT w.*, (SELECT max(a.band) FROM a WHERE a.doc_id = w.doc_id AND a.page = w.page AND a.k >= (w.b + w.t) / 2) AS band FROM w
)"""


@query(f"WITH RECURSIVE {letters_sql(4.0)}, {WORDS_SQL}, {BANDS_SQL} SELECT doc_id, page, word, CAST(band AS INTEGER) AS band FROM wb")
def line_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading 4 at size 10, so that neighbouring rows share a band and only the anchor parts them."""
    return assembly.band_rows(_pages(spark, sf_dir, 4.0))


ORDER_SQL = f"WITH RECURSIVE {letters_sql(4.0)}, {WORDS_SQL}, {BANDS_SQL}"


@query(f"""WITH {letters_sql()}, {WORDS_SQL}, v AS (SELECT doc_id, page, (word * 7 + doc_id + n_letters) % 4 AS d, sum(n_letters) AS n, min(word) AS first_ FROM w GROUP BY ALL)
SELECT doc_id, page, CAST(first(d ORDER BY n DESC, first_) AS INTEGER) AS direction FROM v GROUP BY doc_id, page""")
def dominant_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words turned by their place, page and length, some not quite upright, so that all four directions win and tie."""
    pages = assembly.word_votes(_pages(spark, sf_dir)).where("size(words) > 0")
    turn = "cast((w.word * 7 + doc_id + w.n_letters) % 4 as int)"
    one = f"named_struct('word', w.word, 'n_letters', w.n_letters, 'dx', element_at(array(0.9D, 0.2D, -1.0D, -0.1D), {turn} + 1), 'dy', element_at(array(-0.3D, 0.8D, 0.0D, -0.9D), {turn} + 1))"
    turned = pages.select("doc_id", "page", F.expr(f"transform(words, w -> {one})").alias("words"))
    return turned.select("doc_id", "page", order.dominant_direction().alias("direction"))


def _two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 60 words of a document each, two a row: even ones in a column at 40, odd ones in one at 320 if the document's id is even."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in assembly.pieces(batch, "text"):
                texts = [x.encode() if x else b"" for x in part.column("text").to_pylist()]
                data = np.frombuffer(b" ".join(texts), np.uint8)
                shown = np.concatenate([[False], (data > 0x20) & (data < 0x7F), [False]])
                edge = np.flatnonzero(shown[1:] != shown[:-1])
                begin, end = edge[::2], edge[1::2]
                size = end - begin
                count = np.diff(np.searchsorted(begin, np.append(0, np.cumsum([len(x) + 1 for x in texts]))))  # of each document's words
                many = -(-count // 60)
                doc = np.repeat(np.arange(len(count)), many)
                page = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                at = np.append((np.cumsum(count) - count)[doc] + page * 60, len(begin))
                of = np.repeat(np.arange(len(doc)), np.diff(at))
                word = np.arange(len(begin)) - at[of]
                even = part.column("doc_id").to_numpy(zero_copy_only=False)[doc][of] % 2 == 0
                left = np.where(word % 2 == 1, np.where(even, 320.0, 150.0), 40.0)
                low = 700.0 - 12 * (word // 2)
                kept = data[shown[1:-1]]
                text = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(kept))
                n, none = len(word), np.zeros(len(word), np.int32)
                numbers = {"l": left, "b": low, "r": left + 6.0 * np.minimum(size, 30), "t": low + 10, "size": np.full(n, 10.0), "dx": np.ones(n), "dy": np.zeros(n)}
                whole = {"word": word, "first": none, "last": none, "text": text, "n_letters": size, **numbers, "mcid": word}
                held = {k: v if k == "text" else pa.array(v, pa.float64() if k in numbers else pa.int32()) for k, v in whole.items()}
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(page, pa.int32()), assembly.lists(at, held)], names=["doc_id", "page", "words"])

    one = "struct<word: int, first: int, last: int, text: string, n_letters: int, l: double, b: double, r: double, t: double, size: double, dx: double, dy: double, mcid: int>"
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, page int, words array<{one}>")


TWO_SQL = r"""
v0 AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\x21-\x7E]+'), lambda x: x <> '') AS ws FROM documents
), v1 AS (
  SELECT doc_id, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS p FROM v0
), v AS (
  SELECT doc_id, CAST(p // 60 AS INTEGER) AS page, CAST(p % 60 AS INTEGER) AS word, text,
    CAST(CASE WHEN p % 60 % 2 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 320 ELSE 150 END ELSE 40 END AS DOUBLE) AS l,
    CAST(CASE WHEN p % 60 % 2 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 320 ELSE 150 END ELSE 40 END + 6 * least(length(text), 30) AS DOUBLE) AS r,
    (p % 60) // 2 AS band FROM v1
), e AS (
  SELECT doc_id, page, min(l) AS lo, (max(r) - min(l)) / 200 AS step FROM v GROUP BY doc_id, page
), cov AS (
  SELECT DISTINCT v.doc_id, v.page, unnest(range(greatest(0, least(199, CAST(floor((l - lo) / step) AS BIGINT))), greatest(0, least(199, CAST(floor((r - lo) / step) AS BIGINT))) + 1)) AS k
  FROM v JOIN e ON v.doc_id = e.doc_id AND v.page = e.page
), free AS (
  SELECT e.doc_id, e.page, e.lo, e.step, x.k FROM e, (SELECT unnest(range(66, 134)) AS k) x
  WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.doc_id = e.doc_id AND cov.page = e.page AND cov.k = x.k)
), runs AS (
  SELECT doc_id, page, lo, step, min(k) AS s, count(*) AS n FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id, page ORDER BY k) AS g FROM free)
  GROUP BY doc_id, page, lo, step, g HAVING count(*) >= 5
), gut AS (
  SELECT doc_id, page, arg_min(lo + (s + n / 2) * step, s) AS cut FROM runs GROUP BY doc_id, page
), ok AS (
  SELECT gut.doc_id, gut.page, cut FROM gut JOIN v ON v.doc_id = gut.doc_id AND v.page = gut.page GROUP BY gut.doc_id, gut.page, cut
  HAVING count(DISTINCT CASE WHEN (l + r) / 2 < cut THEN band END) >= 2 AND count(DISTINCT CASE WHEN (l + r) / 2 >= cut THEN band END) >= 2
)"""


@query(f"WITH {TWO_SQL} SELECT e.doc_id, e.page, round(cut, 6) AS cut FROM e LEFT JOIN gut ON e.doc_id = gut.doc_id AND e.page = gut.page")
def column_gutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_columns(spark, sf_dir).select("doc_id", "page", F.round(order.gutter(), 6).alias("cut"))


@query(f"""WITH {TWO_SQL}
SELECT v.doc_id, v.page, word, CAST(row_number() OVER (PARTITION BY v.doc_id, v.page ORDER BY CASE WHEN cut IS NULL OR (l + r) / 2 < cut THEN 0 ELSE 1 END, band, l, word) - 1 AS INTEGER) AS place
FROM v LEFT JOIN ok ON v.doc_id = ok.doc_id AND v.page = ok.page""")
def reading_order_geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = lines.in_reading_order(_two_columns(spark, sf_dir))
    return pages.select("doc_id", "page", F.posexplode("ordered").alias("place", "w")).select("doc_id", "page", "w.word", "place")


@query(f"""WITH {TWO_SQL}, ranked AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n, CASE WHEN word % 7 <> 3 THEN 59 - word ELSE 60 + word END AS rank_ FROM v
), best AS (SELECT *, min(rank_) OVER (PARTITION BY doc_id, page, band) AS first_ FROM ranked)
SELECT doc_id, page, word, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY first_, rank_, l, word) - 1 AS INTEGER) AS place FROM best""")
def reading_order_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged order runs backwards; every seventh word is an artifact without a rank, so it comes after ranked ones (order length + place)."""
    pages = _two_columns(spark, sf_dir).withColumn("ranks", F.expr("transform(words, w -> if(w.word % 7 <> 3, 59 - w.word, 60 + w.word))"))
    pages = lines.in_reading_order(pages, "ranks")
    return pages.select("doc_id", "page", F.posexplode("ordered").alias("place", "w")).select("doc_id", "page", "w.word", "place")


PAGE_TEXT_SQL = f"""{ORDER_SQL}, ln AS (
  SELECT doc_id, page, band, string_agg(text, ' ' ORDER BY l, word) AS s FROM wb GROUP BY doc_id, page, band
), pt AS (SELECT doc_id, page, string_agg(s, chr(10) ORDER BY band) AS page_text FROM ln GROUP BY doc_id, page)"""


def _page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.band_texts(_pages(spark, sf_dir, 4.0))


@query(f"{PAGE_TEXT_SQL} SELECT doc_id, page, page_text FROM pt")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_texts(spark, sf_dir)


@query(f"{PAGE_TEXT_SQL} SELECT doc_id, string_agg(page_text, chr(10) ORDER BY page) AS text FROM pt GROUP BY doc_id")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.document_text(_page_texts(spark, sf_dir))


@query("""
WITH s AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS rank_ FROM conversations WHERE role <> 'assistant'),
n AS (SELECT conv_id, count(*) AS n FROM s GROUP BY conv_id),
w AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT w.conv_id, w.turn, CAST(coalesce(s.rank_, coalesce(n.n, 0) + w.i) AS BIGINT) AS rank_, n.n IS NOT NULL AS structured
FROM w LEFT JOIN s ON w.conv_id = s.conv_id AND w.turn = s.turn LEFT JOIN n ON w.conv_id = n.conv_id
""")
def mcid_rank_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as words of a page: the structure lists them backwards, assistants' turns are artifacts."""
    from ..operators.structure import ranks

    turns = table(spark, sf_dir, "conversations")
    order = turns.where("role <> 'assistant'").select("conv_id", F.col("turn").alias("mcid"), (-F.col("turn")).alias("pos"))
    return ranks(turns.select("conv_id", F.col("turn").alias("mcid")), order, ["conv_id"]).select("conv_id", F.col("mcid").alias("turn"), "rank_", "structured")
