"""Parquet tables, and relations of documents derived from them.

A page is one row with its letters nested, so that words, lines and matches of a page are computed
inside the row: nothing is shuffled until rows of different pages must meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Geometry of derived pages: letters a row, rows a page, advance, leading, size, left and top margin.
COLUMNS, ROWS, ADVANCE, LEADING, SIZE, LEFT, TOP = 66, 60, 6.0, 12.0, 10.0, 40.0, 752.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is read from fewer files than those (one row group is one task); a large input is left as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * n) if len(df.inputFiles()) < n else df


def settled(df: DataFrame, **columns) -> DataFrame:
    """df with columns that the optimizer computes once a row: it does not merge what stands on either side of a generator.

    Needed where an array is read by place inside a lambda, which would else compute the array for each element.
    """
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def page_texts(docs: DataFrame, letters: int = COLUMNS * ROWS) -> DataFrame:
    """(doc_id, page, page_text): the whole text cut into pages of so many letters; no page for an empty text."""
    n = F.length("text")
    return (
        docs.where(n > 0)
        .select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.expr(f"(length(text) - 1) div {letters}").cast("int"))).alias("page"))
        .select("doc_id", "page", F.expr(f"substring(text, page * {letters} + 1, {letters})").alias("page_text"))
    )


def _placed(batch, leading: float):
    """(doc_id, page, Letters) of all pages of a batch (doc_id, text), some documents at a time."""
    import numpy as np
    import pyarrow as pa

    from ..operators.assembly import Letters, pieces

    for part in pieces(batch, "text"):
        texts = part.column("text")
        raw = "".join(x for x in texts.to_pylist() if x)
        code = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
        data = raw.encode()
        size = np.ones(len(code), np.int32) if len(data) == len(code) else 1 + (code > 0x7F).astype(np.int32) + (code > 0x7FF) + (code > 0xFFFF)
        values = pa.StringArray.from_buffers(len(code), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(data))
        long = np.array([len(x) if x else 0 for x in texts.to_pylist()], np.int64)
        count = -(-long // (COLUMNS * ROWS))
        doc = np.repeat(np.arange(len(long)), count)
        page = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        at = np.append((np.cumsum(long) - long)[doc] + page * (COLUMNS * ROWS), len(code))
        i = np.arange(len(code), dtype=np.int32) - np.repeat(at[:-1], np.diff(at)).astype(np.int32)
        row, column = np.divmod(i, COLUMNS)
        after = np.zeros(len(code), np.bool_)
        after[1:] = (code[:-1] == 44) | (code[:-1] == 46)
        x = LEFT + ADVANCE * column + (code % 5) * 0.4 + np.where(after & (column > 0), 3.2, 0.0)
        one = [np.broadcast_to(v, len(code)) for v in (ADVANCE, SIZE, 1.0, 0.0)]
        yield part.column("doc_id").take(pa.array(doc)), pa.array(page, pa.int32()), Letters(at, values, x, TOP - leading * row, *one)


def placed(docs: DataFrame, leading: float = LEADING):
    """The source (operators.assembly) of every page's positioned letters, which are made where they are read.

    Letter i stands in column i % 66 and row i div 66, moved right by (code point % 5) * 0.4, and by 3.2 more after a
    full stop or a comma in the same row.
    """
    from ..operators.assembly import Source

    kind = dict(docs.dtypes)["doc_id"]

    def nested(keys: DataFrame | None) -> DataFrame:
        if keys is None:
            return letters(docs, leading)
        some = docs.join(keys.select("doc_id").distinct(), "doc_id", "left_semi")
        return letters(some, leading).join(keys.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")

    return Source(spread(docs.select("doc_id", "text")), (kind, "int"), lambda batch: _placed(batch, leading), nested)


def letters(docs: DataFrame, leading: float = LEADING) -> DataFrame:
    """(doc_id, page, letters): the letters of placed as a row a page, in content order."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for doc, page, found in _placed(batch, leading):
                held = [found.values, *map(pa.array, (found.x, found.y, found.adv, found.size, found.dx, found.dy)), pa.nulls(len(found.values), pa.int32())]
                rows = pa.ListArray.from_arrays(pa.array(found.at, pa.int32()), pa.StructArray.from_arrays(held, names=["value", "x", "y", "adv", "size", "dx", "dy", "mcid"]))
                yield pa.RecordBatch.from_arrays([doc, page, rows], names=["doc_id", "page", "letters"])

    one = "struct<value: string, x: double, y: double, adv: double, size: double, dx: double, dy: double, mcid: int>"
    return spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, page int, letters array<{one}>")


#: The same letters, flat, for DuckDB: l(doc_id, page, i, c, x, y).
LETTERS_SQL = f"""
l0 AS (
  SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS p FROM documents WHERE length(text) > 0
), l1 AS (
  SELECT doc_id, c, p // {COLUMNS * ROWS} AS page, p % {COLUMNS * ROWS} AS i, lag(c) OVER (PARTITION BY doc_id ORDER BY p) AS pc FROM l0
), l AS (
  SELECT doc_id, page, i, c,
    CAST({LEFT} AS DOUBLE) + CAST({ADVANCE} AS DOUBLE) * (i % {COLUMNS}) + (ascii(c) % 5) * CAST(0.4 AS DOUBLE)
      + CASE WHEN i % {COLUMNS} > 0 AND pc IN ('.', ',') THEN CAST(3.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x,
    CAST({TOP} AS DOUBLE) - CAST(LEAD_ AS DOUBLE) * (i // {COLUMNS}) AS y
  FROM l1
)"""


def letters_sql(leading: float = LEADING) -> str:
    return LETTERS_SQL.replace("LEAD_", str(leading))
