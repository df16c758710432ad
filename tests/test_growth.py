"""Faults that only larger tables show, on small made ones."""

import glob
import os

import duckdb
import pytest

from quire import catalogue

SF = "/root/testdata/sf0.001"


def same(spark, folder, name):
    """Whether a query over a folder's tables gives what its SQL gives; how many rows."""
    duck = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = catalogue.QUERIES[name](spark, str(folder))
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    rows = got.collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    return len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["skip_reasons", "classify_images"])
def test_a_supplier_with_the_number_of_a_part_is_listed(spark, tmp_path, name):
    duck = duckdb.connect()
    for t, moved in (("part", "p_partkey + 999990 AS p_partkey"), ("lineitem", "l_partkey + 999990 AS l_partkey"), ("supplier", "s_suppkey AS s_suppkey")):
        duck.execute(f"COPY (SELECT * REPLACE ({moved}) FROM '{SF}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    assert same(spark, tmp_path, name)


def planned(spark, name):
    return catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["word_assembly", "word_boxes", "line_bands", "page_text", "document_text", "column_gutter"])
def test_no_letter_or_word_is_walked_by_a_lambda(spark, name):
    """Letters and words are arrays from the text on: a lambda over them is interpreted, a field at a time."""
    assert "generate explode" not in planned(spark, name).lower() and "struct(value" not in planned(spark, name)


def test_bands_gutters_and_directions_by_arrays_equal_the_rules(spark):
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from quire.operators import assembly, lines, order, words

    r, pages = random.Random(7), []
    for p in range(40):
        out = [("a b. é"[r.randint(0, 5)], r.choice((10.0, 16.0, 22.0, 90.0, 400.0, 407.0)) + r.randint(0, 3), r.choice((0.0, 4.0, 7.0, 20.0, 24.0)), 6.0, r.choice((10.0, 10.0, 4.0)), 1.0, 0.0, None) for _ in range(r.randint(0, 50))]
        pages.append((p, 0, None if p == 3 else out))
    letter = "struct<value: string, x: double, y: double, adv: double, size: double, dx: double, dy: double, mcid: int>"
    frame = spark.createDataFrame(pages, f"doc_id long, page int, letters array<{letter}>").repartition(3)
    nested = words.page_words(frame).cache()
    want = lines.with_bands(nested).selectExpr("doc_id", "page", "inline(zip_with(words, bands, (w, b) -> named_struct('word', w.word, 'band', b)))").collect()
    assert len(want) > 200 and sorted(map(tuple, assembly.band_rows(frame).collect())) == sorted(map(tuple, want))
    for columns in (True, False):
        read = lines.in_reading_order(nested, columns=columns).select("doc_id", "page", F.expr(lines.page_text()).alias("text")).collect()
        assert sorted(map(tuple, assembly.read_texts(frame, columns).collect())) == sorted((x.doc_id, x.page, x.text or "") for x in read)
    both = nested.select(F.expr(lines.gutter()).alias("a"), order.gutter().alias("b")).collect()
    assert all(x.a == x.b for x in both) and any(x.a is not None for x in both)
    at, dx = [0, 2, 2, 5], np.array([1.0, 0.0, -1.0, 0.0, 0.1])
    rows = spark.createDataFrame([([(i, 3, float(dx[i]), 0.5) for i in range(at[k], at[k + 1])],) for k in range(3)], "words array<struct<word: int, n_letters: int, dx: double, dy: double>>")
    assert [x[0] for x in rows.coalesce(1).select(order.dominant_direction()).collect()] == [0, 0, 1]


def test_boxes_meet_by_cells_of_both_axes(spark):
    import random

    from quire.operators import search

    r = random.Random(3)
    side = lambda n: [(r.randint(0, 2), i, float(x), float(y), x + r.choice((1.0, 5.0, 70.0, -4.0)), y + r.choice((1.0, 9.0, 200.0, -6.0))) for i in range(n) for x, y in [(r.randint(-60, 60), r.randint(-300, 300))]]
    a, b = side(150), side(200)
    schema = "page int, id long, l double, b double, r double, t double"
    met = search.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "page", 10.0)
    want = [(p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5]]
    assert len(want) > 100 and sorted(map(tuple, met.collect())) == sorted(want)
    assert "_y" in met._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pages_without_a_match_are_read_once(spark):
    """Letters of pages are made for pages with a match alone; the text of all is read as arrays."""
    assert "letters#" not in planned(spark, "match_boxes")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["file_words", "file_placements", "file_fields", "file_references", "file_conformance"])
def test_files_are_read_in_arrow_batches(spark, name):
    """Rows of many files leave together; a frame a file cost more than reading it."""
    assert "MapInPandas" not in planned(spark, name) and "MapInArrow" in planned(spark, name)


def test_rows_of_files_keep_their_path_over_batches(spark):
    from quire.sources import pdf

    files = spark.createDataFrame([(f"p{i}", bytearray(b"x" * i)) for i in range(5)], "path string, content binary").coalesce(1)
    got = pdf.per_file(files, "path string, n int", lambda f: ((k,) for k in range(4000 * (len(f.data) % 4)))).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in got} == {f"p{i}": 4000 * (i % 4) for i in (1, 2, 3)}


def test_codes_of_a_long_stream_take_time_by_the_byte():
    import time

    from quire.functions import codecs

    data = bytes(range(256)) * 8192
    began = time.thread_time()
    assert codecs.hex_decode(data.hex().encode() + b">") == data
    assert time.thread_time() - began < 0.3
