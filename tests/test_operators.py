"""Hand-computed cases of the operators and functions."""

import pytest
from pyspark.sql import functions as F

from quire.functions import codecs, postscript, strings
from quire.operators import forms, graph, lines, pages, search, words
from quire.plans import images
from quire.sources import pdf

LETTER = "struct<value: string, x: double, y: double, adv: double, size: double, dx: double, dy: double, mcid: int>"


def page(spark, letters):
    return spark.createDataFrame([(1, 0, letters)], f"doc_id long, page int, letters array<{LETTER}>")


def letter(value, x, y=0.0, dx=1.0, dy=0.0):
    return (value, float(x), float(y), 6.0, 10.0, dx, dy, None)


@pytest.mark.parametrize(
    "letters, want",
    [
        ([letter("a", 0), letter("b", 6), letter("c", 14.5), letter("d", 23.2)], ["abc", "d"]),
        ([letter("a", 0), letter(" ", 6), letter("b", 12)], ["a", "b"]),
        ([letter("a", 10), letter("b", 4)], ["ab"]),
        ([letter("a", 0), letter("b", 6, 3.5)], ["ab"]),
        ([letter("a", 0), letter("b", 6, 3.6)], ["a", "b"]),
        ([letter("a", 0), letter("b", 6, 0, 0.0, 1.0)], ["a", "b"]),
        ([letter(None, 0), letter("", 6), letter(" ", 12)], []),
        ([], []),
    ],
)
def test_words(spark, letters, want):
    rows = words.word_rows(words.page_words(page(spark, letters))).collect()
    assert [r.text for r in sorted(rows, key=lambda r: r.word)] == want
    assert sum(r.n_letters for r in rows) == sum(len(t) for t in want)


def test_word_rows_equal_words_in_pages(spark):
    import random

    from quire.operators import assembly

    r, pages_ = random.Random(4), []
    for p in range(60):
        x, out = 0.0, []
        for i in range(r.randint(0, 40)):
            x += r.choice((6.0, 6.0, 6.0, 8.0, 9.5, -3.0))
            one = letter(r.choice(("a", "b", "fi", " ", "", "\u00a0", "  ", None, "\u00e9", "\U0001F600")), x, r.choice((0.0, 0.0, 0.0, 3.0, 9.0)), *r.choice(((1.0, 0.0),) * 6 + ((0.0, 1.0), (-1.0, 0.0))))
            out.append((*one[:4], r.choice((10.0, 10.0, 4.0)), *one[5:]))
        pages_.append((p // 7, p, out))
    frame = spark.createDataFrame([(d, p, None if p == 5 else o) for d, p, o in pages_], f"doc_id long, page int, letters array<{LETTER}>").repartition(3)
    columns = ["doc_id", "page", "word", "text", "n_letters", "l", "b", "r", "t"]
    want = words.word_rows(words.page_words(frame)).select(columns).collect()
    assert len(want) > 300 and sorted(map(tuple, assembly.word_rows(frame).collect())) == sorted(map(tuple, want))
    assert sorted(map(tuple, assembly.word_rows(frame, False).collect())) == sorted(tuple(w)[:5] for w in want)
    assert assembly.word_rows(frame.where("page < 0")).collect() == []


def _words(spark, boxes):
    one = "struct<word: int, first: int, last: int, text: string, n_letters: int, l: double, b: double, r: double, t: double, size: double, dx: double, dy: double, mcid: int>"
    rows = [(i, 0, 0, f"w{i}", 1, *map(float, b), 10.0, 1.0, 0.0, None) for i, b in enumerate(boxes)]
    return spark.createDataFrame([(1, 0, rows)], f"doc_id long, page int, words array<{one}>")


def test_bands_go_by_their_first_word(spark):
    got = lines.with_bands(_words(spark, [(0, -y - 5, 5, -y + 5) for y in (0, 4, 8)])).first().bands
    assert got == [0, 0, 1]


def test_gutter_needs_five_free_buckets(spark):
    five = _words(spark, [(0, 0, 94.5, 10), (100.5, 0, 200, 10)])
    four = _words(spark, [(0, 0, 95.5, 10), (100.5, 0, 200, 10)])
    assert five.select(F.expr(lines.gutter())).first()[0] == 97.5 and four.select(F.expr(lines.gutter())).first()[0] is None


def test_one_line_columns_are_no_columns(spark):
    got = lines.in_reading_order(_words(spark, [(110, 0, 200, 10), (0, 0, 80, 10)])).first().ordered
    assert [w.text for w in got] == ["w1", "w0"] and {w.col for w in got} == {0}


def test_literal_does_not_overlap(spark):
    texts = spark.createDataFrame([(1, "aaaa"), (2, "xx"), (3, "a.a.b")], "id long, text string")
    needles = spark.createDataFrame([(1, "aa"), (2, ""), (3, "a.")], "target long, needle string")
    got = sorted(map(tuple, search.literal_matches(texts, needles, "id").collect()))
    assert got == [(1, 1, 0, 2), (1, 1, 2, 2), (3, 3, 0, 2), (3, 3, 2, 2)]


def test_closure(spark):
    boxes = spark.createDataFrame([(p, *map(float, b)) for p, b in ((1, (0, 0, 2, 2)), (1, (1, 1, 3, 3)), (1, (2.5, 2.5, 4, 4)), (2, (0, 0, 1, 1)), (2, (1, 0, 2, 1)))], "page int, l double, b double, r double, t double")
    assert sorted(map(tuple, search.closure_2d(boxes, "page").collect())) == [(1, 0, 0, 4, 4), (2, 0, 0, 1, 1), (2, 1, 0, 2, 1)]
    spans = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.0, 3.0), (1, 2.5, 4.0)], "page int, l double, r double")
    assert sorted((r.l, r.r) for r in search.closure_1d(spans, ["page"]).collect()) == [(0, 2), (2, 4)]


def test_fixpoint_merges_children_then_parents(spark):
    objects = spark.createDataFrame([(1, "kid"), (2, "kid"), (3, "parent"), (4, "parent"), (5, "parent")], "obj long, payload string")
    refs = spark.createDataFrame([(3, 0, 1), (4, 0, 2), (5, 0, 3)], "src long, pos int, dst long")
    assert dict(map(tuple, graph.dedup_fixpoint(objects, refs).collect())) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_tree_without_root_has_no_rows(spark):
    nodes = spark.createDataFrame([(1, None, 0, "a"), (2, 1, 0, None), (3, 4, 0, "x"), (4, 3, 0, "y")], "node long, parent long, pos int, attr string")
    assert sorted(map(tuple, graph.flatten(nodes, ["attr"]).select("node", "attr").collect())) == [(1, "a"), (2, "a")]


def test_names(spark):
    fields = spark.createDataFrame([(1, "a.b[0]"), (2, "c.b[1]"), (3, "c.d")], "node long, full_name string")
    wanted = spark.createDataFrame([("b",), ("a.b[0]",), ("d",), ("e",)], "want string")
    got = {r.want: (r.node, r.status) for r in forms.lookup(fields, wanted).collect()}
    assert got == {"b": (None, "ambiguous"), "a.b[0]": (1, "found"), "d": (3, "found"), "e": (None, "missing")}
    names = spark.createDataFrame([(0, i, n) for i, n in enumerate(["x", "x", "x~2", "x"])], "doc int, pos int, name string")
    assert [r.unique for r in forms.unique_names(names, "doc", "pos").orderBy("pos").collect()] == ["x", "x~2", "x~2~2", "x~3"]


def test_plan_numbers(spark):
    row = spark.range(1).select(
        images.dpi(F.lit(900.0), F.lit(144.0), F.lit(0.0), F.lit(1.0)).alias("dpi"),
        images.target_size(F.lit(900), F.lit(450.0), 200.0).alias("size"),
        images.spread(F.lit(10), 3).alias("spread"),
    ).first()
    assert (row.dpi, row["size"], row.spread) == (450.0, 400, [1, 5, 8])
    groups = spark.createDataFrame([(1, 1), (2, 5), (3, 5)], "g int, n int")
    assert [r.taken for r in images.round_robin(groups, [F.col("g")], "n").orderBy("g").collect()] == [1, 3, 3]


def test_calculator(spark):
    one = lambda p, *x: spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(postscript.calculate(p, *map(F.lit, x)))]).first()
    assert one("{ round }", -2.5)[0] == -2.0 and one("{ 0 div }", 3)[0] == 0.0 and one("{ 2 idiv }", -7)[0] == -3.0 and one("{ 2 mod }", -7)[0] == -1.0
    assert list(one("{ 3 1 roll }", 1, 2, 3)) == [3.0, 1.0, 2.0] and list(one("{ 5 index }", 1)) == [1.0, 0.0]
    assert one("{ dup 0 lt { neg } if }", -4)[0] == 4.0 and abs(one("{ -1 atan }", 0)[0] - 180) < 1e-9 and one("{ 3 bitshift }", 1)[0] == 8.0


def test_dates(spark):
    rows = [("D:20200230",), ("D:1999",), ("20240102030405-02'30'",), ("D:2024139912",), ("x",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(F.date_format(strings.document_date(F.col("s")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2020-02-29 00:00", "1999-01-01 00:00", "2024-01-02 05:34", "2024-12-31 12:00", None, None]


def test_merge_of_split_is_the_same(spark):
    turns = spark.createDataFrame([(d, p, f"{d}{p}") for d in (1, 2) for p in range(3)], "doc int, page int, text string")
    back = pages.renumber(pages.split(turns, "doc", "page"), "doc", F.col("new_doc"))
    assert sorted((r.doc, r.place, r.text) for r in back.collect()) == sorted(map(tuple, turns.collect()))


@pytest.mark.parametrize("name", sorted(codecs.FILTERS))
def test_codecs(name):
    decode, encode = codecs.FILTERS[name]
    for data in (b"", b"a", b"aaaabbbbcdcdcdcd" * 400, bytes(range(256)) * 20):
        assert decode(encode(data)) == data


def test_codecs_against_fixed_bytes():
    # The LZW example of the format, rows filtered by hand.
    assert codecs.lzw_decode(bytes.fromhex("800B6050220C0C8501")) == bytes([45] * 5 + [65] + [45] * 3 + [66])
    assert codecs.lzw_encode(bytes([45] * 5 + [65] + [45] * 3 + [66])) == bytes.fromhex("800B6050220C0C8501")
    assert codecs.a85_decode(b"87cURD]i,\"Ebo80~>") == b"Hello World!" and codecs.hex_decode(b"48 65 6C6c 6f7>") == b"Hellop"
    assert codecs.run_length_decode(bytes([2, 65, 66, 67, 254, 90, 128, 1])) == b"ABCZZZ"
    mean = bytes([0, 10, 20, 30, 3, 5, 5, 5])
    assert codecs.png_undo(mean, 3) == bytes([10, 20, 30, 10, 20, 30])
    paeth = bytes([0, 10, 20, 30, 4, 1, 2, 3])
    assert codecs.png_undo(paeth, 3) == bytes([10, 20, 30, 11, 22, 33])
    assert codecs.png_undo(bytes([1, 250, 10, 1, 2, 6, 1, 1]), 3) == bytes([250, 4, 5, 0, 5, 6])


def test_a_bad_byte_keeps_what_was_inflated():
    import zlib

    text = b"".join(b"line %d of the stream\n" % (i * i) for i in range(4000))
    packed = bytearray(zlib.compress(text))
    packed[len(packed) // 2] ^= 0xFF
    got = codecs.flate_decode(bytes(packed))
    assert 1000 < len(got) and text.startswith(got[:1000]) and codecs.flate_decode(b"nonsense") == b""


def test_verdicts_on_any_number_of_segments(spark):
    from quire.operators import coverage

    rows = [([0, 10, 20, 30], 50, 4, "Whole"), ([0, 10, 20, 30], 50, 3, "Partial"), ([0, 10, 20, 30], 60, 4, "Partial"), ([0, 10, 20, 5, 30, 20], 50, 4, "Partial"), ([0, 50], 50, 0, "Partial"),
            ([0, 10, 20], 50, 4, "Malformed"), ([], 50, 4, "Malformed"), (None, 50, 4, "Malformed"), ([0, 10, 20, 31], 50, 4, "Malformed"), ([-1, 10, 20, 30], 50, 4, "Malformed"), ([1, 9, 20, 30], 50, 4, "Partial")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ranges array<bigint>, len long, held long, want string")
    got = frame.select("i", "want", coverage.verdict(F.col("ranges"), F.col("len"), F.col("held")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [r.want for r in got]


def test_reader_of_documents(spark, tmp_path):
    import zlib

    body = zlib.compress(b"BT /F1 10 Tf 1 0 0 1 40 700 Tm (Hello world) Tj 0 -12 Td [(Se) -20 (cond)] TJ ET")
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>"]
    parts += [b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /FirstChar 32 /Widths [" + b"600 " * 95 + b"] >>"]
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, p) for i, p in enumerate(parts, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"
    (tmp_path / "a.pdf").write_bytes(out)
    (tmp_path / "b.pdf").write_bytes(b"not a document")
    files = pdf.read_files(spark, f"{tmp_path}/*.pdf")
    objects = pdf.objects(files).collect()
    assert {r.obj for r in objects} == {1, 2, 3, 4, 5}
    found = words.word_rows(words.page_words(pdf.letters(files).withColumnRenamed("path", "doc_id"))).orderBy("word").collect()
    assert [r.text for r in found] == ["Hello", "world", "Second"]


def test_levels_and_rounds_left_over_are_errors(spark):
    import pytest

    from quire.operators import forms, graph

    chain = spark.createDataFrame([(i, i - 1 if i else None, 0, f"n{i}", None, None) for i in range(5)], "node long, parent long, pos long, name string, ft string, ff long")
    assert graph.flatten(chain, [], 5).count() == forms.full_names(chain, 5).count() == 5
    for walk in (lambda: graph.flatten(chain, [], 4), lambda: forms.full_names(chain, 4)):
        with pytest.raises(RuntimeError):
            walk()
    objects = spark.createDataFrame([(i, "leaf" if i < 2 else f"p{i // 2}") for i in range(8)], "obj long, payload string")
    refs = spark.createDataFrame([(i, 0, i - 2) for i in range(2, 8)], "src long, pos int, dst long")
    assert graph.dedup_fixpoint(objects, refs).select("canonical").distinct().count() == 4
    with pytest.raises(RuntimeError):
        graph.dedup_fixpoint(objects, refs, 2)
