"""Document files built by hand, read as relations."""

import zlib

import pytest
from pyspark.sql import functions as F

from quire.functions import strings
from quire.operators import coverage, forms, graph, revisions, structure, words
from quire.sources import fonts, parts, pdf


def stream(body: bytes, head: bytes = b"") -> bytes:
    packed = zlib.compress(body)
    return b"<< /Length %d /Filter /FlateDecode %s >>\nstream\n%s\nendstream" % (len(packed), head, packed)


def build(objects: dict[int, bytes], extra: bytes = b"", before: bytes = b"", prev: int | None = None, free: tuple = ()) -> bytes:
    out, at = before or b"%PDF-1.7\n", {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n" + (b"0 1\n0000000000 65535 f \n" if prev is None else b"")
    for n in sorted([*at, *free]):
        out += b"%d 1\n%010d %05d %s \n" % (n, at.get(n, 0), 0 if n in at else 1, b"n" if n in at else b"f")
    out += b"trailer\n<< /Size 40 /Root 1 0 R %s %s >>\nstartxref\n%d\n%%%%EOF\n" % (extra, b"/Prev %d" % prev if prev is not None else b"", start)
    return out


TO_UNICODE = b"""/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0001> <0048> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0013> <0061> <0020> <0021> [<0078> <0079>] endbfrange endcmap"""
PAGE = b"""/P /MC0 BDC BT /F1 10 Tf 1 0 0 1 40 700 Tm (a\\200\\311b) Tj ET EMC
BT /F2 10 Tf 1 0 0 1 40 650 Tm <0001000200100020> Tj ET
q 200 0 0 100 10 20 cm /Im1 Do Q q 2 0 0 2 0 0 cm /Fm1 Do Q
q 30 0 0 40 0 0 cm BI /W 2 /H 3 /CS /G /BPC 8 ID \x00(\x01)\x02\x03 EI Q
BT /F1 10 Tf 1 0 0 1 40 600 Tm (end) Tj ET"""
OBJECTS = {
    1: b"<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [20 0 R 24 0 R] >> /Outlines 25 0 R /StructTreeRoot 30 0 R >>",
    2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
    3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Annots [10 0 R 22 0 R] /Resources << /Properties << /MC0 << /MCID 7 >> >> /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /Im1 8 0 R /Fm1 9 0 R >> >> >>",
    4: stream(PAGE),
    5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 97 /Widths [500 500] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [201 /eacute] >> >>",
    6: b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /ToUnicode 7 0 R /DescendantFonts [<< /Subtype /CIDFontType2 /DW 700 /W [1 [600 800] 16 32 400] >>] >>",
    7: stream(TO_UNICODE),
    8: b"<< /Type /XObject /Subtype /Image /Width 400 /Height 100 /Length 0 >>\nstream\n\nendstream",
    9: stream(b"BT /F1 10 Tf 1 0 0 1 5 5 Tm (in) Tj ET 50 0 0 50 0 0 cm /Im1 Do /Fm1 Do", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 0]"),
    10: b"<< /Type /Annot /Subtype /Link /Rect [100 20 10 40] /F 4 /Contents (\xfe\xff\x00h\x00i) >>",
    11: b"<< /Title (A title) /CreationDate (D:20240102) >>",
    20: b"<< /T (form) /FT /Tx /Kids [21 0 R] >>",
    21: b"<< /T (name) /V (Ann) /Parent 20 0 R /Kids [22 0 R] >>",
    22: b"<< /Type /Annot /Subtype /Widget /Parent 21 0 R /Rect [0 0 1 1] >>",
    24: b"<< /T (ok) /FT /Btn /Ff 65536 /V /Off >>",
    25: b"<< /First 26 0 R >>",
    26: b"<< /Title (One) /Next 27 0 R /First 28 0 R >>",
    27: b"<< /Title (Two) /Next 26 0 R >>",
    28: b"<< /Title (Below) >>",
    30: b"<< /K [31 0 R] >>",
    31: b"<< /S /Document /Pg 3 0 R /K [<< /S /P /K 7 >> << /S /Span /K [2 << /Type /MCR /MCID 1 >>] >> 31 0 R] >>",
    32: b"<< /Type /Sig /SubFilter /adbe.pkcs7.detached /ByteRange [0 10 20 5] /Contents <00> >>",
}
FIRST = build(OBJECTS, b"/Info 11 0 R")
SECOND = build({11: b"<< /Title (Newer) >>", 33: b"(new)"}, b"/Info 11 0 R", FIRST, FIRST.rindex(b"xref\n0 1"), free=(28,))


@pytest.fixture(scope="module")
def files(spark):
    broken = [("broken", b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents 2 0 R"), ("none", b""), ("loop", b"1 0 obj 1 0 R endobj startxref 0 trailer << /Prev 0 /Root 1 0 R >>")]
    rows = [("a", bytearray(FIRST)), ("b", bytearray(SECOND)), *[(n, bytearray(d)) for n, d in broken]]
    return spark.createDataFrame(rows, "path string, content binary")


def of(df, path="a", *columns):
    return [tuple(r) for r in df.where(F.col("path") == path).select(*columns).collect()]


def test_letters_of_all_kinds_of_fonts_and_forms(files):
    letters = {r.path: r.letters for r in pdf.letters(files).collect()}
    shown = letters["a"]
    assert "".join(x.value for x in shown) == "a€éb" + "Hfiax" + "in" + "end"
    assert [x.mcid for x in shown[:5]] == [7, 7, 7, 7, None]
    assert [round(x.adv, 3) for x in shown[4:8]] == [6.0, 8.0, 4.0, 4.0]
    assert (shown[8].x, shown[8].y, shown[8].size) == (210.0, 10.0, 20.0)
    rows = words.word_rows(words.page_words(pdf.letters(files).withColumnRenamed("path", "doc_id"))).where("doc_id = 'a'").orderBy("word").collect()
    assert [r.text for r in rows] == ["a€éb", "Hfiax", "in", "end"]


def test_placements_through_forms_and_inline(files):
    got = of(pdf.placements(files), "a", "seq", "obj", "a", "d", "e", "width", "height")
    assert got == [(0, 8, 200.0, 100.0, 10.0, 400, 100), (1, 8, 100.0, 100.0, 200.0, 400, 100), (2, None, 30.0, 40.0, 0.0, 2, 3)]


def test_revisions(files):
    rows = parts.entries(files)
    newest = revisions.last_wins(rows.withColumn("age", -F.col("revision")), ["path", "obj"], ["age", "offset"])
    got = {(r.path, r.obj): r for r in newest.collect()}
    assert got["b", 28].kind == "Free" and got["a", 28].kind == "InUse" and got["b", 11].revision == 0 and got["b", 4].revision == 1
    assert got["b", 11].offset >= len(FIRST) > got["b", 4].offset and {p for p, _ in got} == {"a", "b"}
    info = {r.path: r for r in parts.information(files).select("*", strings.document_date(F.col("creationdate")).alias("made")).collect()}
    assert info["a"].title == "A title" and info["b"].title == "Newer" and str(info["a"].made) == "2024-01-02 00:00:00" and info["none"].title is None


def test_trees(files):
    assert of(parts.outline(files), "a", "node", "parent", "pos", "title") == [(0, None, 0, "One"), (1, 0, 0, "Below"), (2, None, 1, "Two")]
    flat = forms.full_names(parts.fields(files).where("path = 'a'").select("node", "parent", "name", "ft", "ff"))
    assert sorted((r.full_name, r.ft) for r in flat.collect()) == [("form", "Tx"), ("form.name", "Tx"), ("ok", "Btn")]
    assert of(parts.fields(files), "a", "value") == [(None,), ("Ann",), ("Off",)]
    tree = parts.structure(files)
    assert of(tree, "a", "role", "page", "mcid") == [("Document", 0, None), ("P", 0, None), (None, 0, 7), ("Span", 0, None), (None, 0, 2), (None, 0, 1)]
    order = tree.where("path = 'a' AND mcid IS NOT NULL").selectExpr("path AS doc_id", "page", "mcid", "node AS pos")
    ranked = structure.ranks(order.select("doc_id", "page", "mcid"), order, ["doc_id", "page"]).collect()
    assert {r.mcid: r.rank_ for r in ranked} == {7: 0, 2: 1, 1: 2}


def test_annotations_references_signatures(files, spark):
    got = of(parts.annotations(files), "a", "subtype", "l", "b", "r", "t", "flags", "contents")
    assert got == [("Link", 10.0, 20.0, 100.0, 40.0, 4, "hi"), ("Widget", 0.0, 0.0, 1.0, 1.0, 0, None)]
    edges = parts.references(files).where("path = 'a'")
    reached = {r.node for r in graph.reachable(spark.createDataFrame([(0,)], "node long"), edges).collect()}
    assert {1, 4, 9, 11, 22, 31} <= reached and 32 not in reached
    verdicts = parts.signatures(files).where("path = 'a'").select("kind", coverage.verdict(F.col("ranges"), F.col("length"))).collect()
    assert [tuple(r) for r in verdicts] == [("Sig", "Partial")]


def test_what_is_left_out_is_told(spark):
    from quire.sources import writer

    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Page /Contents [4 0 R 5 0 R] /Resources << /XObject << /Fm 6 0 R >> >> >>"}
    objects |= {4: b"<< /Length 3 /Filter /Unknown >>\nstream\nabc\nendstream", 5: writer.stream(b"(x) Tf 1 Td /Fm Do"), 6: writer.stream(b"/Fm Do", b"/Type /XObject /Subtype /Form")}
    for k in range(300):  # a page tree deeper than is walked
        objects[100 + k] = b"<< /Type /Pages /Kids [%d 0 R] >>" % (101 + k)
    objects |= {2: b"<< /Type /Pages /Kids [3 0 R 100 0 R] >>", 400: b"<< /Type /Page >>"}
    frame = spark.createDataFrame([("a", writer.whole(objects, b"/Root 1 0 R"))], "path string, content binary")
    got = [(r.page, r.code) for r in pdf.diagnostics(frame).collect()]
    assert (None, "depth") in got and (0, "stream") in got and (0, "operator") in got
    assert [r.page for r in pdf.letters(frame).collect()] == [0]


def test_a_tree_of_two_hundred_levels_is_walked(spark):
    from quire.sources import writer

    objects = {1: b"<< /Type /Catalog /Pages 100 0 R >>", 300: b"<< /Type /Page >>"}
    objects |= {100 + k: b"<< /Type /Pages /Kids [%d 0 R] >>" % (101 + k) for k in range(200)}
    frame = spark.createDataFrame([("a", writer.appended(writer.whole(objects, b"/Root 1 0 R"), {50: b"<< /A 1 >>"}, b"/Root 1 0 R"))], "path string, content binary")
    assert pdf.letters(frame).count() == 1 and pdf.diagnostics(frame).collect() == []
    assert {r.obj for r in parts.entries(frame).where("revision = 0").collect()} == {50}


def test_cross_reference_streams_and_packed_objects(spark):
    packed = b"2 0 3 14 << /A [1 2] >> (three)"
    body = b"%PDF-1.5\n"
    at = {}
    for n, x in {1: b"<< /Type /Catalog >>", 5: stream(packed, b"/Type /ObjStm /N 2 /First 9")}.items():
        at[n] = len(body)
        body += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    rows = [(0, 0, 255), (1, at[1], 0), (2, 5, 0), (2, 5, 1)]
    table = b"".join(a.to_bytes(1) + b.to_bytes(4) + c.to_bytes(2) for a, b, c in rows)
    start = len(body)
    body += b"6 0 obj\n" + stream(table, b"/Type /XRef /W [1 4 2] /Index [0 4] /Size 7 /Root 1 0 R") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    files = spark.createDataFrame([("x", bytearray(body))], "path string, content binary")
    assert of(parts.entries(files), "x", "obj", "kind", "offset") == [(0, "Free", 0), (1, "InUse", at[1]), (2, "Packed", 5), (3, "Packed", 5)]
    assert {r.obj for r in pdf.objects(files).where("packed").collect()} == {2, 3}


def test_glyph_names_and_base_encodings():
    names = {"A": "A", "eacute": "é", "fi": "fi", "uni00410042": "AB", "u1F600": "😀", "a.alt": "a", "Zcaron": "Ž", "g12": None, "threequarters": "¾", "ffl": "ffl", "nbspace": "\u00a0", "softhyphen": "\u00ad", "ogonek": "˛", "logicalnot": "¬"}
    assert {n: fonts.glyph_text(n) for n in names} == names
    assert [fonts.base_text(e, c) for e, c in ((None, 0x27), (None, 0xAE), (None, 0xB5), ("WinAnsiEncoding", 0x80), ("MacRomanEncoding", 0x8E))] == ["’", "fi", None, "€", "é"]
