"""The file readers over documents that are written as files: a page for 60 lines of 66 letters, with a link, a field and an image each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly
from ..operators.revisions import last_wins
from ..plans import images
from ..scratch import kept
from ..sources import parts, pdf, writer
from ..sources.tables import COLUMNS, ROWS, spread, table
from . import query

_PLAIN = r"[^\x20-\x7E]"


def _file(text: str, source: str, lang: str) -> bytes:
    """Objects 1 to 5: catalog, page tree, font, information, image; of page p 10 + 4 p: page, content, link, field. A second revision has the title."""
    lines = [text[i : i + COLUMNS] for i in range(0, len(text), COLUMNS)]
    pages = [lines[i : i + ROWS] for i in range(0, len(lines), ROWS)]
    refs = lambda k: b" ".join(b"%d 0 R" % (10 + 4 * p + k) for p in range(len(pages)))
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [%s] >> >>" % refs(3),
        2: b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] >>" % (refs(0), len(pages)),
        3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /FirstChar 32 /LastChar 126 /Widths [%s] >>" % (b"600 " * 95),
        4: b"<< /Title (old) /Author (old) >>",
        5: writer.stream(b"\0" * 12, b"/Type /XObject /Subtype /Image /Width 400 /Height 100"),
    }
    for p, rows in enumerate(pages):
        shown = b"".join(b"1 0 0 1 40 %d Tm %s Tj\n" % (752 - 12 * i, writer.literal(x)) for i, x in enumerate(rows))
        n = 10 + 4 * p
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Annots [%d 0 R %d 0 R] /Resources << /Font << /F1 3 0 R >> /XObject << /Im1 5 0 R >> >> >>" % (n + 1, n + 2, n + 3)
        objects[n + 1] = writer.stream(b"BT /F1 10 Tf\n%sET\nq %d 0 0 %d 10 20 cm /Im1 Do Q" % (shown, 100 + p, 50 + p))
        objects[n + 2] = b"<< /Type /Annot /Subtype /Link /Rect [%d 40 %d 20] /F %d >>" % (110 + p, 10 + p, p % 8)
        objects[n + 3] = b"<< /Type /Annot /Subtype /Widget /FT /Tx /T %s /V %s /Rect [0 0 1 1] >>" % (writer.literal(f"field{p}"), writer.literal(rows[0][:20]))
    old = writer.whole(objects, b"/Root 1 0 R /Info 4 0 R")
    return writer.appended(old, {4: b"<< /Title %s /Author %s >>" % (writer.literal(source), writer.literal(lang))}, b"/Root 1 0 R /Info 4 0 R")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file for each document, named by its id."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for b in assembly.pieces(batch, "text"):
                made = [_file(*x) for x in zip(*(b.column(c).to_pylist() for c in ("text", "source", "lang")))]
                yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(made, pa.binary())], names=["path", "content"])

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    blank = F.lit("")
    plain = docs.select(F.col("doc_id").cast("string").alias("path"), F.regexp_replace(F.coalesce("text", blank), _PLAIN, "?").alias("text"), F.coalesce("source", blank).alias("source"), F.coalesce("lang", blank).alias("lang"))
    return plain.mapInArrow(run, "path string, content binary")


_PAGES_SQL = f"""t AS (SELECT doc_id, source, lang, regexp_replace(coalesce(text, ''), '[^\\x20-\\x7E]', '?', 'g') AS text FROM documents),
c AS (SELECT *, CAST(ceil(length(text) / {COLUMNS * ROWS}.0) AS BIGINT) AS n FROM t), pg AS (SELECT *, CAST(unnest(range(0, n)) AS INTEGER) AS page FROM c)"""


def _id():
    return F.col("path").cast("long").alias("doc_id")


@query(f"""WITH {_PAGES_SQL}, r AS (SELECT doc_id, page, row_, regexp_extract_all(substr(text, page * {COLUMNS * ROWS} + row_ * {COLUMNS} + 1, {COLUMNS}), '[^ ]+') AS w FROM pg, (SELECT unnest(range(0, {ROWS})) AS row_))
SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY row_, k) - 1 AS INTEGER) AS word, x AS text FROM (SELECT doc_id, page, row_, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM r)""")
def file_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content streams to letters to words."""
    return assembly.word_rows(pdf.shown(_files(spark, sf_dir)), boxes=False).select(F.col("doc_id").cast("long").alias("doc_id"), "page", "word", "text")


@query(f"WITH {_PAGES_SQL} SELECT doc_id, 4 + 3 * n AS dictionaries, 1 + n AS streams, n AS pages FROM c")
def file_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf.objects(_files(spark, sf_dir))
    return found.groupBy(_id()).agg(F.count_if(F.col("kind") == "dictionary").alias("dictionaries"), F.count_if(F.col("kind") == "stream").alias("streams"), F.count_if(F.col("type") == "Page").alias("pages"))


@query("SELECT doc_id, coalesce(source, '') AS title, coalesce(lang, '') AS author FROM documents")
def file_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest revision's."""
    return parts.information(_files(spark, sf_dir)).select(_id(), "title", "author")


@query(f"""WITH {_PAGES_SQL} SELECT doc_id, page, 0 AS seq, 'Link' AS subtype, CAST(10 + page AS DOUBLE) AS l, CAST(20 AS DOUBLE) AS b, CAST(110 + page AS DOUBLE) AS r, CAST(40 AS DOUBLE) AS t, page % 8 AS flags FROM pg
UNION ALL SELECT doc_id, page, 1, 'Widget', 0, 0, 1, 1, 0 FROM pg""")
def file_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.annotations(_files(spark, sf_dir)).select(_id(), "page", "seq", "subtype", "l", "b", "r", "t", "flags")


@query(f"WITH {_PAGES_SQL} SELECT doc_id, 'field' || page AS name, 'Tx' AS ft, substr(text, page * {COLUMNS * ROWS} + 1, 20) AS value FROM pg")
def file_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.fields(_files(spark, sf_dir)).select(_id(), "name", "ft", "value")


@query(f"WITH {_PAGES_SQL} SELECT doc_id, page, CAST(400 * 72 / CAST(100 + page AS DOUBLE) AS DOUBLE) AS dpi_x, CAST(100 * 72 / CAST(50 + page AS DOUBLE) AS DOUBLE) AS dpi_y FROM pg")
def file_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective DPI of every drawing."""
    found = pdf.placements(_files(spark, sf_dir))
    unit = F.lit(1.0)
    return found.select(_id(), "page", images.dpi(F.col("width"), F.col("a"), F.col("b"), unit).alias("dpi_x"), images.dpi(F.col("height"), F.col("c"), F.col("d"), unit).alias("dpi_y"))


@query(f"WITH {_PAGES_SQL} SELECT doc_id, 3 + 8 * n AS edges, 3 + n AS from_roots FROM c")
def file_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, and those from the trailer and the catalog."""
    found = parts.references(_files(spark, sf_dir))
    return found.groupBy(_id()).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") <= 1).alias("from_roots"))


@query(f"WITH {_PAGES_SQL} SELECT doc_id, 5 + 4 * n AS live, 1 AS anew, 7 + 4 * n AS entries FROM c")
def file_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-reference entries of both revisions, and the objects that they give: the newest entry of a number counts."""
    found = kept(parts.entries(_files(spark, sf_dir)))  # files are made and read once
    newest = last_wins(found.withColumn("age", -F.col("revision")), ["path", "obj"], ["age"])
    live = newest.groupBy("path").agg(F.count_if(F.col("kind") != "Free").alias("live"), F.count_if((F.col("kind") != "Free") & (F.col("revision") == 0)).cast("int").alias("anew"))
    return live.join(found.groupBy("path").agg(F.count(F.lit(1)).alias("entries")), "path").select(_id(), "live", "anew", "entries")


def _judged(n: int) -> bytes:
    """A small file whose faults follow from n."""
    part, letter, version = "123"[n % 3], "BA"[n % 5 == 4], (4, 7, 3)[n % 7 % 3]
    attributes = f'pdfaid:part="{part}" pdfaid:conformance="{letter}"' + (' pdfaid:corr="x"' if n % 11 == 0 else "")
    elements = f"<pdfaid:part>{part}</pdfaid:part><pdfaid:conformance>{letter}</pdfaid:conformance>"
    space = "http://www.aiim.org/pdfa/ns/id/" if n % 13 else "http://example.org/"
    said = f'<rdf:Description rdf:about="" xmlns:pdfaid="{space}" {attributes}/>' if n % 2 else f'<rdf:Description rdf:about="" xmlns:pdfaid="{space}">{elements}</rdf:Description>'
    packet = f'<?xpacket begin=""?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">{said}</rdf:RDF></x:xmpmeta><?xpacket end="w"?>'
    profile = bytes(12) + (b"mntr" if n % 17 else b"scnr") + (b"RGB " if n % 19 else b"Lab ") + bytes(108 if n % 23 else 10)
    intent = b"<< /Type /OutputIntent /S /GTS_PDFA1 %s /DestOutputProfile 4 0 R >>" % (b"/OutputConditionIdentifier (sRGB)" if n % 29 else b"")
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Metadata 3 0 R /OutputIntents [%s] /AcroForm << /Fields [] /NeedAppearances %s >> %s >>" % (intent, b"true" if n % 31 == 0 else b"false", b"/Held [[5 0 R]]" if n % 4 else b""),
        2: b"<< /Type /Pages /Kids [] /Count 0 >>",
        3: writer.stream(packet.encode()),
        4: writer.stream(profile),
        5: b"<< /Length 3 /Filter [/ASCIIHexDecode /%s] >>\nstream\n00>\nendstream" % (b"LZWDecode" if n % 3 == 0 else b"FlateDecode"),
    }
    data = writer.whole(objects, b"/Root 1 0 R" + (b" /Encrypt << /Filter /Standard >>" if n % 37 == 0 else b""))
    return data.replace(writer.HEAD, b"%%PDF-1.%d\n" % version, 1)


@query("""WITH d AS (SELECT doc_id AS n, doc_id % 3 + 1 AS part, CASE doc_id % 7 % 3 WHEN 0 THEN 1.4 WHEN 1 THEN 1.7 ELSE 1.3 END AS version, doc_id % 13 = 0 AS strange FROM documents),
f AS (SELECT *, NOT strange AND part <= 2 AS known FROM d)
SELECT n AS doc_id, 'identification' AS rule, CASE WHEN known AND n % 5 <> 4 AND NOT (n % 2 = 1 AND n % 11 = 0) THEN 'Pass' ELSE 'Fail' END AS status FROM f
UNION ALL SELECT n, 'encryption', CASE WHEN n % 37 = 0 THEN 'Fail' ELSE 'Pass' END FROM f
UNION ALL SELECT n, 'version', CASE WHEN NOT known THEN 'NotChecked' WHEN version <= CASE part WHEN 1 THEN 1.4 ELSE 1.7 END THEN 'Pass' ELSE 'Fail' END FROM f
UNION ALL SELECT n, 'appearances', CASE WHEN n % 31 = 0 THEN 'Fail' ELSE 'Pass' END FROM f
UNION ALL SELECT n, 'output_intent', CASE WHEN n % 29 = 0 OR n % 23 = 0 OR n % 17 = 0 OR n % 19 = 0 THEN 'Fail' ELSE 'Pass' END FROM f
UNION ALL SELECT n, 'filters', CASE WHEN NOT known OR part <> 1 THEN 'NotChecked' WHEN n % 4 <> 0 THEN 'Fail' ELSE 'Pass' END FROM f""")
def file_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over files with faults: declared parts, output intents and their profiles, filters that the catalog reaches."""
    from ..operators import rules

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids = batch.column("doc_id").slice(at, 500).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(map(str, ids), pa.string()), pa.array([_judged(n) for n in ids], pa.binary())], names=["path", "content"])

    files = spread(table(spark, sf_dir, "documents").select("doc_id")).mapInArrow(run, "path string, content binary")
    return rules.document_rules(parts.conformance(files), "path").select(_id(), "rule", "status")
