"""Operator 1: WARC archives; a normaliser from one gzip stream a file to one gzip member a record."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .storage import open_file, write_file

#: Uncompressed bytes after which a new archive begins.
ARCHIVE_BYTES = 16 << 20
CHUNK = 1 << 18
LEVEL = 1
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"
MANIFEST = "archive string, sidecar string, records long, bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- one record -------------------------------------------------------------------------------


def record(page_id, url, payload: bytes, n_bytes: int, sha1: str, kind: str, refers_to) -> bytes:
    """One record with its blank lines. A revisit's block holds the HTTP head alone, which keeps the full length."""
    block = (HEAD % n_bytes).encode() + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:quire:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:quire:page:{refers_to}>"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


# --- streams ----------------------------------------------------------------------------------


def inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Plain bytes of a gzip stream of one or many members, a chunk at a time. Raises on a truncated stream."""
    z = None
    for x in chunks:
        while x:
            z = z or zlib.decompressobj(31)
            if out := z.decompress(x, 4 * CHUNK):
                yield out
            x = z.unconsumed_tail or z.unused_data
            if z.eof:
                z = None
    if z is not None:
        raise EOFError("the gzip stream ends early")


def raw_records(plain: Iterable[bytes]) -> Iterator[bytes]:
    """Each record's bytes, with its blank lines, holding one record in memory at a time."""
    buffer = bytearray()
    need = None
    for x in plain:
        buffer += x
        at = 0
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                length = re.search(rb"\r\ncontent-length:\s*(\d+)", buffer[at : end + 2], re.I)
                if not length:
                    raise ValueError("a WARC record without Content-Length")
                need = end - at + 4 + int(length[1]) + 4
            if len(buffer) - at < need:
                break
            yield bytes(buffer[at : at + need])
            at, need = at + need, None
        del buffer[:at]
    if buffer.strip():
        raise EOFError("the last WARC record is cut")


def member(raw: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def normalise(chunks: Iterable[bytes], index: list[dict], level: int = LEVEL) -> Iterator[bytes]:
    """A gzip member for each record of a gzip stream that is inflated once; appends each one's place to index."""
    at = 0
    for raw in raw_records(inflated(chunks)):
        out = member(raw, level)
        fields, _ = parse(raw)
        index.append(
            {"offset": at, "length": len(out), "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri")}
        )
        at += len(out)
        yield out


def _chunks(uri: str) -> Iterator[bytes]:
    with open_file(uri) as f:
        while x := f.read(CHUNK):
            yield x


# --- over tables ------------------------------------------------------------------------------


def classify(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) for each row of pages.

    Among rows whose payloads of at least min_bytes are equal, those with the largest page_id are
    responses (all of them, if that id repeats), the others revisits. A null id counts as smallest;
    if all are null, all are responses. Only digests with several rows are joined back, and the
    smaller side of that join is a written table, so a digest that a third of all rows share is
    split by adaptive execution, or broadcast where the table is small.
    """
    rows = pages.select("page_id", "url", "html").withColumns(
        {
            "payload_bytes": F.coalesce(F.octet_length("html"), F.lit(0)).cast("long"),
            "payload_digest": base32(F.sha1(F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")))),
        }
    )
    groups = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first_id IS NOT NULL")
        .select("payload_digest", "first_id")
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(scratch.keep(groups), "payload_digest", "left").select(
        "page_id",
        "url",
        "html",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def base32(hexes):
    """Bare base32 of a SHA-1 in hex: four times ten hex digits give eight base-32 digits."""
    eight = [F.lpad(F.conv(F.substring(hexes, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*eight), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write classified rows as archives of one gzip stream each; a row for every archive.

    File names hold the task attempt, so that an attempt that is repeated after a lost executor
    leaves other files than those listed.
    """

    def write(batches):
        task = TaskContext.get()
        stem = f"{folder}/mono/a-{task.partitionId():05d}-{task.taskAttemptId()}"
        left = (r for b in batches for r in b.itertuples(index=False))
        row, k = next(left, None), 0
        while row is not None:
            count = [0]

            def parts(count=count):
                nonlocal row
                z, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
                while row is not None and size < archive_bytes:
                    raw = record(_int(row.page_id), row.url, (row.html or "").encode(), row.payload_bytes, row.payload_digest, row.record_type, _int(row.refers_to))
                    size += len(raw)
                    count[0] += 1
                    if out := z.compress(raw):
                        yield out
                    row = next(left, None)
                yield z.flush()

            uri = f"{stem}-{k:04d}.warc.gz"
            size = write_file(uri, parts())
            yield _frame([(uri, None, count[0], size)])
            k += 1

    ids = {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}  # pandas has no long with nulls
    return rows.withColumns(ids).mapInPandas(write, MANIFEST)


def _int(x):
    return None if x is None else int(x)


def _frame(rows):
    import pandas as pd

    return pd.DataFrame(rows, columns=["archive", "sidecar", "records", "bytes"])


def normalise_archives(manifest: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite every archive of manifest with a member a record and a sidecar of JSON lines; a row for every archive."""

    def rewrite(batches):
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for uri in batch.archive:
                out = f"{folder}/norm/{uri.rsplit('/', 1)[-1].removesuffix('.warc.gz')}-{attempt}.warc.gz"
                index: list[dict] = []
                size = write_file(out, normalise(_chunks(uri), index, level))
                side = f"{out}.idx"
                write_file(side, (json.dumps(x).encode() + b"\n" for x in index))
                yield _frame([(out, side, len(index), size)])

    return manifest.mapInPandas(rewrite, MANIFEST)


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block_ok boolean, archive string, offset long, length long"


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record of normalised archives, each read alone by its place in the sidecar.

    block_ok: a response's payload has the length and the digest that its heads state.
    """

    def read(batches):
        import pandas as pd

        for batch in batches:
            for uri, side in zip(batch.archive, batch.sidecar):
                rows = []
                with open_file(uri) as f, open_file(side) as s:
                    for x in map(json.loads, s.read().splitlines()):
                        f.seek(x["offset"])
                        fields, block = parse(zlib.decompress(f.read(x["length"]), 31))
                        head, _, payload = block.partition(b"\r\n\r\n")
                        n = int(re.search(rb"content-length:\s*(\d+)", head, re.I)[1])
                        sha1 = fields["warc-payload-digest"].removeprefix("sha1:")
                        kind = fields["warc-type"]
                        ok = kind == "revisit" or (len(payload) == n and digest(payload) == sha1)
                        rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), n, sha1, kind, _page(fields.get("warc-refers-to")), ok, uri, x["offset"], x["length"]))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return manifest.mapInPandas(read, RECORDS)


def _page(urn: str | None) -> int | None:
    x = (urn or "").removeprefix("<urn:quire:page:").removesuffix(">")
    return int(x) if x else None


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as archives of one stream, normalise them, and read the records back by index.

    Null or empty html: an empty payload. Null url: no target field. Null page_id: a record without
    a number, read back as null. Repeated rows: a record each. No rows: no archive and no row.
    Other columns of pages are not read. The three steps are one written table each, so a lost
    executor repeats single archives only.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    files = f"{scratch.uri}/files"
    mono = scratch.keep(write_archives(classify(pages, scratch, min_bytes), files, archive_bytes))
    norm = scratch.keep(normalise_archives(mono, files))
    scratch.drop_uri(f"{files}/mono")  # only now: a repeated task may still need its archive before
    return read_archives(norm)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc_round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "block_ok")


OP1_SQL = """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), e AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS first_id FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  translate(
    lpad(to_base(CAST('0x' || substr(h, 1, 10) AS BIGINT), 32), 8, '0') || lpad(to_base(CAST('0x' || substr(h, 11, 10) AS BIGINT), 32), 8, '0') ||
    lpad(to_base(CAST('0x' || substr(h, 21, 10) AS BIGINT), 32), 8, '0') || lpad(to_base(CAST('0x' || substr(h, 31, 10) AS BIGINT), 32), 8, '0'),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
  TRUE AS block_ok
FROM e
"""
