"""WARC archives: one gzip member per record, and a sequential reader with bounded memory.

Writing: pages are reduced to one payload per digest (the largest page_id is the response, equal
payloads are revisits of it), and every task streams its rows into archives of about
``ARCHIVE_BYTES`` in the shared folder. An archive appears under its name only when complete.

Reading: an archive is read front to back in pieces of ``PIECE`` bytes. Each gzip member is inflated
incrementally into one record; its header block is parsed once complete, Content-Length frames the
block, and block and payload digests are verified. Memory is one record and one piece.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folder, shuffle_partitions, table, written
from .files import put, stream

ARCHIVE_BYTES = 32 << 20
PIECE = 1 << 18
#: Capture time of every record; archives of the same rows are the same bytes.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class WarcError(ValueError):
    """A record that its framing or a digest contradicts."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _uri(url: str | None, page_id: int | None) -> str:
    """A header-safe target URI; pages without a URL get one of their own."""
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has the HTTP header only, and names its response."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url, page_id)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, f'page:{refers_to}')}>", f"X-Refers-To-Page-Id: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(lines).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class _Record:
    """A record that grows by inflated pieces."""

    def __init__(self) -> None:
        self.raw, self.headers, self.need = bytearray(), None, None

    def feed(self, piece: bytes) -> None:
        self.raw += piece
        if self.headers is None:
            end = self.raw.find(b"\r\n\r\n")
            if end < 0:
                return
            first, *rest = bytes(self.raw[:end]).decode("utf-8").split("\r\n")
            if not first.startswith("WARC/"):
                raise WarcError(f"no WARC version line: {first[:20]!r}")
            self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
            if not self.headers.get("content-length", "").isdigit():
                raise WarcError("no Content-Length")
            self.body, self.need = end + 4, int(self.headers["content-length"])
        if len(self.raw) > self.body + self.need + 4:
            raise WarcError("the member is longer than Content-Length")

    def done(self) -> tuple[dict[str, str], bytes, bytes]:
        """Headers, block and payload (what follows the block's HTTP header), verified."""
        if self.headers is None or len(self.raw) != self.body + self.need + 4 or self.raw[-4:] != b"\r\n\r\n":
            raise WarcError("the record ends before its Content-Length")
        block = bytes(self.raw[self.body : self.body + self.need])
        if (told := self.headers.get("warc-block-digest")) and told != f"sha1:{base32_sha1(block)}":
            raise WarcError("block digest")
        payload = block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else block
        if self.headers.get("warc-type") == "response" and (told := self.headers.get("warc-payload-digest")) and told != f"sha1:{base32_sha1(payload)}":
            raise WarcError("payload digest")
        return self.headers, block, payload


def read_records(source) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Records of an open archive, in order. Raises WarcError on damage, truncation included."""
    unzip, rec, fresh = zlib.decompressobj(31), _Record(), True
    while piece := source.read(PIECE):
        while piece:
            fresh = False
            try:
                got = unzip.decompress(piece, PIECE)
            except zlib.error as e:
                raise WarcError(f"gzip: {e}") from None
            while got:
                rec.feed(got)
                # input may be used up while output waits
                got = unzip.decompress(b"", PIECE) if not unzip.eof and not unzip.unconsumed_tail else b""
            if unzip.eof:
                yield rec.done()
                piece, unzip, rec, fresh = unzip.unused_data, zlib.decompressobj(31), _Record(), True
            else:
                piece = unzip.unconsumed_tail
    if not fresh:
        # what the inflater still holds of the last piece
        raise WarcError("the archive ends inside a member")


def write_archives(pages: DataFrame, target: str, minimum: int = 0) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) to archives below ``target``.

    Of equal payloads of at least ``minimum`` bytes, the one with the largest page_id is the response.
    Null html is an empty payload. Repeated rows that all hold the largest id are all responses; rows
    with a null id are responses only where no row of their payload has an id, and revisits else.
    Returns a written table of archives (name, records).
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    firsts = rows.groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"), F.max(F.octet_length("html")).alias("bytes"))
    # only payloads that occur again enter the join; Spark splits a hot one (outer side)
    again = firsts.filter((F.col("n") > 1) & F.col("keeper").isNotNull() & (F.col("bytes") >= minimum)).select("sha1", "keeper")
    marked = rows.join(again, "sha1", "left").select("page_id", "url", "html", "keeper")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, parts, held = [], [], [], 0

        def close() -> None:
            nonlocal parts, held
            name = f"pages-{uuid.uuid4().hex}.warc.gz"
            put(target, name, parts)
            names.append(name)
            counts.append(len(parts))
            parts, held = [], 0

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                page_id, url, page, keeper = (c[i].as_py() for c in columns)
                revisit = keeper is not None and page_id != keeper
                parts.append(record(page_id, url, page.encode("utf-8"), keeper if revisit else None, revisit))
                held += len(parts[-1])
                if held >= ARCHIVE_BYTES:
                    close()
        if parts:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["name", "records"])

    listing = marked.mapInArrow(archive, "name string, records bigint")
    # the written list is what counts: archives of tasks that were lost after writing are in no list
    return written(listing, "warc-list")


def read_archives(archives: DataFrame, target: str) -> DataFrame:
    """Records of the archives listed by ``archives`` (name): page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload (null for revisits)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        number = lambda v: None if v is None else int(v)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with stream(target, name) as source:
                    for headers, _, payload in read_records(source):
                        kind = headers["warc-type"]
                        size = len(payload) if kind == "response" else int(headers["x-payload-length"])
                        rows.append((number(headers.get("x-page-id")), headers.get("warc-target-uri"), size, headers["warc-payload-digest"].removeprefix("sha1:"), kind, number(headers.get("x-refers-to-page-id")), payload if kind == "response" else None))
                        held += len(payload)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spread = archives.select("name").repartition(max(shuffle_partitions(archives.sparkSession), 1), "name")
    return spread.mapInArrow(scan, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` written to WARC archives and read back from them."""
    target = folder(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), target)
    out = read_archives(archives, target)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, max(page_id) AS keeper, count(*) AS n FROM p GROUP BY h),
q AS (SELECT p.*, keeper, n > 1 AND keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper AS revisit FROM p JOIN k USING (h)),
c AS (
  SELECT rid, g, s, ((('0x' || substr(h, g * 5 + 1, 5))::INT >> (15 - 5 * s)) & 31) AS v
  FROM q, range(8) a(g), range(4) b(s)),
e AS (SELECT rid, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1), '' ORDER BY g, s) AS digest FROM c GROUP BY rid)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN revisit THEN keeper END AS refers_to
FROM q JOIN e USING (rid)
"""
