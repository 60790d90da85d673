"""WARC archives: one gzip member per record, read sequentially with incremental decompression."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import MAX_TASKS, bounded_broadcast, cut, shared_path, spread

#: Payloads of fewer bytes are always written in full.
MIN_REVISIT_BYTES = 100
#: Bytes of an archive after which a task starts the next.
ARCHIVE_BYTES = 256 << 20
#: Bytes read, and bytes inflated, at once.
CHUNK = 1 << 18
#: Bytes of a record's head, or of the HTTP head in it, that the reader takes at most, if it isn't told of longer ones.
HEAD_BYTES = 1 << 20
#: The date of a record whose page has none.
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, n_records long, n_bytes long, head_bytes long"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with digest (SHA-256 of the UTF-8 payload) and refers_to, null for responses.

    Of equal payloads of at least min_bytes, rows with the smallest page_id are responses and the others revisit it.
    Only digests are grouped. The few that repeat are broadcast up to a bound, and joined beyond it.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n_bytes"))
    repeated = rows.filter(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.count("*").alias("copies"), F.min("page_id").alias("first")).filter("copies > 1")
    repeated = cut(repeated.select(F.col("digest").alias("_digest"), "first"), "warc-digests")
    right = bounded_broadcast(repeated)
    joined = rows.join(repeated if right is None else right, F.col("digest") == F.col("_digest"), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def _sha256(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP head, whose length is the full payload's, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + _END
    block = head if refers_to is not None else head + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: {_sha256(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(lines).encode() + _END + block + _END


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of mark_revisits(), a gzip member each, and returns the manifest of the archives.

    Archives get new names, and only those of tasks that succeeded are in the manifest, which is written out at once:
    what lost or repeated tasks leave behind is never read. head_bytes: the longest head in the archive, which a url can
    make of any length. No pages: no archives.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        out, path, records, size, longest = None, "", 0, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [records], "n_bytes": [size], "head_bytes": [longest]})

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                page_id, url, html, digest, refers_to = row
                if out is None:
                    store.create_dir(base, recursive=True)
                    path, records, size, longest = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0, 0
                    out = store.open_output_stream(path, compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                whole = record(page_id, url, (html or "").encode(), digest, refers_to)
                longest = max(longest, whole.index(_END))
                data = packer.compress(whole) + packer.flush()
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return cut(marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, _MANIFEST), "warc-manifest")


class _Member:
    """The inflated bytes of one gzip member, a bounded piece at a time."""

    def __init__(self, stream, pending: bytes):
        self.stream, self.pending, self.inflate, self.ready = stream, pending, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Adds a piece to what is ready; False at the member's end."""
        while not self.inflate.eof:
            if not self.pending:
                self.pending = self.stream.read(CHUNK)
                if not self.pending:
                    raise ValueError("the archive ends inside a record")
            piece = self.inflate.decompress(self.pending, CHUNK)
            self.pending = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if piece:
                self.ready += piece
                return True
        return False

    def until(self, mark: bytes, limit: int) -> bytes:
        """What stands before the mark, which is passed over."""
        while (at := self.ready.find(mark)) < 0:
            if len(self.ready) > limit + CHUNK or not self.more():
                raise ValueError("a record's head has no end")
        found, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return found

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes."""
        while n:
            if not self.ready and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int
    payload_digest: str
    verified: bool


def _headers(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}


def read_records(stream, head_bytes: int = HEAD_BYTES) -> Iterator[Record]:
    """The records of an archive in order. Payloads are hashed piece by piece, never held; heads have head_bytes at most.

    payload_digest is computed from a response's payload; of a revisit, which has none, it is the recorded one.
    verified: the block has its recorded digest and a response's payload its own. A member that ends early, goes on
    after its record, or has no head raises ValueError.
    """
    pending = b""
    while pending or (pending := stream.read(CHUNK)):
        member = _Member(stream, pending)
        headers = _headers(member.until(_END, head_bytes))
        left = int(headers["content-length"])
        block, payload, head, n_payload, body = hashlib.sha256(), hashlib.sha256(), b"", 0, False
        for piece in member.pieces(left):
            block.update(piece)
            if not body:
                head += piece
                if _END not in head:
                    if len(head) > head_bytes:
                        raise ValueError("an HTTP head has no end")
                    continue
                head, _, piece = head.partition(_END)
                body = True
            payload.update(piece)
            n_payload += len(piece)
        if b"".join(member.pieces(len(_END))) != _END or member.ready or member.more():
            raise ValueError("a record does not end with its gzip member")
        pending = member.pending
        http = _headers(head)
        said = headers["warc-payload-digest"].removeprefix("sha256:")
        whole = headers["warc-type"] == "response"
        verified = headers["warc-block-digest"] == "sha256:" + block.hexdigest() and (not whole or said == payload.hexdigest())
        yield Record(headers, http, n_payload if whole else int(http["content-length"]), payload.hexdigest() if whole else said, verified)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the archives; each archive is read by one task, in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        number = lambda uri: int(n) if uri and (n := uri.removeprefix("<urn:x-page:").removesuffix(">")) else None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _RECORDS.split(", ")])

        for batch in batches:
            for path, longest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream, max(HEAD_BYTES, longest)):
                        h = r.headers
                        if not r.verified:
                            raise ValueError(f"{path}: {h['warc-record-id']} does not have its digests")
                        rows.append((number(h["warc-record-id"]), h["warc-target-uri"], r.payload_bytes, r.payload_digest, h["warc-type"], number(h.get("warc-refers-to")), r.verified))
                        if len(rows) == 4096:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    archives = max(1, manifest.count())
    return manifest.select("path", "head_bytes").repartition(min(archives, MAX_TASKS)).mapInArrow(read, _RECORDS)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes pages to new archives in the shared folder and reads them back, a row per page.

    pages: page_id, url, html; other columns are ignored. A null html is an empty payload, a null url an empty target;
    white space and control characters in a url are percent-encoded. Urls and payloads may be of any length. A record
    that fails its digests ends the job with an error. No pages: no rows. Rows that share both the smallest page_id and
    the payload are all responses; a null page_id is never the smallest.
    """
    folder = shared_path(pages.sparkSession, "warc")
    return read_archives(write_archives(mark_revisits(pages), folder), folder)


def op7_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    """Every page as its archive has it."""
    return archived_pages(spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("url")


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, true AS verified
FROM f
"""
