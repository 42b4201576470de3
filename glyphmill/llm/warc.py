"""WARC archives as chunked record tables.

A page's payload becomes rows (record, chunk number, bytes); writers stream them into one gzip-per-record
archive per task, updating the digest chunk by chunk, and readers stream archives back into such rows, each
with the digest so far. No Python code ever holds a whole record. Archives go to a shared folder through
pyarrow's filesystems; the checkpointed list of finished archives names what readers open, so files that lost
or repeated tasks left behind are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from .common import cut, hot_join, shared_dir

CHUNK = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNKS = "page long, url string, size long, digest string, refers long, revisit boolean, n_chunks long, chunk_no long, chunk binary"
READ = "page_id long, record_type string, refers_to long, chunk_no long, last boolean, payload_bytes long, payload_digest string"


def _base32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def _safe(value: str) -> str:
    """A header value: what could end the line is percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


class Out:
    """A gzip member per record, on a stream."""

    def __init__(self, stream):
        self.stream, self.zip = stream, None

    def begin(self, r: dict) -> None:
        self.zip = zlib.compressobj(1, zlib.DEFLATED, 31)
        page = "null" if r["page"] is None else r["page"]
        kind = "revisit" if r["revisit"] else "response"
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_safe(r['url'] or f'urn:x-page:{page}')}", f"WARC-Payload-Digest: sha1:{r['digest']}", f"X-Payload-Length: {r['size']}"]
        if r["revisit"]:
            lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{r['refers']}>"]
        lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(HTTP) + (0 if r['revisit'] else r['size'])}"]
        self.put("\r\n".join(lines).encode() + b"\r\n\r\n" + HTTP)

    def put(self, raw) -> None:
        self.stream.write(self.zip.compress(raw))

    def end(self) -> None:
        self.put(b"\r\n\r\n")
        self.stream.write(self.zip.flush())


def _write_map(folder: str):
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        path, out, n, sha = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0, None
        stream = None
        for b in batches:
            for k in range(b.num_rows):
                r = {c: b.column(c)[k].as_py() for c in b.schema.names if c != "chunk"}
                if stream is None:
                    store.create_dir(root)
                    stream = store.open_output_stream(path)
                    out = Out(stream)
                if r["chunk_no"] == 0:
                    out.begin(r)
                    sha, n = hashlib.sha1(), n + 1
                if not r["revisit"]:
                    raw = b.column("chunk")[k].as_buffer()
                    sha.update(raw)
                    out.put(raw)
                if r["chunk_no"] == r["n_chunks"] - 1:
                    out.end()
                    if not r["revisit"] and _base32(sha.digest()) != r["digest"]:
                        raise ValueError(f"page {r['page']}: the chunks do not have the payload's digest")
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path.removeprefix(root + '/')}"]), pa.array([n], pa.int64())], names=["file", "records"])

    return run


def unzipped(stream, size: int) -> Iterator[bytes]:
    """The bytes of a stream of gzip members, in parts of at most `size`."""
    unzip, tail = zlib.decompressobj(31), b""
    while True:
        raw = tail or stream.read(size)
        if not raw:
            return
        part = unzip.decompress(raw, size)
        tail = unzip.unconsumed_tail
        if unzip.eof:
            tail = unzip.unused_data
            unzip = zlib.decompressobj(31)
        if part:
            yield part


class In:
    """Reads lines and bounded runs of bytes from parts."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.rest = parts, b""

    def _more(self) -> bool:
        part = next(self.parts, b"")
        self.rest += part
        return bool(part)

    def header(self) -> dict[str, str] | None:
        """Lines up to an empty one, as fields; null at the end."""
        while b"\r\n\r\n" not in self.rest:
            if not self._more():
                if self.rest.strip():
                    raise ValueError("the archive ends within a header")
                return None
        head, _, self.rest = self.rest.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        return {"": first} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    def run(self, size: int, chunk: int) -> Iterator[bytes]:
        while size:
            if not self.rest and not self._more():
                raise ValueError("the archive ends within a block")
            part, self.rest = self.rest[: min(size, chunk)], self.rest[min(size, chunk) :]
            size -= len(part)
            yield part


def records(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an archive: every record has at least one; the last has the payload's whole size and digest."""
    source = In(unzipped(stream, chunk))
    while (head := source.header()) is not None:
        page = re.fullmatch(r"<urn:x-page:(-?\d+|null)>", head["warc-record-id"])[1]
        row = {"page_id": None if page == "null" else int(page), "record_type": head["warc-type"], "refers_to": None}
        block = int(head["content-length"])
        if head["warc-type"] == "revisit":
            row["refers_to"] = int(re.fullmatch(r"<urn:x-page:(-?\d+)>", head["warc-refers-to"])[1])
            for _ in source.run(block, chunk):
                pass
            yield row | {"chunk_no": 0, "last": True, "payload_bytes": int(head["x-payload-length"]), "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"), "chunk": b""}
        else:
            if source.header() is None:
                raise ValueError(f"page {page}: no block")
            left, sha, done, n = block - len(HTTP), hashlib.sha1(), 0, 0
            if not left:
                yield row | {"chunk_no": 0, "last": True, "payload_bytes": 0, "payload_digest": _base32(sha.digest()), "chunk": b""}
            for part in source.run(left, chunk):
                sha.update(part)
                done += len(part)
                yield row | {"chunk_no": n, "last": done == left, "payload_bytes": done, "payload_digest": _base32(sha.digest()), "chunk": part}
                n += 1
            if _base32(sha.digest()) != head["warc-payload-digest"].removeprefix("sha1:"):
                raise ValueError(f"page {page}: the payload differs from its digest")
        for _ in source.run(4, 4):
            pass


def _read_map(folder: str, with_data: bool, chunk: int):
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()] + [pa.binary()] * with_data
        names = [x.split()[0] for x in READ.split(", ")] + ["chunk"] * with_data
        for b in batches:
            for file in b.column("file").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{file}") as stream:
                    for r in records(stream, chunk):
                        if with_data or r["last"]:
                            rows.append(r)
                            size += len(r["chunk"]) * with_data + 100
                        if size > 4 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in zip(names, kinds, strict=True)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in zip(names, kinds, strict=True)], names=names)

    return run


def chunk_rows(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Payloads as rows of CHUNKS, one record's chunks in order in one partition; which records revisit which is settled.

    Which page is first is settled from (page_id, digest) alone; a digest that many pages share is no task's own (see
    hot_join). Bodies then meet the rows of revisits by page_id and digest.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), body.alias("body"), F.sha1(body).alias("sha"), F.octet_length(body).cast("long").alias("size"))
    digests = cut(own.where(F.col("page").isNotNull() & (F.col("size") >= min_bytes)).select("page", "sha"))
    first = cut(digests.groupBy("sha").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count("*").alias("n")).where("first < last").select("sha", "first", "n"))
    again = hot_join(digests, first, ["sha"], "n", digests.count()).where("page > first").select("page", "sha", "first").distinct()
    rows = own.join(again, ["page", "sha"], "left").withColumn("revisit", F.col("first").isNotNull())
    n = F.when(F.col("revisit"), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / chunk))).cast("long")
    numbered = rows.withColumn("n_chunks", n).select("page", "url", "size", "sha", F.col("first").alias("refers"), "revisit", "n_chunks", "body", F.explode(F.expr("sequence(0L, n_chunks - 1)")).alias("chunk_no"))
    part = F.expr(f"if(revisit, binary(''), substring(body, cast(chunk_no * {chunk} + 1 as int), {chunk}))")
    return numbered.select("page", "url", "size", F.col("sha").alias("digest"), "refers", "revisit", "n_chunks", "chunk_no", part.alias("chunk"))


def _base32_of_hex(batches_run):
    def run(batches):
        for b in batches:
            k = b.schema.get_field_index("digest")
            yield b.set_column(k, "digest", pa.array([_base32(bytes.fromhex(x)) for x in b.column(k).to_pylist()]))

    return lambda batches: batches_run(run(batches))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write a WARC record per row of pages (page_id, url, html) into archives in folder; (file, records) of each, finished."""
    ship(pages.sparkSession)
    return cut(chunk_rows(pages, min_bytes, chunk).mapInArrow(_base32_of_hex(_write_map(folder)), "file string, records long"))


def read_archives(archives: DataFrame, folder: str, with_data: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Rows of READ of the archives listed: each record's last row, or with_data all its chunk rows with their bytes."""
    ship(archives.sparkSession)
    return archives.mapInArrow(_read_map(folder, with_data, chunk), READ + ", chunk binary" * with_data)


def round_trip(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Rows of READ, one per row of pages (page_id, url, html), from archives written to the shared folder and read back.

    The payload is the html in UTF-8; null is empty. Of records with equal payloads of at least min_bytes bytes the
    smallest page_id is a response and the others revisit it; smaller ones are all responses. A null page_id takes
    no part in that: its record is a response. Rows that repeat a page_id each have a record, all of one type.
    Control characters and blanks in a url are percent-encoded. An empty table gives an empty table; other columns
    are not read.
    """
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    folder = re.sub(r"^file:/(?!/)", "file:///", folder)
    return read_archives(write_archives(pages, folder, min_bytes, chunk), folder, chunk=chunk).where("last")


def op10_warc(pages: DataFrame) -> DataFrame:
    """The columns of the query: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return round_trip(pages.select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH own AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT page_id, strlen(body)::BIGINT AS n, h, list_reduce(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', ((strpos('0123456789abcdef', substr(h, i, 1)) - 1) * 4 + 1)::BIGINT, 4)), lambda a, b: a || b) AS b FROM own),
coded AS (SELECT page_id, n, h, list_reduce(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (list_sum(list_transform(range(0, 5), lambda k: (CASE WHEN substr(b, j * 5 + k + 1, 1) = '1' THEN 1 << (4 - k)::INTEGER ELSE 0 END))) + 1)::BIGINT, 1)), lambda x, y: x || y) AS d FROM bits),
firsts AS (SELECT h, min(page_id) AS f FROM own GROUP BY h)
SELECT c.page_id, c.n AS payload_bytes, c.d AS payload_digest, CASE WHEN c.page_id > f.f THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN c.page_id > f.f THEN f.f END AS refers_to
FROM coded c JOIN firsts f USING (h)
"""
