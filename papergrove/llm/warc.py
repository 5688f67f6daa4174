"""WARC archives: writing, the monolithic-gzip normaliser, and reading by offset index.

A task writes its pages as one WARC stream compressed as a whole (as tools that gzip a finished file leave it). The
normaliser inflates such a file once, in bounded memory, rewrites every record as its own gzip member, and writes a
sidecar index with a line for each record: offset, length, type, page_id. Readers seek to a member by the index.

Records with equal payloads of at least `least` bytes are one response, that of the smallest page_id, and revisits of
it. Payloads are compared by SHA-1, as in the format; only digests that occur twice are joined back, to digests first
where they are many, so that no payload's copies meet in one task with their bodies.

Null html is an empty payload; a null page_id is written as an empty field, and is response only where no row of its
payload has a page_id; repeated rows of the smallest page_id are all responses; very long payloads are written in
pieces and read whole, one at a time; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .runtime import drop, file_system, has, prepare, stage, work_dir

CHUNK = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{sha1}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A whole record; a revisit keeps the HTTP head (with the payload's length) and no payload."""
    sha1 = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, sha1)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    head += [f"WARC-Payload-Digest: sha1:{sha1}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha1)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


class Inflated:
    """The content of a gzip file (of one or more members) as a stream read piece by piece."""

    def __init__(self, source):
        self.source, self.held, self.done = source, bytearray(), False
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        while not self.done:
            if self.inflate.eof:
                rest = self.inflate.unused_data or self.source.read(CHUNK)
                if not rest.strip(b"\0"):
                    self.done = True
                    break
                self.inflate = zlib.decompressobj(31)
                data = self.inflate.decompress(rest, CHUNK)
            else:
                raw = self.inflate.unconsumed_tail or self.source.read(CHUNK)
                if not raw:
                    raise EOFError("the gzip stream ends early")
                data = self.inflate.decompress(raw, CHUNK)
            if data:
                self.held += data
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """Through the next mark; empty at the end."""
        at = 0
        while (k := self.held.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.held)
            if not self._more():
                if self.held.strip():
                    raise EOFError("a record ends early")
                return b""
        out = bytes(self.held[: k + len(mark)])
        del self.held[: k + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise EOFError("a record ends early")
            out = bytes(self.held[:n])
            del self.held[: len(out)]
            n -= len(out)
            yield out


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:] if x)}


def normalise(source, target, index, level: int = 5) -> int:
    """Inflates `source` once; each record becomes a gzip member of `target` and a line of `index`. Returns the records."""
    stream, offset, n = Inflated(source), 0, 0
    while head := stream.until(b"\r\n\r\n"):
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        known = fields(head)
        member, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for piece in (head, *()):
            out = member.compress(piece)
            target.write(out)
            size += len(out)
        for piece in stream.pieces(int(known["content-length"]) + 4):
            out = member.compress(piece)
            target.write(out)
            size += len(out)
        out = member.flush()
        target.write(out)
        size += len(out)
        index.write(f"{offset}\t{size}\t{known.get('warc-type', '')}\t{known.get('x-page-id', '')}\n".encode())
        offset += size
        n += 1
    return n


def read_index(path: str) -> list[tuple[int, int, str, str]]:
    fs, name = file_system(path)
    with fs.open_input_stream(name) as f:
        rows = [x.split("\t") for x in f.read().decode().splitlines()]
    return [(int(a), int(b), kind, page) for a, b, kind, page in rows]


def read_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one gzip member."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    known = fields(head)
    body = rest[: int(known["content-length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record is not closed")
    http, _, payload = body.partition(b"\r\n\r\n")
    return known, fields(http), payload


def write_archives(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes all pages and normalises the archives; returns the manifest (path, records), a row an archive."""
    prepare(spark)
    folder = folder or work_dir(spark, "warc")
    pages = has(pages, "page_id", "url", "html")
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", body.alias("body"), F.sha1(body).alias("sha1"))
    twice = keyed.where(F.length("body") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select(F.col("sha1").alias("same"), "first")
    twice = stage(spark, twice, "payloads")
    n = twice.count()
    if n <= runtime.BROADCAST_ROWS:
        rows = keyed.join(F.broadcast(twice), keyed["sha1"] == twice["same"], "left").select("page_id", "url", "body", "first")
    else:  # a payload may fill any share of the rows: digests alone meet it, bodies are dealt by page and digest
        refers = keyed.select("page_id", "sha1").distinct().join(twice, F.col("sha1") == F.col("same")).select(F.col("page_id").alias("p"), "same", "first")
        rows = keyed.join(refers, keyed["page_id"].eqNullSafe(refers["p"]) & (keyed["sha1"] == refers["same"]), "left").select("page_id", "url", "body", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        name = uuid.uuid4().hex  # a task that runs again writes files of its own, and only its manifest row counts
        whole, target, index = (f"{root}/{name}{x}" for x in (".whole.warc.gz", ".warc.gz", ".idx"))
        n = 0
        with fs.open_output_stream(whole, compression=None) as out:
            squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
            for b in batches:
                for page_id, url, payload, first in zip(*(b.column(k).to_pylist() for k in range(4))):
                    out.write(squeeze.compress(record(page_id, url, payload, first, first is not None and first != page_id)))
                    n += 1
            out.write(squeeze.flush())
        if n:
            with fs.open_input_stream(whole, compression=None) as a, fs.open_output_stream(target, compression=None) as b, fs.open_output_stream(index, compression=None) as c:
                normalise(a, b, c)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "records"])
        fs.delete_file(whole)

    manifest = stage(spark, rows.mapInArrow(write, "path string, records long"), "manifest")
    drop(spark, twice)
    return manifest


def read_archives(manifest: DataFrame, group: int = 256) -> DataFrame:
    """A row a record, from the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        number = lambda x: int(x) if x else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = file_system(path + ".warc.gz")
                index = read_index(path + ".idx")
                with fs.open_input_file(name) as f:
                    for k in range(0, len(index), group):
                        rows = []
                        for offset, size, kind, _ in index[k : k + group]:
                            f.seek(offset)
                            known, http, payload = read_record(f.read(size))
                            full = kind == "response"
                            sha1 = digest(payload) if full else known["warc-payload-digest"].removeprefix("sha1:")
                            rows.append((number(known["x-page-id"]), len(payload) if full else int(http["content-length"]), sha1, known["warc-type"], number(known.get("x-refers-to-page-id")), known.get("warc-target-uri")))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return manifest.repartition(n).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
