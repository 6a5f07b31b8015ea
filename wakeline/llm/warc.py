"""WARC archives: written with one gzip member per record, read back sequentially.

Payloads seen before become revisit records: of the records with equal payloads the one with the largest
id keeps its payload. The reader decompresses step by step, takes each record's block by its content
length, and checks the digests.

Cases: a null payload is empty; a null target gets a URN of its id, and line breaks in targets are
percent-encoded; repeated rows with the largest id of their payload are all responses; an empty table gives no
archive; other columns are ignored. A record that is cut short, wrongly framed or fails a digest is an error.
Archives lie in the shared folder under names of their own, so a task that runs twice leaves a file that no list
names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, map_arrow

ARCHIVE_BYTES = 64 << 20
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit keeps the headers of the response, its payload's length among them."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = f"urn:page:{page_id}" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _members(stream: BinaryIO, size: int) -> Iterator[tuple[Callable[[int], bytes], Callable[[bytes], bytes]]]:
    """For each gzip member: a function that gives the next n bytes, one that reads up to a mark; both fail at its end."""
    rest = b""
    while True:
        rest = rest or stream.read(size)
        if not rest:
            return
        unpack, out = zlib.decompressobj(31), bytearray()

        def more(unpack=unpack, out=out) -> bool:
            nonlocal rest
            if unpack.eof:
                return False
            rest = rest or stream.read(size)
            if not rest:
                raise ValueError("the archive ends within a record")
            out += unpack.decompress(rest, size)
            rest = unpack.unconsumed_tail or unpack.unused_data
            return True

        def take(n: int, out=out, more=more) -> bytes:
            while len(out) < n:
                if not more():
                    raise ValueError("a record is shorter than its content length")
            got = bytes(out[:n])
            del out[:n]
            return got

        def until(mark: bytes, out=out, more=more) -> bytes:
            at = 0
            while (end := out.find(mark, at)) < 0:
                at = max(0, len(out) - len(mark))
                if not more():
                    raise ValueError("a record's header does not end")
            return take(end + len(mark))

        yield take, until
        while more():
            pass
        if out:
            raise ValueError("a member holds more than its record")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:]) if k}


def read_records(stream: BinaryIO, size: int = 1 << 16) -> Iterator[dict]:
    """The records of an archive, in order; raises ValueError for one that is broken."""
    for take, until in _members(stream, size):
        head = until(b"\r\n\r\n")
        if not head.startswith(VERSION.encode() + b"\r\n"):
            raise ValueError("no WARC record")
        fields = _fields(head)
        block = take(int(fields["content-length"]))
        if take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than its content length")
        if fields["warc-block-digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"block digest of {fields['warc-record-id']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        whole = fields["warc-type"] == "response"
        if whole and fields["warc-payload-digest"] != f"sha1:{digest(payload)}":
            raise ValueError(f"payload digest of {fields['warc-record-id']}")
        number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">"))
        yield {
            "page_id": number(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"],
            "payload_bytes": len(payload) if whole else int(_fields(http)["content-length"]), "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
            "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "payload": payload if whole else None,
        }


def _write(folder: str, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        out, name, n, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, sha1, refers = (batch.column(i)[row].as_py() for i in range(5))
                if out is None:
                    system.create_dir(path, recursive=True)
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                data = record(page_id, url, html.encode(), base64.b32encode(bytes.fromhex(sha1)).decode(), refers)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= limit:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return run


def _read(payloads: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]
        for batch in batches:
            for at in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(at)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream):
                        rows.append(r)
                        held += len(r["payload"] or b"") if payloads else 100
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names)
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return run


def write(df: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of about ``limit`` bytes at most and returns their list: path, records, bytes."""
    scratch = Scratch(df.sparkSession, "warc")
    body = F.coalesce(F.col(html), F.lit(""))
    pages = df.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("sha1"))
    # a common payload has many rows but one row here; written, so that the join below deals out both sides anew and can split it
    again = scratch.keep(pages.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha1", "last"))
    marked = pages.join(again, "sha1", "left").select("page_id", "url", "html", "sha1", F.when(F.col("last") != F.col("page_id"), F.col("last")).alias("refers_to"))
    return scratch.keep(map_arrow(marked, _write(f"{scratch.path}/archives", limit), "path string, records bigint, bytes bigint"))


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the archives in ``path``, one task for each archive; with ``payloads`` also what responses hold."""
    n = max(1, archives.count())
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    return map_arrow(archives.select("path").repartition(n), _read(payloads), schema)
