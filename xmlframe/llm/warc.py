"""WARC archives: a writer that turns repeated payloads into revisit records and a sequential reader.

An archive is a run of gzip members, one record each. The reader decompresses a member piece by piece, frames the record by
its Content-Length and checks length and digests, so neither side holds more than one record and one piece. Archives
travel as rows with a binary column, the shape that ``spark.read.format("binaryFile")`` gives for .warc.gz files;
``export_archives`` writes such files from it.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmlframe.llm.common import ship, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 16


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


class WarcError(ValueError):
    pass


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _clean(text: str) -> str:
    """A header value: no line ends or other controls can get in from the data."""
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in text)


def record_id(row_id: int | None) -> str:
    return f"<urn:xmlframe:row:{'null' if row_id is None else row_id}>"


def row_of(record: str | None) -> int | None:
    last = (record or "").rstrip(">").rpartition(":")[2]
    return None if last in ("", "null") else int(last)


def member(row_id: int | None, url: str | None, payload: bytes | None, digest: str, length: int, refers_to: int | None) -> bytes:
    """The gzip member of one record: a response with its payload, or a revisit with the payload's head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"" if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(row_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: {_digest(block)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def _headers(lines: Iterable[bytes]) -> dict[str, str]:
    return {k.decode().strip().lower(): v.decode().strip() for k, _, v in (x.partition(b":") for x in lines if x)}


def _framed(member_bytes: bytearray) -> Record:
    end = member_bytes.find(b"\r\n\r\n")
    first, *rest = bytes(member_bytes[: max(end, 0)]).split(b"\r\n")
    if end < 0 or not first.startswith(b"WARC/"):
        raise WarcError("no WARC record head")
    headers = _headers(rest)
    n = int(headers.get("content-length", -1))
    block, tail = bytes(member_bytes[end + 4 : end + 4 + n]), bytes(member_bytes[end + 4 + n :])
    if n < 0 or len(block) != n or tail != b"\r\n\r\n":
        raise WarcError(f"record {headers.get('warc-record-id')} isn't framed by its Content-Length")
    if (d := headers.get("warc-block-digest")) and d != _digest(block):
        raise WarcError(f"record {headers.get('warc-record-id')} has another block digest")
    out = Record(headers)
    if headers.get("content-type", "").startswith("application/http"):
        head, _, out.payload = block.partition(b"\r\n\r\n")
        out.http = _headers(head.split(b"\r\n")[1:])
        if headers["warc-type"] == "response" and (d := headers.get("warc-payload-digest")) and d != _digest(out.payload):
            raise WarcError(f"record {headers.get('warc-record-id')} has another payload digest")
    else:
        out.payload = block
    return out


def read_records(pieces: Iterable[bytes]) -> Iterator[Record]:
    """Records of an archive given piece by piece; a member may end and begin anywhere in a piece."""
    inflate, plain = zlib.decompressobj(31), bytearray()
    begun = False
    for piece in pieces:
        while piece:
            begun = True
            plain += inflate.decompress(piece)
            piece = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                yield _framed(plain)
                inflate, plain, begun = zlib.decompressobj(31), bytearray(), False
    if begun:
        raise WarcError("the archive ends inside a record")


def write_archives(df: DataFrame, *, row_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, size: int = 1 << 20) -> DataFrame:
    """Archives (``content`` binary, about ``size`` bytes each; ``records`` long) with one record for each row of ``df``.

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest id is a response and the others
    are revisits that refer to it; a shorter payload is always a response. A null payload is empty. Rows that share
    the smallest id are all responses; rows without an id are revisits if an equal payload has an id, else responses.

    Payloads meet their group's smallest id in a plain equi-join on the digest with a written table, one row a digest, so that
    adaptive execution can split a payload that very many rows share.
    """
    ship(df.sparkSession)
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(url).cast("string").alias("url"), text.alias("text"))
    rows = rows.withColumns({"digest": F.sha2(F.encode("text", "UTF-8"), 256), "length": F.octet_length("text").cast("long")})
    firsts = rows.where(F.col("length") >= least).groupBy("digest").agg(F.min("row_id").alias("first_id"))
    firsts = written(firsts.withColumnRenamed("digest", "_digest"), "warc-firsts")
    joined = rows.join(firsts, F.col("digest") == F.col("_digest"), "left")
    joined = joined.withColumn("refers_to", F.when(~F.col("row_id").eqNullSafe(F.col("first_id")), F.col("first_id")))
    # A revisit needs no text: it isn't sent to the writer.
    joined = joined.select("row_id", "url", F.when(F.col("refers_to").isNull(), F.col("text")).alias("text"), "digest", "length", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = bytearray(), 0
        for b in batches:
            for one in range(b.num_rows):
                row = b.slice(one, 1).to_pylist()[0]
                held += member(row["row_id"], row["url"], (row["text"] or "").encode(), row["digest"], row["length"], row["refers_to"])
                n += 1
                if len(held) >= size:
                    yield pa.RecordBatch.from_pydict({"content": [bytes(held)], "records": [n]}, schema=schema)
                    held, n = bytearray(), 0
        if n:
            yield pa.RecordBatch.from_pydict({"content": [bytes(held)], "records": [n]}, schema=schema)

    schema = pa.schema([("content", pa.binary()), ("records", pa.int64())])
    return joined.mapInArrow(run, "content binary, records long")


def read_archives(archives: DataFrame, content: str = "content", *, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives in column ``content``, lengths and digests checked.

    Gives row_id, url, record_type, refers_to (row id), payload_bytes and payload_digest (of the full payload, for a
    revisit as its head states them) and payload (binary, null for a revisit) unless ``with_payload`` is off. A damaged
    archive raises; a null or empty one has no records.
    """
    ship(archives.sparkSession)
    fields = [("row_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *[("payload", pa.binary())] * with_payload]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0):
                data = archive.as_buffer() if archive.is_valid else b""
                view, rows, held = memoryview(data), [], 0
                for r in read_records(bytes(view[i : i + PIECE]) for i in range(0, len(view), PIECE)):
                    kind = r.headers["warc-type"]
                    length = len(r.payload) if kind == "response" else int(r.http.get("content-length", 0))
                    row = {"row_id": row_of(r.headers.get("warc-record-id")), "url": r.headers.get("warc-target-uri"), "record_type": kind, "refers_to": row_of(r.headers.get("warc-refers-to")), "payload_bytes": length, "payload_digest": r.headers["warc-payload-digest"].removeprefix("sha256:")}
                    rows.append(row | ({"payload": r.payload if kind == "response" else None} if with_payload else {}))
                    held += len(r.payload) if with_payload else 100
                    if held >= 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = "row_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return archives.select(content).mapInArrow(run, ddl)


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive to ``folder`` (mounted on every executor) as <sha256 of its bytes>.warc.gz; returns path and records."""
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for row in b.to_pylist():
                path = os.path.join(folder, hashlib.sha256(row["content"]).hexdigest() + ".warc.gz")
                with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(row["content"])
                os.replace(part, path)  # a repeated task leaves one whole file
                yield pa.RecordBatch.from_pydict({"path": [path], "records": [row["records"]]})

    return archives.select("content", "records").mapInArrow(run, "path string, records long")
