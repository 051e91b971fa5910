"""WARC archives: written with an index of byte ranges first, read back by coalesced ranges.

Records are gzip members of their own, one after another, so each can be read by its offset and length
alone. Of records with equal payloads of at least ``revisit_from`` bytes the one with the largest id is a
``response``; the others are ``revisit`` records that name it and hold its headers only. The index holds
file, offset, length, URL and digest of every record and is what makes an archive count: a task that is run
again writes a new file, and files that no index names are never read. Reads are dealt by range of file and
offset, and neighbouring records are fetched in one request.

Which records revisit is decided on ids and digests, without the pages. A group of equal payloads costs a
partial maximum and a join that adaptive execution can split, however large it is.

Defined results: a null payload is empty; a null id is smaller than all others and, like a null URL, its header
line is left out; rows that repeat the id of a response are responses too, other repeated rows are
revisits each; an empty table writes no archive and reads back as an empty table. Only the named columns are
read, so other columns cannot clash. An archive holds at most ``max_bytes`` and one record more, and a record
is held in memory as a whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.lean import lean
from gradeworks.session import write_table

MAX_ARCHIVE_BYTES = 1 << 30
GAP = 64 << 10
MAX_READ = 8 << 20
TASK_BYTES = 64 << 20
_LEVEL = 3
_INDEX = ["file", "offset", "length", "key", "url", "digest", "record_type"]
_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _plain(value: str) -> str:
    """A header value without control characters."""
    return "".join(quote(c) if c < " " or c == "\x7f" else c for c in value)


def record(key: str | None, url: str | None, payload: bytes, refers_to: str | None) -> tuple[bytes, str]:
    """One record before compression, and its payload digest."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {_DATE}"]
    if key is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{_plain(key)}>")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_plain(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{_plain(refers_to)}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse_record(data: bytes) -> dict:
    """Fields of one record; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    held = fields["WARC-Type"] == "response"
    if held and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    name = lambda x: None if x is None else x.removeprefix("<urn:page:").removesuffix(">")
    return {"key": name(fields.get("WARC-Record-ID")), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
            "refers_to": name(fields.get("WARC-Refers-To")), "payload_bytes": size, "payload_digest": digest,
            "payload": payload if held else None}


def _writer(folder: str, max_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for key, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if out is None or offset >= max_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    raw, digest = record(key, url, payload, refers_to)
                    packer = zlib.compressobj(_LEVEL, wbits=31)
                    member = packer.compress(raw) + packer.flush()
                    out.write(member)
                    rows.append((name, offset, len(member), key, url, digest, "response" if refers_to is None else "revisit"))
                    offset += len(member)
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(_INDEX)
                kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_INDEX)
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   revisit_from: int = 0, max_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """Write every row as a record below ``folder`` and return the index, itself a written table."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"), F.sha1(body).alias("hash"))
    ids = rows.filter(F.octet_length("payload") >= revisit_from).select("key", "hash")
    responses = ids.groupBy("hash").agg(F.max("key").alias("response"), F.count("*").alias("c")).filter("c > 1")
    revisits = ids.join(responses, "hash").filter(
        F.col("response").isNotNull() & ~F.col("key").eqNullSafe(F.col("response"))).select(
        F.col("key").alias("k"), F.col("hash").alias("h"), "response").distinct()
    marked = rows.join(revisits, rows["key"].eqNullSafe(revisits["k"]) & (rows["hash"] == revisits["h"]), "left").select(
        F.col("key").cast("string"), "url", "payload", F.col("response").cast("string").alias("refers_to"))
    return write_table(marked.mapInArrow(
        lean(_writer(folder, max_bytes)), "file string, offset long, length long, key string, url string, digest string, "
        "record_type string"), "warc-index")


def coalesced(ranges: list[tuple[str, int, int]], gap: int = GAP, most: int = MAX_READ) -> Iterator[tuple[str, int, int, list[int]]]:
    """Reads (file, offset, length, numbers of the ranges inside) that cover sorted ``ranges``."""
    now: tuple[str, int, int] | None = None
    inside: list[int] = []
    for i, (name, offset, length) in enumerate(ranges):
        if now and name == now[0] and offset - now[2] <= gap and offset + length - now[1] <= most:
            now = (name, now[1], max(now[2], offset + length))
            inside.append(i)
            continue
        if now:
            yield now[0], now[1], now[2] - now[1], inside
        now, inside = (name, offset, offset + length), [i]
    if now:
        yield now[0], now[1], now[2] - now[1], inside


def _reader(folder: str, payloads: bool):
    names = ["key", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            ranges = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            opened, name = None, ""
            try:
                for file, start, size, inside in coalesced(ranges):
                    if file != name:
                        if opened:
                            opened.close()
                        opened, name = system.open_input_file(f"{path}/{file}"), file
                    data = opened.read_at(size, start)
                    rows = [parse_record(zlib.decompress(data[ranges[i][1] - start:][:ranges[i][2]], wbits=31)) for i in inside]
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=pa.schema(
                        [(n, {"payload_bytes": pa.int64(), "payload": pa.binary()}.get(n, pa.string())) for n in names]))
            finally:
                if opened:
                    opened.close()

    return read


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name, in any selection."""
    columns = "key string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))  # by bytes to read, not by index rows
    ordered = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_reader(folder, payloads), columns + ", payload binary" * payloads)
