"""WARC archives: a writer with revisit records and a sequential reader.

Writing: one gzip member per record, archives rolled over at a size, in any folder that pyarrow's file systems reach.
A task's archives bear a name of its own attempt, and only those that its returned manifest names count, so lost or
repeated tasks leave nothing but unread files.

Reading: each archive is streamed: compressed blocks feed an incremental zlib decompressor whose end of stream marks the
record's end; header lines frame the block by Content-Length; block and payload digests are recomputed. A record that
breaks any of this raises, naming archive and offset.

Edge cases: a null payload is empty; a null URI writes no WARC-Target-URI; CR, LF and spaces in URIs are percent-encoded;
a null id reads back as null; rows that share both payload and the largest id are responses all; very long payloads span
many blocks; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.llm._base import fresh_path, store, table

ROLL_BYTES = 256 << 20
BLOCK = 1 << 18
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPAN = "urn:record:"


class WarcError(ValueError):
    """A record that cannot be framed or whose digest is wrong."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_fs(path: str) -> tuple[Any, str]:
    """pyarrow file system and path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def build_record(kind: str, record_id: str, date: str, headers: list[tuple[str, str]], block: bytes, content_type: str) -> bytes:
    """One record as one gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response with its payload, or a revisit: the HTTP header alone, whose Content-Length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if uri is not None:
        headers.insert(0, ("WARC-Target-URI", "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in uri)))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{SPAN}{'' if refers_to is None else refers_to}>")]
    name = f"{SPAN}{'' if page_id is None else page_id}"
    return build_record("revisit" if revisit else "response", name, date, headers, http if revisit else http + payload, "application/http; msgtype=response")


def members(stream: Any) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member, in order."""
    at, start, z, parts = 0, 0, zlib.decompressobj(31), []
    fresh = True
    while data := stream.read(BLOCK):
        data = bytes(data)
        while data:
            try:
                parts.append(z.decompress(data))
            except zlib.error as e:
                raise WarcError(f"no gzip member at {start}: {e}") from e
            fresh = False
            used = len(data) - len(z.unused_data)
            at += used
            if not z.eof:
                break
            yield start, b"".join(parts)
            data, start, z, parts, fresh = z.unused_data, at, zlib.decompressobj(31), [], True
    if not fresh:
        raise WarcError(f"the member at {start} is cut off")


def parse_record(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; framing and block digest are checked."""
    head, sep, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"not a header line: {line[:80]}")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or rest[int(length) :] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length!r} does not frame the block")
    block = rest[: int(length)]
    if (said := headers.get("warc-block-digest")) and said != f"sha1:{digest(block)}":
        raise WarcError("the block digest is wrong")
    return headers, block


def read_archive(stream: Any) -> Iterator[dict[str, Any]]:
    """Response and revisit records as dicts; other types (warcinfo) are passed over."""
    for offset, content in members(stream):
        try:
            headers, block = parse_record(content)
            kind = headers.get("warc-type")
            if kind not in ("response", "revisit"):
                continue
            head, sep, payload = block.partition(b"\r\n\r\n")
            said = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            http = dict((x.partition(":")[0].strip().lower(), x.partition(":")[2].strip()) for x in head.decode("utf-8", "replace").split("\r\n")[1:])
            if kind == "response" and (not sep or said != digest(payload)):
                raise WarcError("the payload digest is wrong")
            if kind == "response" and int(http["content-length"]) != len(payload):
                raise WarcError("the HTTP Content-Length is wrong")
        except (WarcError, KeyError, UnicodeDecodeError) as e:
            raise WarcError(f"record at {offset}: {e}") from e
        ref = headers.get("warc-refers-to")
        yield {
            "record_id": _number(headers["warc-record-id"]), "uri": headers.get("warc-target-uri"), "record_type": kind, "refers_to": _number(ref) if ref else None,
            "payload_bytes": int(http["content-length"]), "payload_digest": said, "payload": payload if kind == "response" else None,
        }


def _number(uri: str) -> int | None:
    tail = uri.strip("<>").removeprefix(SPAN)
    return int(tail) if tail else None


MANIFEST = "path string, records long, bytes long"
RECORDS = T.StructType(
    [
        T.StructField("record_id", T.LongType()), T.StructField("uri", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
    ]
)


def mark_revisits(pages: DataFrame, *, key: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """key, uri, payload, refers_to (the id that the row's payload is a response under) for each page.

    The largest id by digest is found with map-side combining, then joined back; Spark splits a hot digest's side.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    own = pages.select(F.col(key).cast("long").alias("page_id"), F.col("url").alias("uri"), body.alias("payload"), F.sha1(body).alias("_sha"))
    last = own.where(F.octet_length("payload") >= min_bytes).groupBy("_sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n"))
    # Only payloads that recur need the join; the others are responses in any case.
    return own.join(last.where(F.col("_n") > 1).drop("_n"), "_sha", "left").select("page_id", "uri", "payload", "refers_to", (F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).alias("revisit"))


def write_archives(rows: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write rows of mark_revisits as archives into folder; the manifest (path, records, bytes), already materialised."""

    def write(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        out, name, count, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page_id, uri, payload, refers_to, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "uri", "payload", "refers_to", "revisit")), strict=True):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    size += out.write(build_record("warcinfo", f"urn:uuid:{uuid.uuid4()}", date, [("WARC-Filename", name)], b"format: WARC File Format 1.1\r\n", "application/warc-fields"))
                size += out.write(page_record(page_id, uri, payload, refers_to, revisit, date))
                count += 1
                if size >= roll_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        yield pa.RecordBatch.from_pydict({"path": pa.array([x[0] for x in done], pa.string()), "records": pa.array([x[1] for x in done], pa.int64()), "bytes": pa.array([x[2] for x in done], pa.int64())})

    return store(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """The response and revisit records of the archives that manifest's path column names; one task per few archives."""

    def read(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        names = [f.name for f in RECORDS]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def batch(rows: list[dict[str, Any]]) -> Any:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names=names)

        for paths in batches:
            for path in paths.column("path").to_pylist():
                fs, at = open_fs(path)
                held: list[dict[str, Any]] = []
                size = 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for r in read_archive(stream):
                        if not payloads:
                            r["payload"] = None
                        size += len(r["payload"] or b"")
                        held.append(r)
                        if len(held) >= 5000 or size >= 16 << 20:
                            yield batch(held)
                            held, size = [], 0
                if held:
                    yield batch(held)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(min(n, 20_000)).mapInArrow(read, RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = write_archives(mark_revisits(pages), fresh_path(spark, "warc"))
    back = read_archives(manifest, payloads=False)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("uri").alias("url"))


ORACLE_SQL = """
WITH h AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS last FROM h)
SELECT page_id::BIGINT AS page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(sha, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END::BIGINT AS refers_to, url
FROM m
"""
