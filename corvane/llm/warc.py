"""WARC archives: a writer of gzip members, and a salvage reader that survives damaged ones."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import by_bytes

#: An empty gzip member: it stands between records where the text sink wants a line separator, and decodes to nothing.
SEPARATOR = bytes.fromhex("1f8b08000000000000ff") + b"\x03\x00" + b"\x00" * 8
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_BLOCK = 1 << 16
ROW_BYTES = 1 << 20
RECORDS = (
    "archive string, start long, end long, kind string, reason string, record_type string, record_id string, target_uri string,"
    " refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_text(value: str) -> str:
    """Header values hold no control characters: these are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only, and the full payload's size in an extension field."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block += b"" if revisit else html
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append(f"WARC-Target-URI: {_header_text(url)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-X-Payload-Bytes: {len(html)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ROW_BYTES of gzip members, one member a record, so that rows bound an archive's bytes and not its records."""
    held, size = [], 0
    for batch in batches:
        for page_id, url, html, first in zip(*(batch.column(k) for k in range(4)), strict=True):
            payload, page_id, first = html.as_buffer().to_pybytes(), page_id.as_py(), first.as_py()
            raw = record(page_id, url.as_py(), payload, base32_sha1(payload), first, first is not None and first != page_id)
            gz = zlib.compressobj(5, zlib.DEFLATED, 31)
            held.append(gz.compress(raw) + gz.flush())
            size += len(held[-1])
            if size > ROW_BYTES:
                yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["member"])
                held, size = [], 0
    if held:
        yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["member"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, rows_per_file: int = 64) -> None:
    """Write one record per row into archives below path, each record a gzip member of its own.

    Of rows with equal payloads of at least min_bytes, the one with the smallest id is a response and the
    others revisit it; a null html is an empty payload. Payloads are told apart by SHA-1 and size; ids without
    a smaller one, null ids of a payload that has none other included, are responses. Copies are counted per digest before
    the join back, where adaptive execution splits a payload that many rows share. An archive has at most rows_per_file
    runs of members, each of ROW_BYTES or the one larger record that ended it: about 64 MB, where records are smaller than a run.
    The text sink takes binary rows as ISO-8859-1 strings, which maps every byte to itself. Runs a job when called.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "bytes": F.octet_length("html")})
    first = rows.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").drop("n")
    members = by_bytes(rows.join(first, ["digest", "bytes"], "left").select("page_id", "url", "html", "first")).mapInArrow(_members, "member binary")
    sink = members.select(F.col("member").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1"))
    sink.option("maxRecordsPerFile", rows_per_file).text(path)


class Damage(Exception):
    pass


def _parse(data: bytes, start: int) -> tuple[int, dict[str, str], bytes]:
    """(end, headers, block) of the uncompressed record at start, after all its checks."""
    line_end = data.find(b"\r\n", start)
    if not data.startswith(_VERSION, start) or line_end < 0:
        raise Damage("no record header")
    headers: dict[str, str] = {}
    while not data.startswith(b"\r\n", line_end + 2):
        at, line_end = line_end + 2, data.find(b"\r\n", line_end + 2)
        if line_end < 0:
            raise Damage("no record header")
        name, colon, value = data[at:line_end].decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damage("bad header line")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit() or len(length) > 18:
        raise Damage("no content length")
    begin, end = line_end + 4, line_end + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damage("record is cut or its length is wrong")
    block = data[begin:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        raise Damage("block digest differs")
    return end + 4, headers, block


def _member(data: memoryview, start: int) -> tuple[int, bytes, str | None]:
    """(end, content, reason) of the gzip member at start; zlib checks its CRC and size. With a reason the member is
    damaged, content is what decodes before the damage and end is where it was met."""
    gz, parts, at = zlib.decompressobj(31), [], start
    try:
        while not gz.eof and at < len(data):
            parts.append(gz.decompress(data[at : at + _BLOCK]))
            at += _BLOCK
    except zlib.error as e:
        # the block is read again by bytes, for what it holds before the damage
        gz, bad = zlib.decompressobj(31), at
        for k in range(start, bad, _BLOCK):
            gz.decompress(data[k : k + _BLOCK])
        try:
            while at < len(data):
                parts.append(gz.decompress(data[at : at + 1]))
                at += 1
        except zlib.error:
            pass
        return at, b"".join(parts), f"gzip: {e}"
    return min(at, len(data)) - len(gz.unused_data), b"".join(parts), None if gz.eof else "gzip member is cut"


def _content(content: bytes, damaged: bool) -> Iterator[tuple[str, object]]:
    """("record", (headers, block)) and ("gap", reason) of a member's content, in order; after a failed check it goes on at
    the next version line. What a damaged member holds counts only with a block digest of its own."""
    at, gap = 0, None
    while at < len(content):
        try:
            end, headers, block = _parse(content, at)
            if damaged and not headers.get("warc-block-digest", "").startswith("sha1:"):
                raise Damage("no digest in a damaged member")
        except Damage as e:
            gap = gap or (at, str(e))
            at = content.find(_VERSION, at + 1)
            if at < 0:
                break
            continue
        if gap:
            yield "gap", f"{gap[1]}, bytes {gap[0]} to {at} of the member's content"
            gap = None
        yield "record", (headers, block)
        at = end
    if gap:
        yield "gap", f"{gap[1]}, bytes {gap[0]} to {len(content)} of the member's content"


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, (headers, block)) and ("gap", start, end, reason), in order, covering data.

    After a failed check it goes on at the next gzip magic or version line from which a record passes all checks. Within
    a member it goes on at the next version line of the content, a damaged member's decoded part included; records and
    gaps of one member all have its start and end.
    """
    view, at, n = memoryview(data), 0, len(data)
    gap: tuple[int, str] | None = None
    # where the last damaged member was met, and what it gave: a stored member's records are also found as raw bytes
    upto, given = 0, []
    while at < n:
        found, reason = [], None
        try:
            if data.startswith(_MAGIC, at):
                end, content, reason = _member(view, at)
                found = list(_content(content, reason is not None))
                if reason and not any(kind == "record" for kind, _ in found):
                    raise Damage(reason)
            elif data.startswith(_VERSION, at):
                end, headers, block = _parse(data, at)
                found = [("record", (headers, block))]
            else:
                raise Damage("neither a gzip member nor a version line")
        except Damage as e:
            gap = gap or (at, str(e))
            end = None
        if end is None or reason:
            after = min([k for k in (data.find(_MAGIC, at + 1), data.find(_VERSION, at + 1)) if k >= 0], default=n)
            if end is None:
                at = after
                continue
            upto, given, end = end, [one for kind, one in found if kind == "record"], after
            found = [*(x for x in found if x[0] == "record"), ("gap", reason)]
        elif at < upto:
            found = [x for x in found if x[1] not in given]
        if gap:
            yield "gap", gap[0], at, gap[1]
            gap = None
        for kind, what in found:
            yield kind, at, end, what
        at = end
    if gap:
        yield "gap", gap[0], n, gap[1]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in RECORDS.split(",")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    for batch in batches:
        for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows, size = [], 0
            for kind, start, end, what in salvage(content.as_buffer().to_pybytes()):
                if kind == "gap":
                    rows.append((archive, start, end, kind, what, *[None] * 7))
                    continue
                headers, block = what
                payload = block.partition(b"\r\n\r\n")[2] if "application/http" in headers.get("content-type", "") else block
                revisit = headers.get("warc-type") == "revisit"
                stated = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                digest = stated if revisit else base32_sha1(payload)
                if not revisit and stated not in (None, digest):
                    rows.append((archive, start, end, "gap", "payload digest differs", *[None] * 7))
                    continue
                full = headers.get("warc-x-payload-bytes", "") if revisit else str(len(payload))
                rows.append((archive, start, end, kind, None, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), int(full) if full.isdigit() else None, digest, None if revisit else payload))
                size += len(payload)
                if size > 4 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record or quarantined gap of the archives below path (columns: RECORDS).

    Archives hold gzip members, uncompressed records or both. An archive is one task's work; the writer bounds its
    size. payload_digest is that of the bytes read for responses and the stated one for revisits. An empty folder
    or archive gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return by_bytes(files).mapInArrow(_read, RECORDS)


def page_number(column: str):
    """The id within <urn:page:...>; null where there is none."""
    return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
