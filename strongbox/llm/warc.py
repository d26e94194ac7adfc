"""WARC archives: writing payloads as response, revisit and continuation records, and reading them back.

A record is its headers, an empty line, a block of Content-Length bytes and two line ends. A payload
that is longer than a segment is continued in further records, which name the first one, their
segment number and, in the last, the total length. Responses are framed as chunked HTTP transfer.
Archives are gzip files, written and read by Spark's text source with two line ends as separator, so
any store that Spark reaches will do. A block may hold the separator itself: the reader goes by
Content-Length. Segments end between characters, so every block is valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strongbox.llm.tables import Rows, arrow_schema, partitions, rows_of

VERSION, LINE, GAP = "WARC/1.1", "\r\n", "\r\n\r\n"
SEGMENT = 256 << 10
CHUNK = 32 << 10
HTTP = LINE.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked"]) + GAP


def page_urn(page_id: int, row: int) -> str:
    """Names a record by its page and row: rows may be repeated."""
    return f"<urn:page:{page_id}:{row}>"


def page_of(urn: str) -> int:
    return int(urn.split(":")[2].rstrip(">"))


def cuts(data: bytes, size: int) -> list[int]:
    """Where to cut UTF-8 into parts of at most ``size`` bytes, between characters."""
    at, out = 0, []
    while len(data) - at > size:
        at += size
        while data[at] & 0xC0 == 0x80:
            at -= 1
        out.append(at)
    return out


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """A payload in chunked transfer framing: size in hex, bytes, ..., a chunk of none."""
    bounds = [0, *cuts(payload, size), len(payload)]
    parts = [payload[a:b] for a, b in zip(bounds, bounds[1:], strict=False) if b > a]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


class Unchunked:
    """Decodes chunked transfer framing that arrives in pieces cut anywhere; keeps digest and length,
    no bytes of the payload unless asked to."""

    def __init__(self, keep: bool = False):
        self.rest, self.left, self.ended = b"", None, False
        self.sha1, self.length, self.kept = hashlib.sha1(), 0, [] if keep else None

    def feed(self, data: bytes) -> None:
        data, at = self.rest + data, 0
        while not self.ended:
            if self.left is None:
                end = data.find(b"\r\n", at)
                if end < 0:
                    break
                self.left, at = int(data[at:end].split(b";")[0], 16), end + 2
                self.ended = self.left == 0
                continue
            take = data[at : at + self.left]
            self.sha1.update(take)
            self.length += len(take)
            if self.kept is not None:
                self.kept.append(take)
            at, self.left = at + len(take), self.left - len(take)
            if self.left or len(data) < at + 2:
                break
            if data[at : at + 2] != b"\r\n":
                raise ValueError("a chunk doesn't end where its size says")
            at, self.left = at + 2, None
        self.rest = data[at:] if not self.ended else b""

    def done(self) -> tuple[int, str]:
        if not self.ended:
            raise ValueError("the transfer ends before its last chunk")
        return self.length, self.sha1.hexdigest()


def record(headers: dict[str, str | int], block: bytes) -> str:
    """A record without the line ends behind it."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return LINE.join(lines) + GAP + block.decode()


def records_of(page_id: int, row: int, url: str, payload: bytes, refers_to: int | None, segment: int = SEGMENT) -> Iterator[str]:
    """The records of one page: a revisit, or a response and its continuations."""
    digest = hashlib.sha1(payload).hexdigest()
    head = {"WARC-Record-ID": page_urn(page_id, row), "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is not None:
        http = LINE.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]) + GAP
        yield record({"WARC-Type": "revisit"} | head | {"WARC-Refers-To": f"<urn:page:{refers_to}>"}, http.encode())
        return
    block = HTTP.encode() + chunked(payload)
    bounds = [0, *cuts(block, segment), len(block)]
    if len(bounds) == 2:
        yield record({"WARC-Type": "response"} | head, block)
        return
    yield record({"WARC-Type": "response"} | head | {"WARC-Segment-Number": 1}, block[: bounds[1]])
    for n, (a, b) in enumerate(zip(bounds[1:], bounds[2:], strict=False), 2):
        total = {"WARC-Segment-Total-Length": len(block)} if b == len(block) else {}
        own = {"WARC-Record-ID": f"<urn:page:{page_id}:{row}:{n}>", "WARC-Segment-Origin-ID": page_urn(page_id, row), "WARC-Segment-Number": n}
        yield record({"WARC-Type": "continuation"} | own | total, block[a:b])


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Adds refers_to: of pages with equal payloads of at least ``least`` bytes, all but the one with the
    largest page_id refer to it. Equal means the same SHA-1 and length."""
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    known = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"),
        html.cast("string").alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes"),
    )
    last = (
        known.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where("n > 1").drop("n")
    )
    return known.join(last, ["digest", "bytes"], "left").select(
        "page_id", "url", "html", F.when(F.col("last") > F.col("page_id"), F.col("last")).alias("refers_to")
    )


def write_warc(pages: DataFrame, path: str, segment: int = SEGMENT, least: int = 1000) -> None:
    """Writes a record per page (page_id, url, html) and its continuations to gzip archives at ``path``.

    The payload is html in UTF-8, null ones are empty. Rows without page_id can't be named and are left
    out. Continuations may lie in any file and order. Line ends in a url are removed.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(value=pa.string()), most=1024)
        for page_id, row, url, html, refers_to in rows_of(batches, "page_id", "row", "url", "html", "refers_to"):
            url = "".join(url.split())
            for text in records_of(page_id, row, url, html.encode(), refers_to, segment):
                out.add(text, size=len(text))
                if out.full():
                    yield from out.take()
        yield from out.take()

    found = with_revisits(pages.where("page_id is not null"), least)
    records = found.withColumn("row", F.monotonically_increasing_id()).mapInArrow(make, "value string")
    records.write.option("lineSep", GAP).option("compression", "gzip").text(path)


FOUND = arrow_schema(
    type=pa.string(), origin=pa.string(), page_id=pa.int64(), segment=pa.int64(), total=pa.int64(), digest=pa.string(), refers_to=pa.int64(),
    payload_bytes=pa.int64(), block=pa.binary(),
)


def _parsed(lines: str) -> dict[str, str]:
    first, *rest = lines.split(LINE)
    if first != VERSION:
        raise ValueError(f"not a record: {first[:60]!r}")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in rest)}


def _found(headers: dict[str, str], block: bytes) -> tuple:
    kind = headers["warc-type"]
    origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
    number, total = (headers.get(f"warc-segment-{x}") for x in ("number", "total-length"))
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    to = headers.get("warc-refers-to")
    whole = kind == "response" and number is None
    length = None
    if whole:
        length, own = _decoded(block)
        if own != digest:
            raise ValueError(f"{origin}: the payload isn't what its digest says")
    elif kind == "revisit":
        length = int(next(x for x in block.decode().split(LINE) if x.lower().startswith("content-length: ")).split(": ")[1])
    return (
        kind, origin, page_of(origin), int(number or 1), int(total) if total else None, digest or None, page_of(to) if to else None,
        length, None if whole or kind == "revisit" else block,
    )


def _decoded(block: bytes) -> tuple[int, str]:
    framed = Unchunked()
    framed.feed(block.partition(GAP.encode())[2])
    return framed.done()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives, each block read by its Content-Length, a file in one pass.

    Returns type, origin (the first segment's id), page_id, segment, total, digest, refers_to,
    payload_bytes (known for whole responses and revisits) and block (null where it isn't needed).
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(FOUND)
        file, headers, parts, size, wanted = None, None, [], 0, 0

        def ended() -> None:
            if headers is not None or size:
                raise ValueError(f"{file} ends inside a record")

        for at, value in rows_of(batches, "file", "value"):
            if at != file:
                ended()
                file = at
            # The separator is put back: where a block ends in line ends, lines are cut elsewhere.
            parts.append(value.encode() + GAP.encode())
            size += len(parts[-1])
            while size > wanted or size == wanted > 0:
                data = b"".join(parts)
                if headers is None:
                    head, gap, data = data.partition(GAP.encode())
                    headers = _parsed(head.decode())
                    wanted = int(headers["content-length"]) + len(GAP)
                else:
                    if data[wanted - len(GAP) : wanted] != GAP.encode():
                        raise ValueError(f"{file}: a block is longer than its Content-Length")
                    out.add(*_found(headers, data[: wanted - len(GAP)]), size=wanted)
                    headers, data, wanted = None, data[wanted:], 0
                    if out.full():
                        yield from out.take()
                parts, size = [data] if data else [], len(data)
        ended()
        yield from out.take()

    lines = spark.read.option("lineSep", GAP).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    schema = "type string, origin string, page_id long, segment long, total long, digest string, refers_to long, payload_bytes long, block binary"
    return lines.mapInArrow(parse, schema)


PAYLOADS = arrow_schema(page_id=pa.int64(), payload_bytes=pa.int64(), payload_digest=pa.string())


def reassemble(segments: DataFrame, payloads: bool = False) -> DataFrame:
    """Puts segmented payloads together: groups segments by their origin, takes them in order of their
    number, verifies that none is missing and the total length, decodes the chunked framing and
    verifies the digest. A payload is read in one pass. With ``payloads`` it is returned as well.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = PAYLOADS.append(pa.field("payload", pa.binary())) if payloads else PAYLOADS
        out, now = Rows(schema), None

        def close() -> None:
            if now["total"] != now["length"]:
                raise ValueError(f"page {now['page']}: segments are missing, or the total length is wrong")
            length, digest = now["frame"].done()
            if digest != now["digest"]:
                raise ValueError(f"page {now['page']}: the payload isn't what its digest says")
            out.add(now["page"], length, digest, *([b"".join(now["frame"].kept)] if payloads else []), size=length if payloads else 0)

        for origin, page, number, total, digest, block in rows_of(batches, "origin", "page_id", "segment", "total", "digest", "block"):
            if now is None or now["origin"] != origin:
                if now is not None:
                    close()
                    if out.full():
                        yield from out.take()
                now = {"origin": origin, "page": page, "next": 1, "total": None, "digest": digest, "length": 0, "frame": Unchunked(payloads), "head": b""}
            if number != now["next"]:
                raise ValueError(f"page {page}: segment {now['next']} is missing")
            now["next"], now["total"], now["length"] = number + 1, total, now["length"] + len(block)
            if now["head"] is not None:  # the HTTP headers come first
                head, gap, block = (now["head"] + block).partition(GAP.encode())
                now["head"] = None if gap else head
            if now["head"] is None:
                now["frame"].feed(block)
        if now is not None:
            close()
        yield from out.take()

    ordered = (
        segments.select("origin", "page_id", "segment", "total", "digest", "block")
        .repartition(partitions(segments.sparkSession), "origin").sortWithinPartitions("origin", "segment")
    )
    return ordered.mapInArrow(join, "page_id long, payload_bytes long, payload_digest string" + ", payload binary" * payloads)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """What archives hold, a row per page: page_id, payload_bytes, payload_digest (of the full payload,
    bare hex), record_type, refers_to. An archive without records gives no rows."""
    found = read_records(spark, path)
    whole = found.where("block is null").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )
    joined = reassemble(found.where("block is not null"))
    return whole.unionByName(joined.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}))


#: The same in SQL, read off the pages.
WARC_SQL = """
with sized as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
    max(page_id) over (partition by coalesce(html, '')) as last from pages where page_id is not null)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  if(payload_bytes >= 1000 and page_id < last, 'revisit', 'response') as record_type, if(payload_bytes >= 1000 and page_id < last, last, null) as refers_to
from sized
"""
