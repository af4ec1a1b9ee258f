"""WARC archives: writing pages, and reading them back with segment reassembly.

A page is an HTTP response in chunked transfer framing.  One longer than
``SEGMENT`` bytes is a record and continuation records; the reader groups
continuations by origin identifier, orders them by segment number, verifies the
total length, and decodes the chunk framing.  Equal payloads are stored once:
later ones are revisit records that refer to the first.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import staging

SEGMENT, CHUNK = 32_768, 4096
RECORDS_PER_FILE = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: four times 40 bits, each eight digits of base 32."""
    digits = [F.lpad(F.upper(F.conv(F.substring(F.sha1(payload), i, 10), 16, 32)), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _cuts(data: bytes, size: int) -> list[int]:
    """Cut points about ``size`` bytes apart that never split a character."""
    out, at = [0], 0
    while len(data) - at > size:
        at += size
        while data[at] & 0xC0 == 0x80:
            at -= 1
        out.append(at)
    return [*out, len(data)]


def _record(kind: str, name: str, block: bytes, fields: list[tuple[str, str | None]]) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"), *fields, ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return text + "\r\n" + block.decode() + "\r\n\r"  # the text writer ends each row with the last line feed


def _name(page: str | None, digest: str, part: int = 1) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page} {digest} {part}'.encode()).digest())}>"


def page_records(page: str | None, url: str | None, html: str, digest: str, first: str | None, revisit: bool, segment: int = SEGMENT) -> list[str]:
    """The records of one page, each without its last line feed."""
    target = None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    name = _name(page, digest)
    common = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page)]
    if revisit:
        fields = [*common, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", _name(first, digest)), ("X-Refers-To-Page-ID", first), ("Content-Type", "application/http;msgtype=response")]
        return [_record("revisit", name, _HTTP, fields)]
    payload = html.encode()
    cuts = _cuts(payload, CHUNK)
    framed = b"".join(b"%x\r\n%b\r\n" % (hi - lo, payload[lo:hi]) for lo, hi in zip(cuts, cuts[1:]) if hi > lo)
    block = _HTTP + framed + b"0\r\n\r\n"
    cuts = _cuts(block, segment)
    if len(cuts) == 2:
        return [_record("response", name, block, [*common, ("Content-Type", "application/http;msgtype=response")])]
    out = [_record("response", name, block[: cuts[1]], [*common, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", "1")])]
    for n, (lo, hi) in enumerate(zip(cuts[1:], cuts[2:]), 2):
        total = str(len(block)) if hi == len(block) else None
        out.append(_record("continuation", _name(page, digest, n), block[lo:hi], [("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(n)), ("WARC-Segment-Total-Length", total)]))
    return out


def _build(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 200):
            rows = batch.slice(lo, 200).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r for x in rows for r in page_records(x["page"], x["url"], x["html"], x["digest"], x["first"], x["revisit"], segment)], pa.string())], ["value"])


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """Write the records of ``pages`` (page_id, url, html) as gzipped WARC files under ``path``.

    Of pages with equal payloads of ``least`` bytes or more, that with the
    smallest page_id is the response and the others revisit it; rows that repeat
    page_id and payload are all responses.  A null page_id comes after all others
    (the response only where every id is null), null html is an empty payload,
    a null url gives no target.  No rows give no records.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = staging.only(pages, "page_id", "url", "html").select("page_id", "url", html.alias("html"), payload_digest(F.encode(html, "UTF-8")).alias("digest"))
    seen = own.select("digest", "page_id").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1")
    seen = staging.stage(seen, "payloads")
    if seen.limit(100_001).count() <= 100_000:
        both = own.join(F.broadcast(seen.drop("n")), "digest", "left")
    else:
        both = staging.join_skewed(own, seen, ["digest"], staging.heavy_keys(seen, ["digest"], "n"), "left")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= least)
    rows = both.select(F.col("page_id").cast("string").alias("page"), F.col("url").cast("string").alias("url"), F.when(later, "").otherwise(F.col("html")).alias("html"), "digest", F.col("first").cast("string").alias("first"), later.alias("revisit"))
    rows.mapInArrow(lambda it: _build(it, segment), "value string").write.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_FIELDS = {
    "WARC-Type": "type", "WARC-Record-ID": "name", "WARC-Target-URI": "url", "WARC-Payload-Digest": "digest", "X-Page-ID": "page", "X-Refers-To-Page-ID": "refers_to",
    "WARC-Segment-Number": "number", "WARC-Segment-Origin-ID": "origin", "WARC-Segment-Total-Length": "total",
}


def inflate(data: bytes) -> bytes:
    """All gzip members of an archive, one for the whole or one for each record; other data as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        if not member.eof:
            raise ValueError("a gzip member is cut off")
        data = member.unused_data.lstrip(b"\0")  # padding after a member
    if out and data:
        raise ValueError("there is more than gzip members")
    return b"".join(out) or data


def parse_archive(data: bytes) -> Iterator[dict]:
    """Records of one archive by their stated lengths; a malformed record raises ValueError."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        if len(block) != size or data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"the record that ends at byte {at} is cut off")
        yield {v: head.get(k) for k, v in _FIELDS.items()} | {"block": block}


_PARSED = "type string, name string, url string, digest string, page string, refers_to string, number int, origin string, total bigint, block binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _PARSED.split(", "))])
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for r in parse_archive(inflate(content.as_py())):
                rows.append(r | {"number": r["number"] and int(r["number"]), "total": r["total"] and int(r["total"])})
                if len(rows) == 200:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)


def dechunk(body: bytes) -> bytes:
    """Decode chunked transfer framing; a wrong frame raises ValueError."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
        if body[at - 2 : at] != b"\r\n":
            raise ValueError(f"the chunk that ends at byte {at} has no end")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload of each response: its block, then its continuations by number, checked and decoded."""
    for batch in batches:
        for lo in range(0, len(batch), 100):
            part, payloads = batch.slice(lo, 100), []
            for block, number, rest in zip(part.column("block"), part.column("number"), part.column("rest"), strict=True):
                block, rest = block.as_py(), sorted(rest.as_py() or [], key=lambda s: s["number"])
                if rest or number.as_py():
                    if block is None or not rest or [s["number"] for s in rest] != list(range(2, len(rest) + 2)):
                        raise ValueError("a segment is missing")
                    block += b"".join(s["block"] for s in rest)
                    if len(block) != rest[-1]["total"]:
                        raise ValueError("the segments do not have the total length")
                head, _, body = block.partition(b"\r\n\r\n")
                payloads.append(dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body)
            yield pa.RecordBatch.from_arrays([part.column("page"), part.column("url"), part.column("digest"), pa.array(payloads, pa.binary())], ["page", "url", "digest", "payload"])


def read_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Responses (page, url, digest, payload) and revisits (page, url, digest, refers_to) of the archives.

    Segments are put together again; a missing segment (the first, the last, all
    continuations too), wrong total length, wrong frame or archive cut off fails the
    job.  Continuations that repeat are taken once.  An archive may be plain, one
    gzip member, or a member for each record.
    """
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path).select("content")
    records = staging.stage(files.mapInArrow(_parse, _PARSED), "records")
    rest = records.where("type = 'continuation'").dropDuplicates(["origin", "number"]).groupBy("origin").agg(F.collect_list(F.struct("number", "total", "block")).alias("rest"))
    first = records.where("type = 'response'").select("name", "page", "url", F.regexp_replace("digest", "^sha1:", "").alias("digest"), "block", "number")
    none = F.lit(None).cast("array<struct<number:int,total:bigint,block:binary>>")
    # Continuations without their first segment come through too, and fail as a first segment without continuations does.
    parted = first.where("number is not null").join(rest.withColumnRenamed("origin", "name"), "name", "full")
    whole = first.where("number is null").withColumn("rest", none).unionByName(parted)
    responses = whole.select("page", "url", "digest", "block", F.coalesce("number", F.when(F.col("rest").isNotNull(), 1)).alias("number"), "rest").mapInArrow(_assemble, "page string, url string, digest string, payload binary")
    revisits = records.where("type = 'revisit'").select("page", "url", F.regexp_replace("digest", "^sha1:", "").alias("digest"), "refers_to")
    return responses, revisits


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages``, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest are of the payload that came back; a revisit has those of the
    response it refers to.
    """
    write_archives(pages, path)
    responses, revisits = read_archives(pages.sparkSession, path)
    kind = dict(pages.dtypes)["page_id"]
    back = staging.stage(responses.select(F.col("page").cast(kind).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), payload_digest(F.col("payload")).alias("payload_digest")), "responses")
    again = revisits.select(F.col("page").cast(kind).alias("page_id"), F.col("digest").alias("payload_digest"), F.col("refers_to").cast(kind).alias("refers_to"))
    sizes = back.join(again.select("payload_digest").distinct(), "payload_digest", "left_semi").dropDuplicates(["payload_digest"]).select("payload_digest", "payload_bytes")
    out = back.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast(kind))
    # Many pages may have one payload: they are dealt over tasks.
    told = staging.join_skewed(again, sizes, ["payload_digest"], staging.heavy_rows(again, ["payload_digest"]))
    return out.unionByName(told.withColumn("record_type", F.lit("revisit")).select(*out.columns))
