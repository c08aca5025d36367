"""WARC archives: writing segmented records and reassembling them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.filters import join_groups, maybe_in
from annalist.plans.staging import stage

#: Bytes of a record's block above which it is written as a first segment and continuation records.
SEGMENT_BYTES = 16384
#: Code points of a chunk in chunked transfer framing.
CHUNK_CHARS = 4096
#: Records of one archive; with blocks of ``SEGMENT_BYTES`` at most, some 70 MB before compression.
ARCHIVE_RECORDS = 4096
_NS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_base32(payload: bytes) -> str:
    """SHA-1 as upper-case base32, as WARC digests are written."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, rid: str, block: str, **fields: str) -> str:
    """One record as text. It lacks its last line feed, which the text writer adds."""
    size = len(block.encode())
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{rid}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n{head}Content-Length: {size}\r\n\r\n{block}\r\n\r"


def _segments(block: str, most: int) -> list[str]:
    """``block`` cut between characters into parts of at most ``most`` bytes in UTF-8 (a part holds a character at least)."""
    data, out, a = block.encode(), [], 0
    while a < len(data):
        b = min(len(data), a + most)
        while b < len(data) and b > a + 1 and data[b] & 0xC0 == 0x80:
            b -= 1
        if b < len(data) and data[b] & 0xC0 == 0x80:  # one character longer than a part
            while b < len(data) and data[b] & 0xC0 == 0x80:
                b += 1
        out.append(data[a:b].decode())
        a = b
    return out or [""]


def _record_id(page_id: int | None, digest: str, url: str | None) -> str:
    """The same for rows that are equal in all; different urls of a page are different records."""
    return str(uuid.uuid5(_NS, json.dumps([page_id, digest, url])))


def page_records(page_id: int | None, url: str | None, page: str, original: int | None, revisit: bool, segment_bytes: int = SEGMENT_BYTES, original_url: str | None = None) -> list[str]:
    """Records of one page: a response in chunked framing, cut into segments if long, or a revisit without payload."""
    payload = page.encode()
    digest = sha1_base32(payload)
    rid = _record_id(page_id, digest, url)
    own = {"WARC_Target_URI": json.dumps(url) if url is not None else None, "X_Page": json.dumps(page_id), "X_Payload_Length": str(len(payload)), "WARC_Payload_Digest": f"sha1:{digest}"}
    if revisit:
        refers = f"<urn:uuid:{_record_id(original, digest, original_url)}>"
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record("revisit", rid, "", **own, WARC_Profile=profile, WARC_Refers_To=refers, X_Refers_To_Page=json.dumps(original))]
    chunks = [page[i : i + CHUNK_CHARS] for i in range(0, len(page), CHUNK_CHARS)]
    body = "".join(f"{len(c.encode()):x}\r\n{c}\r\n" for c in chunks) + "0\r\n\r\n"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n{body}"
    parts = _segments(block, segment_bytes)
    if len(parts) == 1:
        return [_record("response", rid, block, **own)]
    out = [_record("response", rid, parts[0], **own, WARC_Segment_Number="1")]
    for n, part in enumerate(parts[1:], 2):
        total = str(len(block.encode())) if n == len(parts) else None
        out.append(_record("continuation", str(uuid.uuid5(_NS, f"{rid}/{n}")), part, WARC_Segment_Origin_ID=f"<urn:uuid:{rid}>", WARC_Segment_Number=str(n), WARC_Segment_Total_Length=total))
    return out


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record for every row of ``pages`` (``page_id``, ``url``, ``html``) as gzipped WARC files below ``path``.

    Of rows with equal payloads of at least ``min_payload`` bytes the smallest page_id is the response, the others revisit
    it. Null html is an empty payload; null ids are written as null and never preferred; repeated rows of the page that is
    the response are responses; an empty table writes an empty archive. An archive holds ``ARCHIVE_RECORDS`` records at most.

    Equal payloads are found by their SHA-256 and counted per task before they are shuffled. Pages are not shuffled, but for
    those whose payload may occur more than once by a filter of bounded size; of these, pages with one of the most frequent
    payloads stay where they are, too.
    """
    c = F.col
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_key", F.sha2("html", 256))
    known = F.when(c("page_id").isNotNull(), F.struct("page_id", "url"))
    firsts = rows.groupBy("_key").agg(F.min(known).alias("_min"), F.count("*").alias("_n"))
    firsts = stage(firsts.filter("_n > 1").select(c("_key").alias("_again"), c("_min.page_id").alias("_first"), c("_min.url").alias("_first_url"), "_n"), "payloads")
    n, total = firsts.agg(F.count("*"), F.sum("_n")).first()
    asked, maybe = maybe_in(rows, F.xxhash64("_key"), firsts.select(F.xxhash64("_again").alias("h")), n)
    names, same = ["page_id", "url", "html", "_first", "_first_url"], c("_key") == c("_again")
    lone = asked.filter(~maybe)
    many = asked.filter(maybe)
    sole = many.join(firsts, same, "left_anti")  # the filter lets some pass that are alone
    own = [d.select("page_id", "url", "html", c("page_id").alias("_first"), c("url").alias("_first_url")) for d in (lone, sole)]
    rows = own[0].unionByName(own[1]).unionByName(join_groups(many, firsts, same, c("_n"), total or 0).select(*names))
    rows = rows.withColumn("_revisit", ~c("page_id").eqNullSafe(c("_first")) & (F.octet_length("html") >= min_payload))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out: list[str] = []
                for r in batch.slice(at, 64).to_pylist():
                    out += page_records(r["page_id"], r["url"], r["html"], r["_first"], r["_revisit"], segment_bytes, r["_first_url"])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    records = rows.select("page_id", "url", "html", "_first", "_first_url", "_revisit").mapInArrow(run, "value string")
    records.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record, by the lengths they state."""
    at, n = 0, len(data)
    while at < n:
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        head = {k.lower(): v for k, v in head.items()}
        a, size = end + 4, int(head["content-length"])
        if a + size > n:
            raise ValueError("a record is cut short")
        yield head, data[a : a + size]
        at = a + size + 4


def dechunk(block: bytes) -> bytes:
    """Payload of an HTTP response, its chunked framing undone and checked."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(chunk)
        at = end + 4 + size


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``, segments joined again.

    Columns: ``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload_bytes``, ``payload_digest``, ``payload`` (null for
    revisits). Continuations are grouped by the record they continue, ordered by segment number, and their sum is held
    against the stated total; a missing, repeated or surplus segment, a wrong chunk or digest raises. Only segmented
    records are shuffled, and a group is one record. Repeated records give repeated rows.
    """
    c = F.col
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                size = 0
                for h, block in parse_records(gzip.decompress(content.as_py())):
                    rows.append({"origin": h.get("warc-segment-origin-id", h["warc-record-id"]), "seg": int(h["warc-segment-number"]) if "warc-segment-number" in h else None, "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, "head": json.dumps(h) if h["warc-type"] != "continuation" else None, "block": block})
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, RAW)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, RAW)

    raw = files.mapInArrow(parse, "origin string, seg long, total long, head string, block binary")
    whole = raw.filter("seg is null").select("head", "block")
    parts = raw.filter("seg is not null").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("seg", "total", "head", "block"))).alias("p")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                p = batch.column(1)[at].as_py()
                copies = sum(x["seg"] == 1 for x in p)
                seg = p[::copies] if copies else p
                block = b"".join(x["block"] for x in seg)
                if not copies or len(p) != copies * len(seg) or [x["seg"] for x in seg] != list(range(1, len(seg) + 1)) or len(block) != seg[-1]["total"]:
                    raise ValueError(f"{batch.column(0)[at].as_py()} has missing or surplus segments")
                yield pa.RecordBatch.from_arrays([pa.array([seg[0]["head"]] * copies, pa.string()), pa.array([block] * copies, pa.binary())], ["head", "block"])

    joined = parts.mapInArrow(join, "head string, block binary")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(at, 64).to_pylist():
                    h = json.loads(r["head"])
                    payload = dechunk(r["block"]) if h["warc-type"] == "response" else None
                    digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                    if payload is not None and (sha1_base32(payload) != digest or len(payload) != size):
                        raise ValueError(f"{h['warc-record-id']}: the payload is not what was written")
                    rows.append({"page_id": json.loads(h["x-page"]), "url": json.loads(h.get("warc-target-uri", "null")), "record_type": h["warc-type"], "refers_to": json.loads(h.get("x-refers-to-page", "null")), "payload_bytes": size, "payload_digest": digest, "payload": payload})
                yield pa.RecordBatch.from_pylist(rows, PAGE)

    return whole.unionByName(joined).mapInArrow(decode, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


RAW = pa.schema([("origin", pa.string()), ("seg", pa.int64()), ("total", pa.int64()), ("head", pa.string()), ("block", pa.binary())])
PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
