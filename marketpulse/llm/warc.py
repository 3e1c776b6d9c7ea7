"""Web archive files: written by built-in expressions, read back with segment reassembly and chunk decoding.

A page is an HTTP response in chunked framing. Long blocks are cut into segments: a response record with segment number 1 and
continuation records that name it as their origin. Payloads of some length that repeat are written once; the others revisit.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.session import configure, materialize, scratch_path

LEAST_REVISIT = 100
#: Characters of a chunk and of a segment; what is stated in the files are bytes.
CHUNK_CHARS, SEGMENT_CHARS = 4096, 16_384
RECORDS_PER_FILE = 1000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
#: Records that are no captured pages.
NO_PAGES = ("warcinfo", "request", "metadata", "resource", "conversion")
_RECORDS = "record_id string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, segment int, total long, block binary, problem string"
_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, problem string"


def first_of_equal(pages: DataFrame) -> DataFrame:
    """digest, first: the smallest page_id of payloads of at least LEAST_REVISIT bytes that occur more than once."""
    narrow = pages.select("page_id", F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("digest"))
    equal = narrow.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return equal.where("n > 1").drop("n")


def write_warc(pages: DataFrame, path: str) -> None:
    """Write one capture per row of pages (page_id, url, html) as gzipped WARC 1.1 files of at most RECORDS_PER_FILE records.

    Null html is an empty payload, a null url or page_id an empty one; line breaks in a url become spaces. Payloads are equal
    by SHA-256. Of equal ones of LEAST_REVISIT bytes or more the smallest page_id is the response, in every row that has it;
    if none has an id, all are. Other columns are not read.
    """
    configure(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    equal = broadcast_if_small(materialize(first_of_equal(pages), "equal-payloads"))
    rows = pages.withColumn("digest", F.sha2("payload", 256)).join(equal, "digest", "left")
    rows = rows.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    name = F.concat(F.lit("<urn:page:"), number, F.lit(":"), F.col("digest"), F.lit(">"))
    pieces = lambda whole, size: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(whole) / size).cast("int") - 1)),
        lambda i: F.substring(whole, i * size + 1, F.lit(size)))
    rows = rows.withColumn("chunks", F.when(~F.col("revisit") & (F.col("payload") != ""), pieces(F.col("payload"), CHUNK_CHARS)))
    framed = F.transform("chunks", lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit("\r\n"), c, F.lit("\r\n")))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = F.when(F.col("revisit"), F.concat(F.lit(http + "Content-Length: "), F.octet_length("payload").cast("string"), F.lit(END))).otherwise(
        F.concat(F.lit(http + "Transfer-Encoding: chunked" + END), F.array_join(F.coalesce(framed, F.array().cast("array<string>")), ""), F.lit("0" + END)))
    rows = rows.select(name.alias("name"), F.coalesce(F.regexp_replace("url", "[\r\n]+", " "), F.lit("")).alias("url"), "digest", "first", "revisit", block.alias("block"))
    rows = rows.select("*", F.octet_length("block").alias("total"), F.posexplode(pieces(F.col("block"), SEGMENT_CHARS)).alias("no", "piece"),
                       F.greatest(F.lit(1), F.ceil(F.length("block") / SEGMENT_CHARS)).alias("segments"))
    segmented, later = F.col("segments") > 1, F.col("no") > 0
    kind = F.when(F.col("revisit"), "revisit").when(later, "continuation").otherwise("response")
    number = (F.col("no") + 1).cast("string")
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), F.when(later, F.concat(F.expr("left(name, length(name) - 1)"), F.lit(":"), number, F.lit(">"))).otherwise(F.col("name"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.lit(f"WARC-Date: {DATE}"),
        F.when(~later, F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(":"), F.col("digest"), F.lit(">"))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(segmented, F.concat(F.lit("WARC-Segment-Number: "), number)),
        F.when(segmented & later, F.concat(F.lit("WARC-Segment-Origin-ID: "), F.col("name"))),
        F.when(segmented & (F.col("no") + 1 == F.col("segments")), F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("total").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("piece").cast("string")))
    # The two line ends that close a record are the text writer's line separator.
    rows.select(F.concat(head, F.lit(END), F.col("piece")).alias("value")).write.option("lineSep", END).option(
        "maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def decode_chunked(body: bytes) -> tuple[bytes, str | None]:
    """Payload of a chunked body, and what is wrong with its framing, if anything. Fields after the last chunk are left out."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        digits = body[at:end].split(b";")[0].strip(b" \t") if end > at else b""
        if not digits or len(digits) > 15 or digits.strip(b"0123456789abcdefABCDEF"):
            return b"".join(out), "bad chunk"
        size = int(digits, 16)
        if size == 0:
            fields = body[end:].removesuffix(b"\r\n").removeprefix(b"\r\n")
            if not body.endswith(b"\r\n", end + 2) or any(b":" not in line for line in fields.split(b"\r\n")[:-1]) or fields and not fields.endswith(b"\r\n"):
                return b"".join(out), "bytes after the last chunk" if body.startswith(b"\r\n", end + 2) else "bad chunk"
            return b"".join(out), None
        if end + 4 + size > len(body) or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return b"".join(out), "bad chunk"
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _whole_number(text: str) -> int | None:
    return int(text) if text.isascii() and text.isdigit() and len(text) <= 18 else None


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.decode(errors="replace").partition(":") for line in lines)}


def unzipped(data: bytes) -> tuple[bytes, str | None]:
    """What a gzipped file of one or more members holds, as far as it can be read, and what is wrong with it."""
    out = []
    while data:
        member, at = zlib.decompressobj(wbits=31), 0
        while at < len(data) and not member.eof:
            before, piece = member.copy(), data[at : at + (1 << 16)]
            try:
                out.append(member.decompress(piece))
            except zlib.error:  # what lies before the fault is good, such as all of it before a wrong checksum
                try:
                    for i in range(len(piece)):
                        out.append(before.decompress(piece[i : i + 1]))
                except zlib.error:
                    pass
                return b"".join(out), "bad gzip"
            at += 1 << 16
        if not member.eof:
            return b"".join(out), "gzip breaks off"
        data = (member.unused_data + data[at:]).lstrip(b"\0")
    return b"".join(out), None


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").split(":")[0]
    size = _whole_number(number.removeprefix("-"))
    return None if size is None else -size if number.startswith("-") else size


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of whole files. A file that breaks off, or is no archive, gives a row with the problem after those of what could be read."""
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("segment", pa.int32()), ("total", pa.int64()),
                        ("block", pa.binary()), ("problem", pa.string())])
    for batch in batches:
        for content in batch.column(0):
            data, at, rows, broken = content.as_py(), 0, [], None
            if data[:2] == b"\x1f\x8b":
                data, broken = unzipped(data)
            while at < len(data):
                end = data.find(b"\r\n\r\n", at)
                lines = data[at:end].split(b"\r\n") if end >= 0 else [b""]
                fields = _fields(lines[1:])
                length = _whole_number(fields.get("content-length", ""))
                if lines[0] not in VERSIONS or length is None or end + 8 + length > len(data):
                    broken = broken or "broken file"
                    break
                block = data[end + 4 : end + 4 + length]
                at = end + 8 + length
                kind = fields.get("warc-type")
                if kind in NO_PAGES:
                    continue
                origin = fields.get("warc-segment-origin-id", fields.get("warc-record-id", ""))
                segment = _whole_number(fields.get("warc-segment-number", "0"))
                row = dict(record_id=origin, page_id=_page(origin), record_type=kind, block=block,
                           payload_digest=fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                           segment=segment if segment is not None and segment < 1 << 31 else 0)
                if segment is None or segment >= 1 << 31:
                    row["problem"] = "bad segment number"
                elif kind not in ("response", "revisit", "continuation"):
                    row["problem"] = "unknown record type"
                if "warc-segment-total-length" in fields:
                    row["total"] = _whole_number(fields["warc-segment-total-length"])
                    if row["total"] is None:
                        row["problem"] = "bad total length"
                if kind == "revisit":
                    head = _fields(block.split(b"\r\n"))
                    row |= dict(payload_bytes=_whole_number(head.get("content-length", "0")), refers_to=_page(fields.get("warc-refers-to", "")), block=None)
                rows.append(row)
            if broken:
                rows.append(dict(record_id=f"broken at {at}", segment=0, problem=broken))
            for i in range(0, len(rows), 500):
                yield pa.RecordBatch.from_pylist(rows[i : i + 500], schema=schema)


def _finish(parts: list[dict], keep_payload: bool) -> list[dict]:
    """Pages of the records of one origin, ordered by segment; more than one only if a record is there more than once."""
    first = next((p for p in parts if p["record_type"] != "continuation"), parts[0])
    first = dict(first, problem=next((p["problem"] for p in parts if p["problem"]), None))
    out = dict(page_id=first["page_id"], payload_bytes=first["payload_bytes"], payload_digest=first["payload_digest"],
               record_type=first["record_type"], refers_to=first["refers_to"], payload=None, problem=first["problem"])
    copies = sum(p["segment"] == first["segment"] for p in parts)
    if first["record_type"] == "revisit" or first["problem"]:
        return [out] * copies
    blocks = {p["segment"]: p["block"] for p in parts}
    block = b"".join(blocks[k] for k in sorted(blocks))
    stated = next((p["total"] for p in parts if p["total"] is not None), None)
    if first["record_type"] == "continuation" or (len(blocks) > 1 or 1 in blocks) and sorted(blocks) != list(range(1, len(blocks) + 1)):
        out["problem"] = "segment missing"
    elif 1 in blocks and stated is None:
        out["problem"] = "last segment missing"
    elif stated is not None and stated != len(block):
        out["problem"] = "wrong total length"
    else:
        head, _, body = block.partition(b"\r\n\r\n")
        payload, out["problem"] = decode_chunked(body) if b"transfer-encoding: chunked" in head.lower() else (body, None)
        digest = hashlib.sha256(payload).hexdigest()
        if out["problem"] is None and out["payload_digest"] not in (None, digest):
            out["problem"] = "wrong digest"
        out |= dict(payload_bytes=len(payload), payload_digest=digest, payload=payload if keep_payload else None)
    return [out] * copies


def _assemble(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())])
        parts: list[dict] = []
        for batch in batches:
            done: list[dict] = []
            for row in batch.to_pylist():
                if parts and parts[0]["record_id"] != row["record_id"]:
                    done += _finish(parts, keep_payload)
                    parts = []
                parts.append(row)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if parts:
            yield pa.RecordBatch.from_pylist(_finish(parts, keep_payload), schema=schema)

    return run


def read_warc(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """Per captured page: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null unless asked for, or a
    revisit), problem (null if the record is whole and its length, framing and digest are right).

    Continuation records are grouped by their origin, put in order by segment number, checked against the stated total length and
    decoded from chunked framing. Only one page's segments meet in memory. Files are plain or gzipped, of one member or many. What cannot be read
    does not stop the others: a file that breaks off or is damaged gives a row with the problem, and so does a record whose numbers or
    type make no sense. Records of other types (requests, metadata, descriptions of the file) are no pages and give no row. No files: no rows.
    """
    files = configure(spark).read.format("binaryFile").load(path).select("content")
    records = files.mapInArrow(_parse, _RECORDS)
    ordered = records.repartition("record_id").sortWithinPartitions("record_id", "segment")
    return ordered.mapInArrow(_assemble(keep_payload), _PAGES)


def round_trip(pages: DataFrame) -> DataFrame:
    """What a reader of the archives written from these pages finds, without the payloads."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path).drop("payload")
