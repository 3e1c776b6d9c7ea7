"""The archive reader on damaged and foreign files, and the query against plain Python."""

import gzip
import hashlib

import pytest

from marketpulse.llm import queries, warc


def record(kind="response", block=b"HTTP/1.1 200 OK\r\n\r\nhello", name="<urn:page:1:x>", version=b"WARC/1.1", **more):
    fields = {"WARC-Type": kind, "WARC-Record-ID": name, "Content-Length": str(len(block))} | {k.replace("_", "-"): v for k, v in more.items()}
    lines = [version, *[(k.encode() + (b":" if k == "X-Bare" else b": ") + (v if isinstance(v, bytes) else v.encode())) for k, v in fields.items() if v is not None]]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def cut_crc(data):
    packed = bytearray(gzip.compress(data))
    packed[-5] ^= 0xFF
    return bytes(packed)


GOOD = record()
CASES = {
    "members": (gzip.compress(GOOD) + gzip.compress(record(name="<urn:page:2:x>")), [(1, None), (2, None)]),
    "truncated": (gzip.compress(GOOD * 1)[:-12], None),
    "checksum": (cut_crc(GOOD), [(1, None), (None, "bad gzip")]),
    "old version": (record(version=b"WARC/1.0"), [(1, None)]),
    "no archive": (b"<html>", [(None, "broken file")]),
    "foreign": (record("warcinfo", b"software: x", "<a>") + GOOD + record("request", b"GET /", "<b>"), [(1, None)]),
    "segment": (record(WARC_Segment_Number="one"), [(1, "bad segment number")]),
    "big segment": (record(WARC_Segment_Number="9" * 30), [(1, "bad segment number")]),
    "digit": (record(WARC_Segment_Number="²"), [(1, "bad segment number")]),
    "total": (record(WARC_Segment_Number="1", WARC_Segment_Total_Length="x"), [(1, "bad total length")]),
    "no type": (record(None), [(1, "unknown record type")]),
    "bytes": (record(X_Other=b"\xff\xfe") + record(name="<urn:page:3:x>"), [(1, None), (3, None)]),
    "length": (record(Content_Length="-5"), [(None, "broken file")]),
    "page": (record(name="<urn:page:" + "9" * 40 + ":x>"), [(None, None)]),
    "half": (GOOD + record(name="<urn:page:2:x>")[:-9], [(1, None), (None, "broken file")]),
    "empty": (b"", []),
}


def test_damaged_and_foreign_files(spark, tmp_path):
    for name, (data, wanted) in CASES.items():
        path = tmp_path / f"{name}.warc"
        path.write_bytes(data)
        rows = sorted(((r["page_id"], r["problem"]) for r in warc.read_warc(spark, str(path)).collect()), key=str)
        # What could be unzipped before a break may hold whole records.
        assert rows[-1:] == [(None, "gzip breaks off")] if wanted is None else rows == sorted(wanted, key=str), name


@pytest.mark.parametrize("body, payload, problem", [
    (b"3\r\nabc\r\n0\r\n\r\n", b"abc", None), (b"3;x=1\r\nabc\r\n0\r\nX-Sum: 1\r\nY: 2\r\n\r\n", b"abc", None), (b"0\r\n\r\n", b"", None),
    (b"0x3\r\nabc\r\n0\r\n\r\n", b"", "bad chunk"), (b"+3\r\nabc\r\n0\r\n\r\n", b"", "bad chunk"), (b"3\r\nabc\r\n", b"abc", "bad chunk"),
    (b"3\r\nabc\r\n0\r\n", b"abc", "bad chunk"), (b"0\r\n\r\nmore", b"", "bytes after the last chunk"), (b"3\r\nabcd\r\n0\r\n\r\n", b"", "bad chunk"),
    (b"", b"", "bad chunk"), (b"A\r\n0123456789\r\n00\r\n\r\n", b"0123456789", None), (b"0\r\nno field\r\n\r\n", b"", "bad chunk")])
def test_chunks(body, payload, problem):
    assert warc.decode_chunked(body) == (payload, problem)


def test_query_against_plain_python(spark, sf_dir):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in queries.table(spark, sf_dir, "pages").collect()]
    first = {}
    for page, payload in sorted(pages):
        if len(payload) >= 100:
            first.setdefault(payload, page)
    wanted = [(page, len(payload), hashlib.sha256(payload).hexdigest(), "response" if first.get(payload, page) == page else "revisit",
               first[payload] if first.get(payload, page) != page else None, None) for page, payload in pages]
    found = queries.op9_warc_segments(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
