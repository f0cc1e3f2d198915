"""Archives of other writers, and odd pages."""

from __future__ import annotations

import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from fairspark.llm import warc


def one(headers, block, version="WARC/1.0"):
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"{version}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def foreign():
    """Records as common crawlers write them."""
    uuid = lambda k: f"<urn:uuid:00000000-0000-4000-8000-{k:012d}>"
    basic = lambda kind, k, *more: [("WARC-Type", kind), ("WARC-Record-ID", uuid(k)), ("WARC-Date", "2020-02-03T04:05:06Z"), *more]
    http = ("Content-Type", "application/http; msgtype=response")
    page = b"HTTP/1.1 200 OK\r\nServer: x\r\nX-Long: a\r\n  b\r\nContent-Length: 5\r\n\r\nhello"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 99\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    hello = hashlib.sha1(b"hello").hexdigest()
    return [
        one(basic("warcinfo", 1, ("Content-Type", "application/warc-fields"), ("WARC-Filename", "a.warc")), b"software: x\r\nformat: WARC 1.0\r\n"),
        one(basic("request", 2, ("Content-Type", "application/http; msgtype=request"), ("WARC-Target-URI", "http://a/")), b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        one(basic("response", 3, http, ("WARC-Target-URI", "http://a/"), ("WARC-Payload-Digest", f"sha1:{hello}")), page),
        one(basic("metadata", 4, ("Content-Type", "application/warc-fields"), ("WARC-Concurrent-To", uuid(3))), b"fetchTimeMs: 7\r\n"),
        one(basic("response", 5, http, ("WARC-Target-URI", "http://b/"), ("WARC-Payload-Digest", "md5:abc")), chunked),
        one(basic("response", 6, ("Content-Type", "text/dns"), ("WARC-Target-URI", "dns:a")), b"20200203040506\na. 1 IN A 1.2.3.4\n"),
        one(basic("revisit", 7, http, ("WARC-Target-URI", "http://a/"), ("WARC-Refers-To", uuid(3)), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        one(basic("resource", 8, ("Content-Type", "image/png"), ("WARC-Target-URI", "file://x")), bytes(range(256)) * 4),
    ]


def test_archives_of_others(spark, tmp_path):
    records = foreign()
    compress = zstandard.ZstdCompressor().compress
    raw = warc.train_dictionary([r * 200 + bytes([i]) * 9000 for i, r in enumerate(records * 3)]).as_bytes()
    with_dictionary = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress
    squeezed = compress(raw)
    (tmp_path / "plain.warc.zst").write_bytes(b"".join(map(compress, records)))
    (tmp_path / "shared.warc.zst").write_bytes(struct.pack("<II", 0x184D2A5D, len(squeezed)) + squeezed + b"".join(map(with_dictionary, records)))
    rows = warc.read_archives(spark, f"file://{tmp_path}", payloads=True).collect()
    assert len(rows) == 16
    own = {r.record_id[-1]: r for r in rows}
    assert [own[str(k)].record_type for k in range(1, 9)] == ["warcinfo", "request", "response", "metadata", "response", "response", "revisit", "resource"]
    assert bytes(own["3"].payload) == b"hello"
    assert own["3"].payload_digest == hashlib.sha1(b"hello").hexdigest()
    assert bytes(own["5"].payload).startswith(b"5\r\nhello")
    assert bytes(own["6"].payload).startswith(b"2020")
    assert (own["7"].payload, own["7"].refers_to_id[-1], own["7"].refers_to, own["7"].payload_digest) == (None, "3", None, None)
    assert own["8"].payload_bytes == 1024
    assert own["8"].payload_digest == warc.sha1_base32(bytes(range(256)) * 4)
    assert all(r.page_id is None for r in rows)


def test_faults_of_others():
    records = foreign()
    for broken in (records[2].replace(b"hello", b"hullo"), records[2].replace(b"Content-Length: 5", b"Content-Length: 6"), records[6].replace(b"WARC-Refers-To", b"X-Other"), records[0].replace(b"WARC-Date", b"X-Date"), records[3][:-1], records[1].replace(b"HTTP/1.1", b"HT")):
        with pytest.raises(warc.WarcError):
            warc.parse(broken)


def test_odd_pages(spark, monkeypatch):
    """Repeated rows, a payload of many pages, a very long one, and columns with the names of helpers."""
    from fairspark.llm import _spark

    monkeypatch.setattr(_spark, "MANY", 3)
    monkeypatch.setattr(_spark, "SHARE", 20)
    rows = [(i, "u", "same") for i in range(10, 40)] + [(1, "v", "é" * 400_000), (2, "v", "é" * 400_000), (3, None, None), (4, None, ""), (5, "w", "own"), (5, "w", "own"), (6, "w", "own"), (None, "x", "own")]
    pages = spark.createDataFrame([(*r, 1, 2, 3, 4, "s") for r in rows], "page_id long, url string, html string, key int, size int, n int, first int, revisit string")
    out = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    first = {}
    for page, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", page)
    expected = [(p or 0, len((h or "").encode()), *(("response", None) if p == first[h or ""] else ("revisit", first[h or ""]))) for p, _, h in rows]
    assert out == sorted(expected, key=str)
    assert warc.with_references(pages, 5).where(F.col("html") == "own").agg(F.count_if("revisit")).first()[0] == 0
