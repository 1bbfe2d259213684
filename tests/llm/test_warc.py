import base64
import gzip
import hashlib

import pytest

from stylograin.llm import warc
from stylograin.session import scratch_path

EMPTY = "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def converted(spark, pages, **how):
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    warc.write_arc(pages, arc, archive_bytes=how.pop("archive_bytes", warc.ARCHIVE_BYTES))
    warc.convert(spark, arc, out, **how)
    return warc.read_warc(spark, out)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string, record_type string").select("*")


def test_digest_of_nothing():
    assert warc.digest(b"") == EMPTY == base64.b32encode(hashlib.sha1(b"").digest()).decode()


def test_conversion_and_reading_back(spark):
    html = [(1, "http://a/ b\n", "same"), (5, None, "same"), (3, "http://c", "same"), (2, "http://d", None), (4, "http://e", ""),
            (6, "http://f", "alone\r\n\r\nWARC/1.1\r\n\r\nfiledesc: ü"), (None, "http://g", "alone\r\n\r\nWARC/1.1\r\n\r\nfiledesc: ü"),
            (7, "http://h", "x" * 5000), (7, "http://h", "x" * 5000)]
    rows = converted(spark, pages(spark, [(k, u, h, None, None) for k, u, h in html]), archive_bytes=300).collect()
    assert len(rows) == len(html) and all(r.intact for r in rows)
    assert len({r.record_id for r in rows}) == len(html)
    got = sorted((r.key or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_key) for r in rows)
    last = {"same": 5, "": 4, "alone\r\n\r\nWARC/1.1\r\n\r\nfiledesc: ü": 6, "x" * 5000: 7}
    want = []
    for k, _, h in html:
        body = (h or "").encode()
        response = k == last[h or ""]
        want.append((k or 0, len(body), warc.digest(body), "response" if response else "revisit", None if response else last[h or ""]))
    want.remove((7, 5000, warc.digest(b"x" * 5000), "response", None))  # of equal keys one record stays a response
    want.append((7, 5000, warc.digest(b"x" * 5000), "revisit", 7))
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = {r.key: r.payload for r in rows if r.record_type == "response"}
    assert bytes(whole[6]) == "alone\r\n\r\nWARC/1.1\r\n\r\nfiledesc: ü".encode()
    ids = {r.record_id for r in rows if r.record_type == "response"}
    assert all(r.refers_to in ids for r in rows if r.record_type == "revisit")
    assert {r.target_uri for r in rows} >= {"http://a/%20b%0A", "-"}


def test_small_payloads_stay_responses(spark):
    rows = converted(spark, pages(spark, [(1, "u", "ab", None, None), (2, "u", "ab", None, None)]), min_bytes=3).collect()
    assert {r.record_type for r in rows} == {"response"}


def test_no_pages(spark):
    assert converted(spark, pages(spark, [])).count() == 0


def test_header_lines_of_either_version():
    about = {v: v + b" 0 x\n" + b" ".join(warc.ARC_FIELDS[v]) + b"\n" for v in (b"1", b"2")}
    data = b""
    for v, line in ((b"1", b"http://a b 1.2.3.4 20010203 text/html 5\n"), (b"2", b"dns:x 1.2.3.4 20010203040506 text/dns 200 - - 9 f.arc 5\n")):
        data += b"filedesc://f.arc 0.0.0.0 19960101000000 text/plain %d\n" % len(about[v]) + about[v] + b"\n" + line + b"hello\n"
    records = list(warc.arc_records(data))
    assert [r.fields[b"URL"] for r in records] == [b"filedesc://f.arc", b"http://a b", b"filedesc://f.arc", b"dns:x"]
    assert [r.content for r in records[1::2]] == [b"hello"] * 2 and not any(r.truncated for r in records)
    assert warc.warc_date(b"20010203") == b"2001-02-03T00:00:00Z" and warc.warc_date(b"20010203040506") == b"2001-02-03T04:05:06Z"
    fields = dict(next(warc.warc_records(warc.warc_record("f.arc", records[3], None)))[0])
    assert fields[b"warc-type"] == b"resource" and fields[b"warc-ip-address"] == b"1.2.3.4"


def test_declared_length_beyond_the_end():
    record = list(warc.arc_records(b"http://a 0.0.0.0 20010203 text/html 50\nshort"))[0]
    assert record.truncated and record.content == b"short"
    assert b"WARC-Truncated: length" in warc.warc_record("f", record, None)


def test_what_is_no_archive():
    with pytest.raises(ValueError):
        list(warc.arc_records(b"this is no header line\n"))
    with pytest.raises(ValueError):
        list(warc.warc_records(b"nor is this"))
    assert warc._plain(gzip.compress(b"x")) == b"x" == warc._plain(b"x")
