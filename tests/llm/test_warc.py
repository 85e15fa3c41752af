import gzip
import hashlib
import io
from collections import Counter

import pytest

from weft.llm import warc
from weft.session import scratch_path

PAGE = "<html>é " + "x" * 100
ROWS = [
    (5, "http://a/ b\n", PAGE), (3, "http://a/", PAGE), (9, None, PAGE), (9, "", PAGE), (None, "http://n/", PAGE), (4, "http://s/", "short"), (6, "http://s/", "short"),
    (7, "u", None), (8, "u", ""), (10, "u", "\r\n\r\nHTTP/1.1 WARC/1.0\r\n\r\n" * 9), (11, "u", "\r\n\r\nHTTP/1.1 WARC/1.0\r\n\r\n" * 9), (12, "u", "y" * 3_000_000), (-2, "u", "a\n1 0 x\nfiledesc://" + "z" * 99),
]


def expected(rows):
    out = Counter()
    firsts = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page_id is not None:
            firsts[body] = min(page_id, firsts.get(body, page_id))
    chosen = set()
    for page_id, _, html in rows:
        body = (html or "").encode()
        first = firsts.get(body)
        again = len(body) >= 100 and first is not None and (page_id != first or (body, page_id) in chosen)
        chosen.add((body, page_id))
        out[page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_round_trip(spark, parts):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "page_id long, url string, html string, path string, digest string").repartition(parts)
    assert Counter(map(tuple, warc.archived(df).collect())) == expected(ROWS)


def test_no_rows(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE)] * 3, "page_id long, url string, html string").coalesce(1)
    got = Counter((r.record_type, r.refers_to) for r in warc.archived(df).collect())
    assert got == {("response", None): 1, ("revisit", 1): 2}


def test_both_header_versions_and_synthesised_fields(spark):
    arc = (
        b"filedesc://x.arc 0.0.0.0 20010203040506 text/plain 76\n1 0 org\nURL IP-address Archive-date Content-type Archive-length\n" + b"#" * 12 + b"\n"
        b"http://one/ 1.2.3.4 20010203040506 text/html 24\nHTTP/1.0 200 OK\r\n\r\nhello\n"
        b"filedesc://y.arc 0.0.0.0 19991231235959 text/plain 200 - - 0 y.arc 8\n2 0 org\n\n"
        b"http://two/a b 5.6.7.8 19991231235959 text/plain 200 abc - 0 y.arc 4\nplan\n\n"
    )
    body = arc.split(b"\n", 1)[1]
    head = b"filedesc://x.arc 0.0.0.0 20010203040506 text/plain %d\n" % body.index(b"\nhttp://one")
    records = list(warc.arc_records(io.BufferedReader(io.BytesIO(head + body))))
    assert [(r.url, r.ip, r.date, r.content_type) for r in records] == [("http://one/", "1.2.3.4", "20010203040506", "text/html"), ("http://two/a b", "5.6.7.8", "19991231235959", "text/plain")]
    assert [r.http for r in records] == [(b"HTTP/1.0 200 OK", b"hello"), (b"", b"plan")]
    block = warc.converted("f.arc", records[0], 0, None)
    assert b"WARC-Type: response\r\n" in block and b"WARC-Date: 2001-02-03T04:05:06Z\r\n" in block and hashlib.sha256(b"hello").hexdigest().encode() in block
    assert b"WARC-Type: resource\r\n" in warc.converted("f.arc", records[1], 1, None)
    again = warc.converted("g.arc", records[0], 3, {"path": "f.arc", "first_at": 0, "url": "http://one/", "date": "d"})
    assert warc.record_id("f.arc", 0).encode() in again and not again.endswith(b"hello")
    with pytest.raises(ValueError):
        list(warc.arc_records(io.BufferedReader(io.BytesIO(head + body[:-20]))))


def test_files_are_archives(spark):
    base = scratch_path(spark, "a")
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(2)
    warc.write_arc(df, f"{base}/arc")
    warc.convert(spark, f"{base}/arc", f"{base}/warc")
    versions, kinds = set(), Counter()
    for r in warc.listed(spark, f"{base}/arc").collect():
        versions.add(gzip.decompress(warc.open_shared(r.path).read()).split(b"\n")[1])
    for r in warc.listed(spark, f"{base}/warc").collect():
        with warc.opened(r.path) as stream:
            kinds.update(warc.header(h, "WARC-Type") for h, _ in warc.warc_records(stream))
    assert versions == {b"1 0 weft", b"2 0 weft"} and kinds == {"warcinfo": 2, "response": 8, "revisit": 5}
