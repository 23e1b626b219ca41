from __future__ import annotations

import hashlib

import pytest

from lexitide.llm import warc
from lexitide.llm.common import Scratch
from tests import oracle


def arcs():
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>\n\nHTTP/1.0 fake\r\n\r\n"
    return [
        warc.Arc("http://a.example/x y", "1.2.3.4", "20010203040506", "text/html", http),
        warc.Arc("dns:a.example", "1.2.3.4", "20010203", "text/dns", b"20010203\na.example. 300 IN A 1.2.3.4\n"),
        warc.Arc("ftp://a.example/f", "0.0.0.0", "20010203040506", "application/octet-stream", bytes(range(256)) * 3),
        warc.Arc("http://a.example/empty", "1.2.3.4", "20010203040506", "no-type", b""),
    ]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines_by_version(version):
    data = warc.write_arc(arcs(), version)
    got = list(warc.parse_arc(data))
    assert got[0].url.startswith("filedesc://") and len(got) == 5
    for a, b in zip(arcs(), got[1:], strict=True):
        assert (b.url, b.ip, b.date, b.type, b.body, b.version, b.truncated) == (a.url.replace(" ", "%20"), a.ip, a.date, a.type, a.body, version, False)
    assert (got[1].extra.get("status") == "200") == (version == 2)


def test_url_with_spaces_junk_lines_and_truncation():
    head = b"filedesc://x.arc 0.0.0.0 19990101 text/plain 9\n1 0 test\n\n"
    data = head + b"http://a b c/ 1.2.3.4 19990101 text/html 5\nhello\njunk that is no header\n\nhttp://d/ 1.2.3.4 19990101 text/html 50\nshort"
    got = list(warc.parse_arc(data))
    assert [(r.url, r.body, r.truncated) for r in got[1:]] == [("http://a b c/", b"hello", False), ("http://d/", b"short", True)]
    assert list(warc.parse_arc(b"")) == [] and list(warc.parse_arc(b"no line end")) == []


@pytest.mark.parametrize("version", [1, 2])
def test_warc_records_read_back(version):
    records = list(warc.parse_arc(warc.write_arc(arcs(), version)))
    data = b"".join(warc.to_warc(r) + warc.END.encode() for r in records)
    got = list(warc.read_warc(data))
    assert [h["WARC-Type"] for h, _ in got] == ["warcinfo", "response", "response", "resource", "resource"]
    for r, (h, block) in zip(records[1:], got[1:], strict=True):
        assert block == r.body and h["WARC-Target-URI"] == r.url and h["WARC-IP-Address"] == r.ip
        assert h["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(warc.split_http(r.body)[1]).hexdigest()
        assert h["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
    assert got[2][0]["WARC-Date"] == "2001-02-03T00:00:00Z" and got[1][0]["WARC-Date"] == "2001-02-03T04:05:06Z"
    assert len({h["WARC-Record-ID"] for h, _ in got}) == 5
    assert [warc.to_warc(r) for r in records] == [warc.to_warc(r) for r in records]


def test_edge_pages(spark, tmp_path):
    body = "x" * 200 + "WARC/1.1\r\n\r\n\r\n\r\nWARC-Type: response\r\n" + "é" * 40
    data = [(5, "http://a/", body), (3, "http://b/", body), (9, None, body), (3, "http://b/", body), (1, "http://c/", None), (2, "http://d/", ""), (4, "http://e/", "short"), (6, "http://e/", "short"), (7, "bad\r\nurl x", body + "!"), (None, "http://n/", body), (None, None, None), (8, "http://long/", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "own", 1) for r in data], "page_id long, url string, html string, head string, digest int").repartition(4)
    scratch = Scratch(spark, "t")
    warc.write_pages(pages, scratch.path("archive"), scratch)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_pages(spark, scratch.path("archive")).collect()), key=str)
    want = []
    for page, _, html in data:
        b = (html or "").encode()
        revisit = html == body and page != 3
        want.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    scratch = Scratch(spark, "t")
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), scratch.path("archive"), scratch)
    assert warc.read_pages(spark, scratch.path("archive")).count() == 0


def test_matches_sql(spark):
    assert oracle.differences(warc.op3(spark, oracle.DATA), oracle.connect(), warc.ORACLES["op3_warc"]) == []


def test_a_page_may_look_like_a_version_block(spark):
    """Any url is a page's own; every page keeps its payload and its id."""
    urls = ["http://a/", "filedesc://x", "filedesc://pages.arc 0.0.0.0 20240101000000 text/plain 12", "dns:x", None, "filedesc:y\n1 0 z"]
    data = [(i, u, f"{i} " + "z" * 150) for i, u in enumerate(urls)]
    scratch = Scratch(spark, "t")
    warc.write_pages(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1), scratch.path("archive"), scratch)
    got = {r["page_id"]: (r["payload_digest"], r["record_type"]) for r in warc.read_pages(spark, scratch.path("archive")).collect()}
    assert got == {i: (hashlib.sha256(t.encode()).hexdigest(), "response") for i, _, t in data}


def test_joined_archives_have_two_version_blocks():
    got = list(warc.parse_arc(warc.write_arc(arcs(), 1) + warc.write_arc(arcs(), 2)))
    assert [r.head for r in got] == [True, *[False] * 4] * 2
    assert [r.version for r in got] == [1] * 5 + [2] * 5


def test_files_are_bounded_by_bytes(spark, tmp_path):
    data = [(i, f"http://{i}/", f"{i} " + "y" * 30_000) for i in range(60)]
    path = f"file://{tmp_path}/archive"
    warc.write_pages(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(2), path, Scratch(spark, "t"), file_bytes=100_000)
    sizes = [f.stat().st_size for f in (tmp_path / "archive").glob("part-*")]
    assert len(sizes) >= 12 and max(sizes) < 140_000
    assert sorted(r["page_id"] for r in warc.read_pages(spark, path).collect()) == list(range(60))
