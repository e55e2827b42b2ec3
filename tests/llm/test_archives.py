from __future__ import annotations

import base64
import gzip
import hashlib
from collections import Counter

import duckdb
import pytest

from flowsieve.llm.archives import (
    ARC_FIELDS, ORACLE, arc_record, arc_start, convert_record, index_arcs, op9_archives, read_arc, read_warc, write_arcs,
)


def test_versions_are_read_by_their_own_definition() -> None:
    block = b"HTTP/1.0 200 OK\r\nX-Page-Id: 4\r\n\r\n<p>\nbody\n"
    for version in ARC_FIELDS:
        data = arc_start("a.arc", version) + arc_record("a.arc", version, 9, "http://x/a b", "text/html", block)
        data += arc_record("a.arc", version, 9, "dns:x", "text/dns", b"")
        for form in (data, gzip.compress(data)):
            first, page, dns = read_arc(form)
            assert first.fields["URL"] == "filedesc://a.arc" and page.block == block and dns.block == b""
            assert page.fields["URL"] == "http://x/a%20b" and list(page.fields) == ARC_FIELDS[version].split()


def test_bad_archives_are_errors() -> None:
    good = arc_start("a.arc", 1) + arc_record("a.arc", 1, 0, "u", "t", b"12345")
    for bad in (good[:-2], good.replace(b"1 0 archive", b"7 0 archive"), good.replace(b" 5\n", b" x\n")):
        with pytest.raises(ValueError):
            list(read_arc(bad))


def test_synthesised_fields() -> None:
    data = arc_start("a.arc", 2) + arc_record("a.arc", 2, 0, "http://x/", "text/html", b"HTTP/1.0 200 OK\r\n\r\nbody", "19970203040506")
    data += arc_record("a.arc", 2, 0, "dns:x", "text/dns", b"raw")
    info, page, raw = (list(read_warc(convert_record(r, "a.arc")))[0] for r in read_arc(data))
    assert info[0]["WARC-Type"] == "warcinfo"
    assert page[0]["WARC-Type"] == "response" and page[0]["WARC-Date"] == "1997-02-03T04:05:06Z"
    assert page[0]["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    assert raw[0]["WARC-Type"] == "resource" and raw[0]["Content-Type"] == "text/dns"
    assert len({x[0]["WARC-Record-ID"] for x in (info, page, raw)}) == 3
    (fields, block), = read_warc(convert_record([*read_arc(data)][1], "a.arc", ("key", "12")))
    assert fields["WARC-Type"] == "revisit" and fields["X-Refers-To-Page"] == "12" and block == b"HTTP/1.0 200 OK\r\n\r\n"


def brute(rows: list[tuple]) -> Counter:
    ids: dict[str, int] = {}
    for i, _, html, *_ in rows:
        if i is not None:
            ids[html or ""] = min(i, ids.get(html or "", i))
    out, stored = Counter(), set()
    for i, _, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        first = data not in stored and (i == ids.get(html or ""))
        stored |= {data} if first else set()
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out[i, len(data), sha, "response" if first else "revisit", None if first else ids.get(html or "")] += 1
    return out


def test_query(spark, tables) -> None:
    rows = [(i, f"http://h/{i}?a=b c", f"<p>é {i % 7}</p>\r\n\r\n" * (i % 5), "x") for i in range(50, 0, -1)]
    rows += [(60, None, None, "x"), (61, "", "", "x"), (62, "u\nv", "big " * 200_000, "y"), (3, "again", "<p>é 3</p>\r\n\r\n" * 3, "z"), (None, "n", "<p>é 3</p>\r\n\r\n" * 3, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(5)
    assert Counter(tuple(r) for r in op9_archives(spark, tables(pages=pages)).collect()) == brute(rows)
    assert op9_archives(spark, tables(pages=pages.where("false"))).collect() == []


def test_one_payload_in_half_of_the_rows(spark, tables) -> None:
    rows = [(i, f"http://h/{i}", "" if i % 2 else f"page {i}", "x") for i in range(5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first string").repartition(6)
    assert Counter(tuple(r) for r in op9_archives(spark, tables(pages=pages)).collect()) == brute(rows)


def test_files_are_bounded(spark, tmp_path) -> None:
    pages = spark.createDataFrame([(i, "u", "x" * 1000) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    arcs = write_arcs(pages, str(tmp_path), arc_bytes=10_000)
    assert arcs.count() == 5
    assert index_arcs(arcs, str(tmp_path)).count() == 40


def test_oracle(spark) -> None:
    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    expected = con.sql(ORACLE).fetchall()
    names = [d[0] for d in con.sql(ORACLE).description]
    found = op9_archives(spark, "/root/testdata/sf0.01").select(*names).collect()
    assert Counter(map(tuple, found)) == Counter(expected)
