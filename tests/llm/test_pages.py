"""URL filter and archive."""

import base64
import hashlib

from numberboard.llm import url_filter, warc

PAGES = "page_id long, url string, html string, host string, verdict string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "v", "d") for r in rows], PAGES)


def canonical(url):
    return f'<html><head><LINK href="{url}" Rel=canonical></head></html>'


def verdicts(spark, rows):
    return {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_pages(pages(spark, rows)).collect()}


def test_blocks_reach_aliases_and_rules_come_first(spark):
    found = verdicts(
        spark,
        [
            (1, "https://a.org/x", canonical("http://b.net/es/1")),  # alias of a blocked page
            (2, "https://b.net/es/1?q", None),  # another query, another page
            (3, "HTTP://C.ORG/y#top", '<meta http-equiv="refresh" content="0; url=//a.org/x">'),  # a chain of aliases
            (4, "http://d.com/x", canonical("http://b.net/fr/2")),  # its own rule allows
            (5, "http://e.org/", canonical("http://d.com/x")),  # an explicitly allowed alias goes before a blocked one
            (6, "http://www.example.com/en/1", ""),
            (7, "http://m.example.com/en/1", "<link rel=stylesheet href=http://b.net/es/1>"),
            (8, "http://notexample.com/en/1", None),
            (9, "http://x.net", canonical("/es/9")),
        ],
    )
    assert found == {
        1: (None, "block"),
        2: ("net/es/", "block"),
        3: (None, "block"),
        4: ("com/", "allow"),
        5: (None, "allow"),
        6: ("www.example.com/en/", "allow"),
        7: ("example.com/en/", "block"),
        8: ("com/", "allow"),
        9: (None, "block"),
    }


def test_odd_urls(spark):
    rows = [(1, None, None), (1, None, None), (2, "", ""), (3, "no scheme/en/", canonical("")), (None, "x://Ü.NET/ES/", None), (4, "a://b://c/d?e#f", None)]
    found = url_filter.judge_pages(pages(spark, rows)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(
        [
            (1, "", "", None, "allow"),
            (1, "", "", None, "allow"),
            (2, "", "", None, "allow"),
            (3, "", "", None, "allow"),
            (None, "Ü.net", "/ES/", None, "allow"),
            (4, "b:", "//c/d", None, "allow"),
        ],
        key=repr,
    )
    assert url_filter.judge_pages(pages(spark, [])).count() == 0


def test_archive_index(spark):
    rows = [(1, "u1", "same"), (5, "u\r\n5", "same"), (3, None, "same"), (2, "u2", None), (4, "u4", ""), (6, "u6", "é"), (7, "u7", "x"), (7, "u7", "x")]
    found = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages(spark, rows)).collect()}

    def label(text):
        return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()

    assert found == {
        (1, 4, label("same"), "revisit", 5),
        (5, 4, label("same"), "response", None),
        (3, 4, label("same"), "revisit", 5),
        (2, 0, label(""), "revisit", 4),
        (4, 0, label(""), "response", None),
        (6, 2, label("é"), "response", None),
        (7, 1, label("x"), "response", None),
    }
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_records_are_rebuilt_and_small_ones_are_responses(spark, tmp_path):
    rows = [(1, "http://a/", b"tiny"), (2, "http://b/", b"tiny"), (3, "http://c/", b"long enough"), (4, None, b"long enough")]
    records = spark.createDataFrame(rows, "record_id long, url string, payload binary")
    warc.write_archive(records, str(tmp_path / "a"), min_bytes=8)
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 2
    found = {r["record_id"]: (r["record_type"], bytes(r["record"]).decode()) for r in warc.rebuild(spark, str(tmp_path / "a")).collect()}
    assert {k: v[0] for k, v in found.items()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    head, _, block = found[2][1].partition("\r\n\r\n")
    assert block == "tiny\r\n\r\n" and "WARC-Target-URI: http://b/" in head and "Content-Length: 4" in head
    assert found[3][1].endswith("Content-Length: 0\r\n\r\n\r\n\r\n") and "WARC-Refers-To: <urn:page:4>" in found[3][1]


def test_a_spoilt_payload_stops_the_job(spark, tmp_path):
    import pytest

    spark.createDataFrame([(bytearray(32), 1, bytearray(b"x"))], warc.PAYLOADS_SCHEMA).write.parquet(str(tmp_path / "a/payloads"))
    with pytest.raises(Exception, match="digest"):
        warc.read_payloads(spark, str(tmp_path / "a")).collect()
