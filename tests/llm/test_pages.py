"""Operators on pages: archives and their index, URL rules."""

import random

import pytest
from pyspark.sql import functions as F

from tonearm.llm import urls, warc

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(8)
    rows = [(i, f"https://h{rng.randrange(5)}.example.org/{rng.randrange(3)}?q={rng.randrange(3)}", f"<p>{rng.randrange(20)}</p>\r\n\r\n" * rng.randrange(3))
            for i in range(400)]
    rows += [(1000, None, None), (1001, "no scheme", "é\r\n\r\nWARC/1.0\r\n"), (None, "http://x.net", "é\r\n\r\nWARC/1.0\r\n"), (5, "http://x.net/a b\r\nX: y", rows[5][2]),
             (5, rows[5][1], rows[5][2]), (1002, "HTTP://User@WWW.Example.Org:80/%7E?#f", "x" * 300_000)]
    return spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1)).withColumn("rank", F.lit(2))


def test_index(spark, pages):
    folder = warc.write_archives(pages, records_per_archive=37)
    got = warc.merged_index(spark, folder, run_rows=50, chunk_rows=4, ranges=6).collect()
    assert len(got) == pages.count()
    rows = sorted(got, key=lambda r: (r["range"], r["place"]))
    order = [(r["urlkey"], r["captured"], warc.LAST if r["page_id"] is None else r["page_id"]) for r in rows]
    assert order == sorted(order) and len({r["range"] for r in rows}) > 2
    texts = {}
    for r in pages.collect():
        texts.setdefault(r["html"] or "", []).append(warc.LAST if r["page_id"] is None else r["page_id"])
    of = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    for r in got:
        first = min(texts[of[r["page_id"]]])
        own = warc.LAST if r["page_id"] is None else r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if own == first else ("revisit", first))
        assert r["payload_bytes"] == len(of[r["page_id"]].encode())


def test_small_payloads_are_responses(spark, pages):
    got = warc.merged_index(spark, warc.write_archives(pages, least_bytes=1 << 20)).collect()
    assert {r["record_type"] for r in got} == {"response"}


def test_archive_without_pages(spark):
    assert warc.merged_index(spark, warc.write_archives(spark.createDataFrame([], PAGES))).count() == 0


def test_loser_tree():
    rng = random.Random(2)
    for k in (1, 2, 3, 7, 20):
        runs = [sorted((str(rng.randrange(50)), "", rng.randrange(9)) for _ in range(rng.randrange(30))) for _ in range(k)]
        chunks = sorted(((f"r{i}", run[j:j + 4]) for i, run in enumerate(runs) for j in range(0, len(run), 4)), key=lambda c: c[1][0])
        assert list(warc.merge_chunks(chunks)) == sorted(row for run in runs for row in run)


CASES = [(1, "https://a.net/x"), (2, "https://a.net"), (3, "http://www.example.net/en/1"), (4, "http://example.com/de/?x"), (5, "ftp://X.EXAMPLE.COM/de/y"),
         (6, "http://org/fr/z#/"), (7, "http://notexample.com/de/"), (8, None), (9, "nothing"), (10, ""), (10, "https://a.net/x"), (None, "http://net/"),
         (11, "http://net?/"), (12, "http://a.netx/"), (13, "://"), (14, "http://é.net/ü")]
WANT = {1: "net/", 2: None, 3: "example.net/en/", 4: "example.com/de/", 5: "example.com/de/", 6: "org/fr/", 7: None, 8: None, 9: None, None: "net/",
        11: None, 12: None, 13: None, 14: "net/"}


@pytest.mark.parametrize("limit", [urls.MAX_BYTES, 0])
def test_rules(spark, limit):
    pages = spark.createDataFrame(CASES, "page_id long, url string").withColumn("rule", F.lit("x")).withColumn("host", F.lit("y"))
    rules = spark.createDataFrame([*urls.RULES, ("net/", "allow"), (None, "block"), ("net/", "block")], "rule string, verdict string")
    got = urls.judge(pages, rules, max_bytes=limit).collect()
    assert len(got) == len(CASES)
    for r in got:
        if r["page_id"] != 10:
            assert r["rule"] == WANT[r["page_id"]], r
            assert r["verdict"] == ("block" if r["rule"] in ("net/", "example.com/de/") else "allow")
    assert sorted((r["rule"] or "") for r in got if r["page_id"] == 10) == ["", "net/"]
    assert {r["verdict"] for r in urls.judge(pages, rules.limit(0), max_bytes=limit).collect()} == {"allow"}


def test_digest_collisions():
    import numpy as np
    weak = lambda s: len(s)
    index = urls.DigestArray(np.frombuffer(urls.DigestArray.pack({b"ab": 1, b"cd": 2, b"ef": 3, b"xyz": 4}, weak), np.uint8))
    assert index.find([b"cd", b"ef", b"zz", b"ab", b"xyz", b"q", b"long one"], weak).tolist() == [2, 3, -1, 1, 4, -1, -1]
