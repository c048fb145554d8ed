import base64
import gzip
import hashlib
import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinraster.llm import warc as W
from twinraster.llm.warc_query import keyed, through_archives

SCHEMA = "page_id long, url string, html string, record_type string"


def pages(n=300):
    rows = []
    for i in range(n):
        html = "<p>same</p>" if i % 3 == 0 else f"<p>é{i % 120}</p>\r\n\r\nWARC/1.1\r\n" * (1 + i % 4)
        rows.append((i, f"http://{'a' if i % 2 else 'b'}.Example.com/{i % 50}?q={i % 7}#x", html, "clash"))
    return rows + [(1000, None, None, None), (1001, "", "", None), (1002, "no host\r\nat all", None, None), (1003, "http://[bad", "x" * 300_000, None), (1004, "http://a.example.com", "x" * 300_000, None)]


def expected(rows):
    body = {i: (h or "").encode() for i, _, h, _ in rows}
    top = {}
    for i, b in body.items():
        top[b] = max(top.get(b, -1), i)
    return sorted((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if top[b] == i else "revisit", None if top[b] == i else top[b]) for i, b in body.items())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ENTRIES", 4)
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 2000)


def test_round_trip(spark, small):
    rows = pages()
    found = through_archives(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted(expected(rows), key=str)


def test_null_and_repeated_ids(spark, small):
    rows = [(None, "http://x.org/", "p", ""), (None, "http://y.org/", "q", ""), (None, "http://z.org/", "q", ""), (5, "http://x.org/", "p", ""), (7, "http://w.org/", "r", ""), (7, "http://w.org/", "r", "")]
    found = Counter((r.page_id, r.record_type, r.refers_to) for r in through_archives(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == {(None, "revisit", 5): 1, (None, "response", None): 2, (5, "response", None): 1, (7, "response", None): 2}


def test_empty_table(spark):
    assert through_archives(spark.createDataFrame([], SCHEMA)).collect() == []


def test_archives_are_gzip_files_and_blocks_are_sorted(spark, small, tmp_path):
    folder = str(tmp_path / uuid.uuid4().hex)
    W.write_archives(spark.createDataFrame(pages(), SCHEMA).repartition(2), folder)
    W.write_index(spark, folder)
    stored = spark.read.parquet(f"{folder}/archives")
    name, n = stored.groupBy("archive").count().orderBy(F.desc("count"), "archive").first()
    raw = b"".join(W.archive_bytes(spark, folder, name))
    text = gzip.decompress(raw)
    assert len(re.findall(rb"WARC-Record-ID: ", text)) == n > 1
    one = stored.filter((F.col("archive") == name) & (F.col("offset") > 0)).first()
    assert raw[one.offset: one.offset + one.length] == bytes(one.member)
    blocks = spark.read.parquet(f"{folder}/blocks").orderBy("part", "block").collect()
    keys = [k for b in blocks for k in zip(*[W._entries(bytes(b.data))[c] for c in ("url_key", "page_id")])]
    assert keys == sorted(keys) and len(keys) == 305 and all(b.entries <= 4 for b in blocks)
    asked = spark.createDataFrame([("com,example,a)/1?q=1", 1), ("com,example,a)/1?q=1", 2), ("", 1000), ("zzz", 1), ("com,example,a)/1?q=1", 1)], "url_key string, page_id long")
    assert sorted((r.url_key, r.page_id) for r in W.lookup(asked, folder).collect()) == [("", 1000), ("com,example,a)/1?q=1", 1)]
    assert keyed(spark.createDataFrame(pages(), SCHEMA)).distinct().count() == 305


def test_small_payloads_are_responses(spark, tmp_path):
    folder = str(tmp_path / uuid.uuid4().hex)
    W.write_archives(spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcdef", ""), (4, "u", "abcdef", "")], SCHEMA), folder, min_bytes=3)
    kinds = {r.page_id: W.parse_record(bytes(r.member))[0]["warc-type"] for r in spark.read.parquet(f"{folder}/archives").collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_url_keys():
    assert W.url_key("https://User@WWW.Example.org:8080/A/b?c=D#frag") == "org,example,www:8080)/A/b?c=D"
    assert W.url_key("http://example.org") == "org,example)/"
    assert W.url_key(None) == "" == W.url_key("")


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_repeats_across_blocks_and_partitions(spark, small, partitions):
    rows = pages(60) + [(7, "http://w.org/", "r", "")] * 90 + [(None, None if i % 2 else "", f"n{i}", "") for i in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in through_archives(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    bodies = [(i, (h or "").encode()) for i, _, h, _ in rows]
    assert found == Counter((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for i, b in bodies)
