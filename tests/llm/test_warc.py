import base64
import gzip
import hashlib
import random

from semiflow.llm import warc
from semiflow.llm.common import scratch


def test_loser_tree_merges(spark):
    r = random.Random(3)
    for n in (0, 1, 2, 3, 7):
        runs = [sorted(((str(r.randrange(9)), "t", r.randrange(50), "", None, 0, "", "", f"a{i}", k) for k in range(r.randrange(20))), key=warc.order) for i in range(n)]
        got = list(warc.LoserTree([iter(x) for x in runs]))
        assert [warc.order(x) for x in got] == sorted(warc.order(x) for run in runs for x in run)


PAGES = [(1, "http://B.org/x?q=1", "<p>same</p>"), (5, "https://www.a.com", "<p>same</p>"), (3, "http://a.com/z", None), (4, None, ""), (6, "http://a.com:8080/é", "é\r\n\r\nWARC/1.1\r\n\r\n"), (2, "::bad::[", "x" * 70_000), (None, "http://a.com", "<p>same</p>"), (7, "a\nb", "only"), (7, "a\nb", "only")]


def test_round_trip_and_order(spark):
    df = spark.createDataFrame([(*p, "y") for p in PAGES], "page_id long, url string, html string, record_type string")
    got = warc.archived(df).collect()
    assert len(got) == len(PAGES)
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for r in got:
        h = next(h or "" for i, _, h in PAGES if i == r.page_id)
        raw = h.encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        response = r.page_id == last[h]
        assert r.record_type == ("response" if response else "revisit") and r.refers_to == (None if response else last[h])
    keys = [(r.url_key, r.ts) for r in got]
    assert keys == sorted(keys)


def test_least_bytes_and_empty_table(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.archived(df, least_bytes=1).collect()
    assert all(r.record_type == "response" for r in got if r.payload_bytes == 0)
    assert warc.archived(df.limit(0)).collect() == []


def test_archives_are_warc(spark):
    at = scratch(spark, "warc")
    warc.write(spark.createDataFrame([(1, "http://a.org/", "<b>")], "page_id long, url string, html string"), at)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at).first().content
    ((head, block),) = list(warc.records(bytes(raw)))
    assert head["WARC-Type"] == "response" and block == b"<b>" and head["Content-Length"] == "3"
    assert head["WARC-Record-ID"].startswith("<urn:uuid:")


def test_each_record_is_a_gzip_member(spark):
    at = scratch(spark, "warc")
    pages = [(i, f"http://a.org/{i}", f"<p>é{i % 5}</p>" * i) for i in range(40)]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), at)
    n = 0
    for f in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at).collect():
        raw, own = bytes(f.content), list(warc.members(bytes(f.content)))
        assert gzip.decompress(raw) == b"".join(own)
        assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in own)
        n += len(own)
    assert n == 40


def test_members_of_any_length():
    for raw in (b"", b"x", b"y" * 100_000, bytes(17_000_000)):
        one = warc.member(raw) + b"\0"
        assert b"".join(warc.members(one + one)) == raw + raw and gzip.decompress(one) == raw


def test_many_ranges_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    pages = [(i, "http://hot.org/" if i % 3 else f"http://b{i % 17}.org/", f"{i % 50}") for i in range(600)]
    got = warc.archived(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert got.rdd.getNumPartitions() > 8
    keys = [(r.url_key, r.ts, r.page_id) for r in got.collect()]
    assert len(keys) == 600 and keys == sorted(keys)


def test_times(spark):
    at = scratch(spark, "warc")
    df = spark.createDataFrame([(1, "a", "x", 1_600_000_000), (2, "b", "y", None)], "page_id long, url string, html string, s long").selectExpr("*", "timestamp_seconds(s) AS t")
    warc.write(df, at, time="t")
    assert {r.page_id: r.ts for r in warc.read(spark, at).collect()} == {1: "2020-09-13T12:26:40Z", 2: "2020-01-01T00:00:00Z"}
    far = warc.archived(spark.createDataFrame([(10**15, "a", "x"), (-5, "b", "y")], "page_id long, url string, html string"))
    assert all(r.ts.startswith("20") for r in far.collect())


def test_keys():
    assert warc.url_key("HTTP://www.Ex.org:80/A?b=C") == "org,ex)/a?b=c" and warc.url_key("") == ")/"
