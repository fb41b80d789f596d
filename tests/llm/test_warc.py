"""WARC archives: exact round trips."""

import base64
import hashlib

from plinth.llm import warc
from plinth.session import shared_path

ROWS = [(1, "http://a/?q=1 2&x=é", "<p>ö</p>"), (11, "http://a/x%20y?r=a%2Fb", "<p>1</p>"), (12, "http://a/%zz é%20'", "<p>2</p>"), (2, "http://b/", "same"), (3, None, "same"), (9, "http://c/", "same"), (4, "http://d/\r\nX: y", None), (5, "u", ""), (6, "v", "WARC/1.1\r\n\r\n" * 50), (7, "w", "x" * 300_000), (2, "http://b/again", "same"), (None, "n", "same")]


def _digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_round_trip(spark, monkeypatch):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, offset int")
    got = warc.round_trip(df).collect()
    assert len(got) == len(ROWS)
    least = {}
    for i, _, t in ROWS:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    want = sorted((str(i), u or "", len((t or "").encode()), _digest(t), "response" if i == least[t or ""] else "revisit", None if i == least[t or ""] else least[t or ""]) for i, u, t in ROWS)
    assert sorted((str(r.page_id), r.url or "", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert sorted((r.page_id or -1, r.url or "") for r in got) == sorted((i or -1, u or "") for i, u, _ in ROWS)
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {t or "" for _, _, t in ROWS}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_selected_records_only(spark):
    df = spark.createDataFrame(ROWS[:10], "page_id long, url string, html string")
    folder = shared_path(spark, "warc-test")
    index = warc.write_archives(df, folder)
    assert sorted(r.page_id for r in warc.read_records(index.where("page_id in (2, 7)"), folder).collect()) == [2, 7]


def test_ranges_cover_each_span_once():
    spans = [(0, 10), (10, 5), (40, 10), (1000, 1), (1001, 50)]
    got = list(warc.ranges(spans, read_bytes=100, gap=30))
    assert got == [(0, 50, 3), (1000, 51, 2)]
    assert sum(n for _, _, n in warc.ranges(spans, read_bytes=1, gap=0)) == 5
    assert list(warc.ranges([])) == []


def test_targets_keep_their_escapes():
    for url, target in (("http://a/x%20y?r=a%2Fb", b"http://a/x%20y?r=a%2Fb"), ("http://a/x y", b"http://a/x%20y"), ("é%", b"%C3%A9%")):
        data = warc.record(1, url, b"p", "D", None, 1)
        assert b"WARC-Target-URI: " + target + b"\r\n" in data and warc.parse(data)["url"] == url
