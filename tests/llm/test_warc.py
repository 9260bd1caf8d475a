from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import warc


def test_revisits(spark):
    rows = [
        (1, "http://www.A.com/x/#f", 100, 200, {"ETag": '"1"', "Content-Length": "5", "Date": "a"}),
        (2, "https://a.com/x?utm_source=q", 200, 200, {"etag": '"2"', "content-type": "t"}),
        (3, "http://a.com:80/x", 150, 304, {"ETAG": 'W/"1"', "Date": "b", "Content-Length": "0"}),
        (4, "http://a.com/x", 90_000_000, 304, {"etag": '"2"', "date": "c"}),
        (5, "http://a.com/x", 200, 304, {"etag": '"2"'}),
        (6, "http://a.com/x", 50, 304, {"etag": '"1"'}),
        (7, "http://a.com/x", 300, 304, None),
        (8, None, 300, 304, {"etag": "x"}),
        (9, "http://a.com/x", None, 304, {"etag": "x"}),
        (10, "http://a.com/x", 400, 404, {}),
        (11, "http://b.com/y?a=1", 10, 200, {"Last-Modified": "m"}),
        (12, "http://b.com/y?a=1&ref=z", 20, 304, {"Last-Modified": "m", "Expires": "e"}),
        (13, "http://b.com/y?a=1", 20, 304, {"Last-Modified": "n"}),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, s long, status int, headers map<string,string>").select("record_id", "url", F.timestamp_seconds("s").alias("ts"), "status", "headers")
    got = {r["record_id"]: (r["response_id"], r["outcome"], r["headers"]) for r in warc.resolve_revisits(df).collect()}
    assert got[3] == (1, "resolved", {"etag": 'W/"1"', "content-length": "5", "date": "b"})
    assert got[4] == (2, "resolved", {"etag": '"2"', "content-type": "t", "date": "c"})
    assert got[5][:2] == (1, "changed") and got[6][:2] == (None, "no_response") and got[7][:2] == (2, "no_validator")
    assert got[8][1] == got[9][1] == "no_response" and 10 not in got
    assert got[12] == (11, "resolved", {"last-modified": "m", "expires": "e"}) and got[13][:2] == (11, "changed")
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_parts_and_empty_bodies_answer_no_revisit(spark):
    rows = [(k, "http://a.org/", 10 * k, status, {"etag": "x", "content-range": "bytes 0-1/9"}) for k, status in enumerate([203, 204, 205, 206, 207, 226, 304])]
    rows += [(10, "http://b.org/", 1, 206, {"etag": "x"}), (11, "http://b.org/", 2, 304, {"etag": "x", "set-cookie": "s", "warning": "w"})]
    df = spark.createDataFrame(rows, "record_id long, url string, s long, status int, headers map<string,string>").select("record_id", "url", F.timestamp_seconds("s").alias("ts"), "status", "headers")
    got = {r["record_id"]: (r["response_id"], r["outcome"]) for r in warc.resolve_revisits(df).collect()}
    assert got == {6: (0, "resolved"), 11: (None, "no_response")}


@pytest.mark.parametrize("span_rows", [7, 100_000])
def test_busy_urls_against_brute_force(spark, span_rows):
    """Spans of a day with many records are divided; repeated records and clashing columns change nothing."""
    r = random.Random(2)
    rows = [(i, "http://hot.org/" if r.random() < 0.7 else f"http://h{r.randrange(4)}.org/", r.randrange(200_000), r.choice([200, 304, 304, 404, None]), {"etag": r.choice("ab")}) for i in range(600)]
    rows += rows[:5] + [(1000, None, 5, 304, {}), (1001, "http://hot.org/", None, 304, None)] + [(2000 + i, "http://hot.org/", 777, 304 if i % 2 else 200, {"etag": "z"}) for i in range(40)]
    df = spark.createDataFrame(rows, "record_id long, url string, s long, status int, headers map<string,string>").repartition(4)
    df = df.select("record_id", "url", F.timestamp_seconds("s").alias("ts"), "status", "headers", *[F.lit(-1).alias(c) for c in ("_span", "_k", "outcome", "url_key", "count")])
    want = []
    for i, url, s, status, headers in rows:
        if status == 304:
            before = [(t, j, h["etag"]) for j, u, t, st, h in rows if st == 200 and u == url and s is not None and t < s] if url and s is not None else []
            last = max(before, default=None)
            tag = (headers or {}).get("etag")
            want.append((i, last and last[1], "no_response" if not last else "no_validator" if not tag else "resolved" if tag == last[2] else "changed"))
    got = [(x["record_id"], x["response_id"], x["outcome"]) for x in warc.resolve_revisits(df, span_rows=span_rows).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
