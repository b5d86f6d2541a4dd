"""Url rules, templates and odd rows."""

import pytest
from pyspark.sql import functions as F

from nearpass.llm import queries, urls
from tests.compare import oracle, rows_of

SF = "/root/testdata/sf0.001"


def test_query_matches_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        cur = oracle(sf).execute(queries.SQL["op2_url_filter"])
        want = cur.fetchall()
        df = queries.QUERIES["op2_url_filter"](spark, sf)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], want)


def test_host_path_and_rules(spark):
    rows = [("http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
            ("http://example.org/en/1", "example.org", "/en/1", "example.org/en/1", "block"),
            ("http://org", "org", "", None, "allow"), ("http://org/", "org", "/", "org/", "allow"),
            ("http://notorg/", "notorg", "/", None, "allow"), ("x://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"),
            ("x://b.com/fr", "b.com", "/fr", None, "allow"), ("://c.com/de/1", "c.com", "/de/1", "com/de/", "block"),
            ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://", "", "", None, "allow"),
            ("http://h?x=/en/", "h", "", None, "allow"), ("http://ÄB.com#/de/", "Äb.com", "", None, "allow"), ("http://a://b/c", "a:", "//b/c", None, "allow")]
    df = spark.createDataFrame([(i, r[0], None, "x", 1) for i, r in enumerate(rows)], "page_id long, url string, bad int, verdict string, _url int")
    got = urls.judge(df, queries.URL_RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [r[1:] for r in rows]
    assert urls.judge(df.limit(0), queries.URL_RULES).count() == 0
    with pytest.raises(ValueError):
        urls.judge(df, [("allow", "a/")] * 1001)


def test_templates_wildcards_merging_and_rejection(spark):
    rows = []
    for i in range(60):
        rows += [(f"http://h.net/ads/{i}/x", 1), (f"http://h.net/news/{i}/x", 0), (f"http://h.net/blog/{i}/x", 0), (f"http://h.net/ads/{i}/y/z", 1)]
    rows += [(f"http://good.net/{i}", 0) for i in range(60)]
    rows += [("http://h.net/ads/new/x", None), ("http://h.net/news/new/x", None), ("http://other.net/ads/1", None)] * 2
    df = spark.createDataFrame([(u, b) for u, b in rows], "url string, bad int")
    got = {(r["url"]): (r["template"], r["verdict"]) for r in urls.judge(df.withColumn("page", F.col("url")).withColumnRenamed("page", "u2"), []).withColumnRenamed("u2", "url").collect()}
    assert got["http://h.net/news/new/x"] == ("h.net/blog|+1/*/x", "allow")
    assert got["http://h.net/ads/new/x"] == ("h.net/ads/*/x|+1", "block") and got["http://h.net/ads/7/y/z"][1] == "block"
    assert got["http://other.net/ads/1"][1] == "allow"


def test_every_child_is_judged_by_its_own_support(spark):
    """Nine, or ninety, sections keep a bad one blocked; so does the fifth segment of a path."""
    for sections in (8, 9, 90):
        rows = [(f"http://h.net/s{k}/{i}", int(k == 0)) for k in range(sections) for i in range(20)] + [("http://h.net/s0/new", None), ("http://h.net/s1/new", None)]
        got = {r["url"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "url string, bad int"), []).collect()}
        assert got["http://h.net/s0/new"] == "block" and got["http://h.net/s1/new"] == "allow"
    deep = [(f"http://h.net/a/b/c/d/{k}/{i}", int(k == "bad")) for k in ("bad", "good", "fine", "well") for i in range(20)]
    got = {(r["url"].split("/")[7], r["verdict"]) for r in urls.judge(spark.createDataFrame(deep, "url string, bad int"), []).collect()}
    assert got == {("bad", "block"), ("good", "allow"), ("fine", "allow"), ("well", "allow")}


def test_clashing_names(spark):
    odd = ["row", "node", "up", "segment", "segments", "b", "n", "own", "child", "share", "fits", "branch", "_bad", "_labelled", "_s0", "_g0"]
    df = spark.createDataFrame([("http://h.net/a/1", 1), ("http://h.net/a/1", 1)], "url string, bad int").select("*", *[F.lit(5).alias(c) for c in odd])
    got = urls.judge(df, [])
    assert got.columns == ["url", *odd, "host", "path", "rule", "verdict", "template", "purity"]
    assert [[r[c] for c in odd] for r in got.collect()] == [[5] * len(odd)] * 2
