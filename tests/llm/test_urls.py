import random
import re

import numpy as np
import pytest
from loomwright.llm import bloom, urls


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, "allow")


def test_rules_match_brute_force(spark):
    rng = random.Random(3)
    hosts = ["example.com", "a.example.com", "aexample.com", "COM", "net", "x.net", "É.org", "org.", "a.b.c.example.net", "com:80", "u@x.org", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/71.html", "/EN/", "/de/8", "/de/", "/es/x", "//", "/en/7/8", "/é/"]
    ends = ["", "?x=/en/", "#/de/8", "?a://b"]
    made = [rng.choice(["http://", "x://", "", "://"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(ends) for _ in range(400)] + [None, "", "://", "a\n://x.com/en/\n7"]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    for r in urls.judge(pages, listed=none).collect():
        host, path, (rule, verdict) = brute(made[r["page_id"]], urls.RULES)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), made[r["page_id"]]


def test_listed_urls_are_exact(spark):
    listed = spark.createDataFrame([(f"bad{k}.example", "/p", "block") for k in range(3000)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, f"http://www.bad{k}.example/p{k}") for k in range(6000)], "page_id long, url string")
    got = urls.judge(pages, listed=listed).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in got} == {"block": 3000, "allow": 3000}
    old, urls.MOST_BROADCAST_BYTES = urls.MOST_BROADCAST_BYTES, 0  # the way of lists too large to broadcast
    try:
        again = urls.judge(pages, listed=listed).groupBy("verdict").count().collect()
    finally:
        urls.MOST_BROADCAST_BYTES = old
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://U@Casino-Win.example.com.:8443/a/./b/../c%7e/?q=%41#x", ("casino-win.example.com", "/a/c~?q=A")),
        ("http://x.org", ("x.org", "")),
        ("http://x.org/", ("x.org", "")),
        ("x.org/%e9/é", ("x.org", "/%E9/%C3%A9")),
        ("http://x.org?q", ("x.org", "?q")),
        ("http://x.org/../..//a", ("x.org", "/a")),
        ("http://", ("", "")),
    ],
)
def test_canonical(url, want):
    assert urls.canonical(url) == want and urls.canonical("http://" + "".join(want)) == want


def test_listed_urls_fit_all_ways_to_write_them(spark):
    listed = spark.createDataFrame([("http://bad.example/a/b/", "block"), ("free-bets.example.net", "block"), ("q.example/x?id=7", "block"), (None, "block")], "url string, verdict string")
    cases = {
        "https://u@free-bets.example.net/": "block", "https://free-bets.example.net.:8443/x": "block", "http://FREE-BETS.example.net": "block", "http://more.free-bets.example.net/y": "block",
        "http://notfree-bets.example.net/": "allow", "http://bad.example/a/b": "block", "http://bad.example/a/%62/c": "block", "http://bad.example/a/bc": "allow", "http://bad.example/a/x/../b#f": "block",
        "http://bad.example/a": "allow", "http://q.example/x?id=7": "block", "http://q.example/x?id=70": "allow", "http://q.example/x": "allow",
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, listed, []).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_path_without_slash_stays_a_path(spark):
    listed = spark.createDataFrame([("x.example", "y", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.exampley/"), (2, "http://x.example/y")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, listed, []).collect()} == {1: "allow", 2: "block"}


def test_steps_of_hashing_agree_with_whole_keys():
    for h, host, n, tier in urls.fitting("a.b.com", "/en/7", "http://a.b.com/en/7/x?y", [0, 4, 99]):
        whole = "/en/7" if tier else "/en/7/x?y"
        assert np.uint64(h) == np.int64(urls.hash_of(host, whole[:n], tier)).view(np.uint64)


def test_usual_list(spark):
    got = urls.usual_list(spark)
    assert got.count() == len(urls.TRADES) * len(urls.LURES) * 2 * len(urls.ENDINGS) and got.distinct().count() > 14_000


def test_very_long_url(spark):
    pages = spark.createDataFrame([(1, "http://a.com/" + "x/" * 20_000), (2, "http://" + "a." * 2_000 + "com/en/")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in urls.judge(pages).collect()} == {1: None, 2: "com/en/"}


def test_bloom_has_no_misses_and_few_false_hits(spark):
    keys = spark.range(20_000).selectExpr("id * 7 AS k")
    bits = bloom.build(keys, "k")
    may = bloom.possible(spark, bits)
    from pyspark.sql import functions as F

    assert keys.filter(may(F.col("k"))).count() == 20_000
    assert spark.range(20_000).selectExpr("id * 7 + 3 AS k").filter(may(F.col("k"))).count() < 600
    assert not bloom.hits(bloom.build(keys.limit(0), "k"), np.arange(9)).any()


def test_hard_rows(spark, clashing):
    pages = spark.createDataFrame([(1, None), (1, None), (None, "http://x.com/en/"), (2, "")], "page_id long, url string")
    got = urls.judge(clashing(pages)).collect()
    assert len(got) == 4 and [r["rule"] for r in got if r["page_id"] is None] == ["com/en/"]
    assert urls.judge(pages.limit(0)).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in urls.judge(pages, none, []).collect()} == {"allow"}
