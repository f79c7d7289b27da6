"""URL rules against a plain Python version."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.llm import urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("example.com", "/en/a/b", "allow"), ("net", "/es/", "block"), ("net", "", "allow"), ("a.net", "/x", "block"),
         ("a.net", "/x", "allow"), ("EXAMPLE.org", None, "block"), (None, "/", "block"), ("org", "/é", "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((rest.index(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:end]


def judge(url, rules):
    host, path = split(url)
    best = None
    for h, p, v in rules:
        if h is not None and host and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or ""):
            key = (len(h) + len(p or ""), len(h), v)
            if best is None or key > best[0]:
                best = key, h.lower() + (p or ""), v
    return host, path, best and best[1], best[2] if best else "allow"


def pages(seed, n=1500):
    rng = random.Random(seed)
    hosts = ["example.com", "www.example.com", "WWW.Example.com", "x.y.net", "a.net", "b.a.net", "net", "notexample.com", "é.org",
             "example.com:80", "", "..", "com.", "sub.example.org"]
    paths = ["", "/", "/en", "/en/", "/en/a/b/c", "/es/1", "/x?q=/en/", "#/en/", "/é/x", "?a://b/", "/en//a"]
    rows = [(i % 700, rng.choice(["http://", "https://", "", "x://y://"]) + rng.choice(hosts) + rng.choice(paths)) for i in range(n)]
    return [*rows, (None, None), (1, None), (2, ""), (3, "http://" + "a." * 5000 + "com/" + "p" * 200000)]


@pytest.mark.parametrize("share", [50, urls.SLICE_KEYS])
def test_rules_equal_a_plain_version(spark, monkeypatch, share):
    monkeypatch.setattr(urls, "SLICE_KEYS", share)
    rows = [r for r in pages(share) if r[1] is None or r[1].count(".") < 100]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, rule string, top int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urls.judge_urls(df, rules)
    assert got.columns == ["page_id", "url", "top", "host", "path", "rule", "verdict"]
    got = sorted(map(repr, [(r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()]))
    assert got == sorted(map(repr, [(*r, *judge(r[1], RULES)) for r in rows]))


def test_very_long_url(spark):
    long = pages(1)[-1]
    df = spark.createDataFrame([long], "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert urls.judge_urls(df, rules).first()["rule"] == "com/"


def test_empty_tables(spark):
    df = spark.createDataFrame(pages(2, 20), "page_id bigint, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.judge_urls(df, rules).where(F.col("rule").isNull() & (F.col("verdict") == "allow")).count() == 24
    assert urls.judge_urls(df.limit(0), spark.createDataFrame(RULES, rules.schema)).count() == 0


def test_main_path_is_native(spark):
    df = spark.createDataFrame([], "page_id bigint, url string")
    plan = urls.judge_urls(df, spark.createDataFrame([], "host string, path string, verdict string"))
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()
