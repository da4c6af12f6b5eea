from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paceline.llm import url_filter as urls
from paceline.llm.common import table
from tests.conftest import SF_DIR


def parts(url):
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(url):
    host, path = parts(url)
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)


ODD = [None, "", "nothing", "http://A.NET/es/x?y", "https://www.example.com/en/a", "https://x.example.com/en/", "http://net?x"]
ODD += ["ftp://u://com/", "http://com/", "http://notcom/", "http://a.com", "http://www.example.com/en", "x\n://É.COM/\n", "http://b.net/fr/#/es/"]
ODD += ["http://long.org/" + "a/" * 5000 + "?" + "&".join("p=1" for _ in range(3000))]


def check(pages, rows):
    assert Counter(r.page_id for r in rows) == Counter(i for i, _ in pages)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.page_id, r)
    for page_id, url in pages:
        r, rule = by_id[page_id], rule_of(url)
        assert (r.host, r.path) == parts(url)
        assert r.rule == (rule and rule[0] + rule[1])
        assert r.verdict == rule[2] if rule else r.verdict in ("allow", "block")


def test_query(spark):
    pages = [(r.page_id, r.url) for r in table(spark, SF_DIR, "pages").collect()]
    check(pages, urls.op10_url_filter(spark, SF_DIR).collect())


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(k, u, 1, 2.0, "x") for k, u in enumerate(ODD)] + [(None, "http://com/", 1, 2.0, "x"), (3, ODD[3], 1, 2.0, "x")]
    return spark.createDataFrame(rows, "page_id long, url string, domain int, label double, host string")


def test_nulls_repeats_and_foreign_columns(odd_pages):
    check([(r.page_id, r.url) for r in odd_pages.collect()], urls.judge(odd_pages).collect())


def test_without_labels_or_with_one_kind(spark, odd_pages):
    unknown = odd_pages.where("page_id in (0, 1, 2)")
    assert {r.verdict for r in urls.judge(unknown).collect()} == {"allow"}
    blocked = odd_pages.where("page_id in (2, 3)")
    assert {r.verdict for r in urls.judge(blocked).collect()} == {"block"}
    assert urls.judge(odd_pages.limit(0)).count() == 0


def test_main_path_runs_no_python(spark, odd_pages):
    plan = urls.judge(odd_pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_unlisted_urls_follow_their_likes(spark):
    """Rules label part of each domain; the trees judge its other URLs like the labelled ones."""
    rows = [(k, f"http://h{k}.{d}.test/{s}/{k}") for k in range(400) for d, s in (("bad", "x"), ("good", "y"))]
    rows = [(i, u if i % 4 else u.replace("/x/", "/q/").replace("/y/", "/q/")) for i, u in rows]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = [("bad.test", "/x/", "block"), ("good.test", "/y/", "allow")]
    judged = [r for r in urls.judge(pages, rules).collect() if r.rule is None]
    right = [(r.verdict == "block") == ("bad" in r.host) for r in judged]
    assert len(right) == 200 and sum(right) / len(right) > 0.9


def test_entropy(spark):
    texts = ["aab", "", "abcd", "ééa"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", urls.entropy(F.col("t")).alias("e")).collect()
    for r in rows:
        n = len(r.t)
        assert r.e == pytest.approx(-sum(c / n * math.log2(c / n) for c in Counter(r.t).values()) if n else 0.0)
