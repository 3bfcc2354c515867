import random

import duckdb
import pytest

from llm_cases import SF01
from retentia.llm import urlfilter as U
from retentia.llm.common import QUERIES

ODD = [None, "", "no scheme/net/", "http://", "http://net", "http://net/", "x://NET/a", "http://a.net?x=/en/", "http://anet/", "http://a..net/q", "http://example.net/en",
       "http://www.Example.NET/en/1?a#b", "http://example.com/de/#x", "http://a.org/fr/ü", "http://a.org/FR/", "ftp://user@a.net:80/", "http://é.net/", "http://a.b.c.d.e.f.net/" + "x/" * 3000,
       "http://" + "a." * 500 + "net/", "http://a.net\n/", "http://x://example.net/en/", "http://net#/", "http://a.net/://b.org/fr/"]


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest[: min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))]
    path = rest[len(host):]
    path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p) for h, p, _ in rules if (host == h or h and host.endswith("." + h)) and path.startswith(p)]
    rule = max(fit)[2] if fit else None
    return host, path, rule, "block" if any(h + p == rule and v == "block" for h, p, v in rules) else "allow"


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF01}/pages.parquet')")
    rel = con.sql(QUERIES["op11_url_filter"].sql)
    got = QUERIES["op11_url_filter"].build(spark, SF01)
    assert got.columns == rel.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rel.fetchall()))


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "net/", "h", "r") for i, u in enumerate(urls)], "page_id int, url string, rule string, host string, key string")


def check(spark, urls, rules, **sizes):
    got = U.filter_urls(pages_of(spark, urls), spark.createDataFrame(rules, "host string, path string, verdict string"), **sizes).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in got} == {i: judge(u, rules) for i, u in enumerate(urls)}
    assert len(got) == len(urls)


def test_odd_urls(spark):
    check(spark, ODD + ODD, U.RULES)


def test_odd_rules(spark):
    ok = [("net", "", "block"), ("a.net", "", "allow"), ("b.a.net", "/x", "allow"), ("a.net", "/xx/y", "block"), ("", "", "block"), ("org", "/", "block"), ("org", "/", "allow"), ("org", "/", "block")]
    check(spark, [None, "http://b.a.net/xx/yy", "http://b.a.net/x", "http://a.net", "http://q.org/", "http:///x", "http://q.com/"], ok)
    bad = [(None, "/", "block"), ("net", None, "block"), ("net", "/", None), ("a.n", "et/", "block"), ("a.net/", "", "block")]
    rules = spark.createDataFrame(bad, "host string, path string, verdict string")
    for r in (rules, rules.limit(0)):
        assert [tuple(x) for x in U.filter_urls(pages_of(spark, ["http://a.net/"]), r).collect()] == [(0, "a.net", "/", None, "allow")]
    assert U.filter_urls(pages_of(spark, []), rules).count() == 0


def test_many_rules_many_levels_and_shards(spark):
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    urls = [f"http://{'.'.join(name() for _ in range(rng.randint(1, 4)))}/{name()}/{name()}" for _ in range(1500)]
    rules = sorted({(".".join(name() for _ in range(rng.randint(1, 2))), rng.choice(["", "/", f"/{name()}", f"/{name()}/"]), rng.choice(["block", "allow"])) for _ in range(300)})
    check(spark, urls, rules, least_bits=8)
    check(spark, urls, rules, least_bits=8, most_bits=2000)


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key", "id % 10 = 0 AS listed")
    levels = U.build_cascade(keys, least_bits=8)
    assert len(levels) > 3 and sum(m for _, m, _ in levels) < 10 * 3000
    assert keys.where(U.member(keys["key"], levels) != keys["listed"]).count() == 0


def test_few_shards_for_few_rules():
    assert U.shards_of(0) == U.shards_of(1000) == 1
    assert U.shards_of(10**8) * U.LEVEL_BITS >= 10**8 * 16


@pytest.mark.parametrize("kind", ["MapInArrow", "Python", "CartesianProduct", "NestedLoop"])
def test_plan_is_native(spark, kind):
    plan = U.op11_url_filter(spark, SF01)._jdf.queryExecution().toString()
    assert kind not in plan and "Exchange" not in plan and "Join" not in plan
