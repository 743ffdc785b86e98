"""URL rules against a plain loop over all rules, with small blocks and ranges; the query against its SQL."""

import random
import re

import duckdb
import pytest
from filequarry.llm import queries, url_rules

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql(queries.OP11_SQL)
    got = queries.op11_url_filter(spark, SF)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(repr(r) for r in map(lambda r: got_row(want.columns, r), want.fetchall()))


def got_row(names, values):
    from pyspark.sql import Row

    return Row(**dict(zip(names, values)))


def test_no_python_worker(spark):
    plan = queries.op11_url_filter(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|InPandas", plan)


def brute(urls, rules, default):
    best = {}
    for host, path, verdict in rules:
        host, path = (host or "").translate({c: c + 32 for c in range(65, 91)}), path or ""
        if verdict is not None:
            best[host, path] = max(best.get((host, path), ""), verdict)
    for i, url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in best.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        chosen = max(fits, default=(0, 0, None, default))
        yield i, host, path, chosen[2], chosen[3]


@pytest.mark.parametrize("seed", range(3))
def test_random_rules(spark, monkeypatch, seed):
    monkeypatch.setattr(url_rules, "BLOCK", 4)
    rng = random.Random(seed)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", "B", "é", ""]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice("/ab%") for _ in range(rng.randint(0, 5)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(150)]
    urls = [(i % 50, f"http://{host()}/{path()}{rng.choice(['', '?a=://b', '#/c'])}") for i in range(600)]
    urls += [(None, None), (None, "http://a/"), (1, ""), (2, "://"), (3, "HTTP://A.B#x/y"), (4, "http://a" + "/b" * 50_000), (4, "http://a" + ".b" * 2_000)]
    pages = spark.createDataFrame([(*u, "x", "y") for u in urls], "page_id long, url string, key string, `row` string")
    got = [tuple(r) for r in url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), "block").collect()]
    assert sorted(got, key=repr) == sorted(brute(urls, rules, "block"), key=repr)


def test_odd_rules(spark):
    rules = [(None, None, "block"), ("a", None, "allow"), ("a", "/", None), ("a/b", "", "block"), ("A", "", "block")]
    urls = [(1, "x://a/b"), (2, "x:///b"), (3, "x://b/"), (4, None)]
    got = url_rules.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == {1: ("a", "block"), 2: ("", "block"), 3: (None, "allow"), 4: ("", "block")}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    rules = spark.createDataFrame([("a", "/", "block")], "host string, path string, verdict string")
    assert url_rules.judge(pages.filter("false"), rules).collect() == []
    assert [tuple(r) for r in url_rules.judge(pages, rules.filter("false")).collect()] == [(1, "a", "/", None, "allow")]
