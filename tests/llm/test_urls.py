"""URL rules by a cascade of Bloom filters, against rules applied one by one."""

import random

import pytest

from stratalake.llm import url_rules
from stratalake.llm.queries import RULES


def verdict(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = []
    for rule, way in rules:
        site, _, rest = rule.partition("/")
        start = rule[len(site) :]
        if host and (host == site or host.endswith("." + site)) and path.startswith(start):
            fits.append((len(rule), rule, way))
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()}
    assert found == {i: verdict(u, rules) for i, u in enumerate(urls)}


def test_edge_cases(spark):
    urls = [
        None, "", "no scheme", "http://", "http:///net/", "http://NET/", "http://net", "http://net?x", "http://x.net/#a", "a://b://net/",
        "http://notexample.net/en/", "http://EXAMPLE.net/en/x?y", "http://example.net/EN/", "http://a.b.example.com/de/", "http://éx.org/fr/",
        "http://org/fr/", "http://u@example.net:80/en/", "http://example.net/en/", "http://example.net/en/",
    ]
    check(spark, urls, RULES)
    assert url_rules.judge(spark.createDataFrame([], "url string"), RULES).count() == 0


def test_many_rules_need_several_levels(spark):
    rng = random.Random(2)
    name = lambda: ".".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 4)))
    rules = sorted({(f"{name()}/{rng.choice(['', 'x/', 'y/z/', 'q'])}", rng.choice(["allow", "block"])) for _ in range(150)})
    rules = [r for i, r in enumerate(rules) if i == 0 or rules[i - 1][0] != r[0]]
    urls = [f"http://{name()}/{rng.choice(['', 'x/', 'y/z/a', 'qq', 'x', 'y/'])}" for _ in range(1500)]
    check(spark, urls, rules)


def test_cascade_is_exact(spark):
    listed = [f"k{i}" for i in range(300)]
    universe = spark.createDataFrame([(f"k{i}",) for i in range(5000)], "key string")
    levels = url_rules.cascade(listed, universe, 5000)
    assert len(levels) > 2
    from pyspark.sql import functions as F

    inside = {r.key for r in universe.filter(url_rules.member(levels, F.col("key"))).collect()}
    assert inside == set(listed)


def test_conflicting_rules_are_refused(spark):
    with pytest.raises(ValueError):
        url_rules.judge(spark.createDataFrame([], "url string"), [("a/", "allow"), ("A/", "block")])


def test_no_python_in_the_plan(spark, data):
    from stratalake.llm.queries import QUERIES

    for name in ("op1_url_rules", "op6_licenses"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan
