import random
from datetime import datetime

import pytest

from stratalake.operators import access, products
from stratalake.sources.products import ProductCatalog
from stratalake.sources.tables import Lake

VERSIONS = ["1.0.0", "1.1.0", "1.2.0", "2.0.0", "2.1.0"]


def resolve(spark, versions, constraints):
    have = spark.createDataFrame([("p", v) for v in versions], "product_name string, version string")
    asked = spark.createDataFrame([("p", c) for c in constraints], "product_name string, version_constraint string")
    found = products.resolve_versions(asked, have).collect()
    return {r["version_constraint"]: r["resolved_version"] for r in found}


def test_constraints(spark):
    wanted = {
        "1.1.0": "1.1.0", "latest": "2.1.0", "^1.0.0": "1.2.0", "~1.1.0": "1.1.0", "1.x": "1.2.0", "1.1.x": "1.1.0",
        ">=1.2.0": "2.1.0", ">2.1.0": None, "<=1.2.0": "1.2.0", "<2.0.0": "1.2.0", "<1.0.0": None, "9.9.9": None,
        "^3.0.0": None, "whatever": None, "^1": "1.2.0", "1.2": None, "01.1.0": None,
    }
    assert resolve(spark, VERSIONS, wanted) == wanted


def test_resolution_against_brute_force(spark):
    rng = random.Random(7)
    triples = {(rng.randint(0, 3), rng.randint(0, 4), rng.choice([0, 1, 2, 4095, 4096, 9000])) for _ in range(40)}
    text = ".".join
    constraints = ["latest"]
    for _ in range(150):
        a, b, c = rng.randint(0, 4), rng.randint(0, 5), rng.choice([0, 1, 3, 4095, 4096, 4097, 9000])
        op = rng.choice(["", "^", "~", ">=", ">", "<=", "<", "N.x", "N.M.x"])
        constraints.append({"N.x": f"{a}.x", "N.M.x": f"{a}.{b}.x"}.get(op, f"{op}{a}.{b}.{c}"))

    def best(constraint):
        if constraint == "latest":
            fits = triples
        elif constraint.endswith(".x"):
            head = tuple(int(n) for n in constraint[:-2].split("."))
            fits = {t for t in triples if t[: len(head)] == head}
        else:
            op = constraint.rstrip("0123456789.")
            v = tuple(int(n) for n in constraint[len(op) :].split("."))
            test = {
                "": lambda t: t == v, "^": lambda t: t >= v and t[0] == v[0], "~": lambda t: t >= v and t[:2] == v[:2],
                ">=": lambda t: t >= v, ">": lambda t: t > v, "<=": lambda t: t <= v, "<": lambda t: t < v,
            }[op]
            fits = {t for t in triples if test(t)}
        return text(str(n) for n in max(fits)) if fits else None

    got = resolve(spark, [text(str(n) for n in t) for t in triples], sorted(set(constraints)))
    assert got == {c: best(c) for c in constraints}


def test_latest_is_by_version_not_by_date(spark):
    df = spark.createDataFrame([("p", "10.0.0", 1), ("p", "9.0.0", 2), ("q", "bad", 3)], "product_name string, version string, row_count int")
    assert [(r["product_name"], r["version"]) for r in products.latest_versions(df).collect()] == [("p", "10.0.0")]


RULES = "product_name string, workspace_pattern string, access_level string"
REQUEST = "workspace string, product_name string, requested_level string"


@pytest.mark.parametrize(
    "pattern, level, workspace, asked, granted",
    [
        ("*", "read", "anything", "read", True),
        ("analytics-*", "read", "analytics-bi", "read", True),
        ("analytics-*", "read", "analytics-reporting", "read", True),
        ("analytics-*", "read", "finance", "read", False),
        ("finance", "write", "finance", "read", True),
        ("finance", "write", "finance", "write", True),
        ("finance", "write", "finance", "admin", False),
        ("finance", "write", "finance-team", "read", False),
        ("ops", "admin", "ops", "write", True),
    ],
)
def test_access(spark, pattern, level, workspace, asked, granted):
    rules = spark.createDataFrame([("p", pattern, level), ("other", "*", "admin")], RULES)
    requests = spark.createDataFrame([(workspace, "p", asked)], REQUEST)
    row = access.check_access(requests, rules).first()
    assert row["granted"] is granted
    assert row["matching_rule"] == (pattern if access.check_access(requests, rules).first()["effective_level"] else None)


def test_highest_level_wins(spark):
    rules = spark.createDataFrame([("p", "*", "read"), ("p", "ab*", "admin"), ("p", "abc", "write")], RULES)
    row = access.check_access(spark.createDataFrame([("abc", "p", "admin")], REQUEST), rules).first()
    assert (row["effective_level"], row["matching_rule"], row["granted"]) == ("admin", "ab*", True)


def test_access_against_pattern_join(spark, rows):
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("ab-") for _ in range(rng.randint(1, 4)))
    rules = spark.createDataFrame(
        [(rng.choice("pq"), name() + rng.choice(["", "*"]), rng.choice(["read", "write", "admin"])) for _ in range(25)] + [("q", "*", "read")], RULES
    )
    asked = spark.createDataFrame(sorted({(name(), rng.choice("pqr"), rng.choice(["read", "admin"])) for _ in range(60)}), REQUEST)
    got = {(w, p, l): g for w, p, l, g in rows(access.check_access(asked, rules), "workspace", "product_name", "requested_level", "granted")}
    listed = rules.collect()
    rank = access.LEVEL_RANK
    for (w, p, l), granted in got.items():
        levels = [
            rank[r["access_level"]] for r in listed
            if r["product_name"] == p
            and (w.startswith(r["workspace_pattern"][:-1]) if r["workspace_pattern"].endswith("*") else w == r["workspace_pattern"])
        ]
        assert granted == (max(levels, default=0) >= rank[l])


def test_revoked_and_granted_again(spark, rows):
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    events = spark.createDataFrame(
        [("p", "*", "read", t[0], "a", False), ("p", "*", None, t[1], "a", True), ("p", "x", "read", t[0], "a", False), ("p", "x", "write", t[2], "a", False)],
        access.EVENT_SCHEMA,
    )
    assert rows(access.current_rules(events), "workspace_pattern", "access_level") == [("x", "write")]


# --- publishing and consuming ------------------------------------------------


@pytest.fixture
def shop(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"), "sales")
    lake.create("gold.kpis", spark.createDataFrame([(1, 10.0), (2, 20.0)], "product_id int, revenue double"))
    return lake, ProductCatalog(spark, str(tmp_path / "lake"))


def test_publish_and_consume(spark, shop, rows):
    lake, catalog = shop
    first = catalog.publish(lake, "sales_kpis", "gold.kpis", "1.0.0", "KPIs", ["sales"], sla_freshness_hours=12)
    assert first.row_count == 2
    lake.append("gold.kpis", spark.createDataFrame([(3, 30.0)], "product_id int, revenue double"))
    assert catalog.publish(lake, "sales_kpis", "gold.kpis", "1.1.0").row_count == 3
    catalog.publish(lake, "sales_kpis", "gold.kpis", "2.0.0")

    taken = catalog.consume("reporting", "sales_kpis", "^1.0.0", "kpis")
    assert (taken.version, taken.view) == ("1.1.0", "products_kpis")
    assert spark.sql("select sum(revenue) from products_kpis").first()[0] == 60.0
    total = catalog.query("reporting", "sales_kpis", "select sum(product_id) from {product}", "1.0.0")
    assert total.first()[0] == 3
    assert catalog.read("reporting", "sales_kpis").count() == 3
    assert rows(catalog.subscriptions(), "consumer_workspace", "version_constraint", "local_alias") == [("reporting", "^1.0.0", "kpis")]
    assert catalog.validate_schema("reporting", "sales_kpis", ["revenue", "margin"]) == (False, ["margin"])
    assert "revenue" in catalog.schema_of("sales_kpis")

    catalog.publish(lake, "sales_kpis", "gold.kpis", "1.2.0")
    assert [c.version for c in catalog.refresh_subscriptions("reporting")] == ["1.2.0"]
    assert rows(catalog.available("reporting"), "name", "latest_version", "access_level") == [("sales_kpis", "2.0.0", "read")]
    assert catalog.unsubscribe("sales_kpis", "reporting") and not catalog.unsubscribe("sales_kpis", "reporting")


def test_publish_rules(spark, shop):
    lake, catalog = shop
    catalog.publish(lake, "kpis", "gold.kpis", "1.0.0")
    with pytest.raises(ValueError, match="already exists"):
        catalog.publish(lake, "kpis", "gold.kpis", "1.0.0")
    with pytest.raises(ValueError, match="not a version"):
        catalog.publish(lake, "kpis", "gold.kpis", "1.0")
    other = Lake(spark, lake.root, "thief")
    other.create("gold.kpis", spark.range(1))
    with pytest.raises(PermissionError):
        catalog.publish(other, "kpis", "gold.kpis", "9.0.0")


def test_access_is_needed(shop):
    lake, catalog = shop
    catalog.publish(lake, "kpis", "gold.kpis", "1.0.0")
    assert catalog.revoke("kpis", "*") and not catalog.revoke("kpis", "*")
    with pytest.raises(PermissionError):
        catalog.consume("reporting", "kpis")
    with pytest.raises(PermissionError):
        catalog.subscribe("kpis", "sales")
    catalog.grant("kpis", "rep*", "write")
    check = catalog.check("reporting", "kpis", "read")
    assert (check["granted"], check["effective_level"], check["matching_rule"]) == (True, "write", "rep*")
    with pytest.raises(ValueError, match="no version"):
        catalog.consume("reporting", "kpis", "^7.0.0")


def test_consume_all_goes_on_after_an_error(shop):
    lake, catalog = shop
    catalog.publish(lake, "kpis", "gold.kpis", "1.0.0")
    done, errors = catalog.consume_all("reporting", [("nothing", "latest", None), ("kpis", "1.x", None)])
    assert [c.local_alias for c in done] == ["kpis"]
    assert list(errors) == ["nothing"]


def test_deprecated_products_resolve_but_are_not_listed(shop):
    lake, catalog = shop
    catalog.publish(lake, "kpis", "gold.kpis", "1.0.0", tags=["sales", "kpi"])
    assert products.list_products(catalog.products(), tag="kpi").count() == 1
    assert products.list_products(catalog.products(), owner="nobody").isEmpty()
    catalog.deprecate("kpis", "use v2")
    assert products.list_products(catalog.products()).isEmpty()
    assert products.list_products(catalog.products(), include_deprecated=True).count() == 1
    assert catalog.available("reporting").isEmpty()
    assert catalog.resolve("kpis")["version"] == "1.0.0"


def test_strict_publications_declare_their_schema_changes(spark, shop, rows):
    lake, catalog = shop
    lake.create("gold.prices", spark.createDataFrame([(1, 2.0)], "id int, price double"))
    catalog.publish(lake, "prices", "gold.prices", "1.0.0", strict=True)
    lake.create("gold.prices", spark.createDataFrame([(1, 2.0, "x")], "id bigint, price double, note string"))
    with pytest.raises(ValueError, match="patch step after 1.0.0"):
        catalog.publish(lake, "prices", "gold.prices", "1.0.1", strict=True)
    catalog.publish(lake, "prices", "gold.prices", "1.1.0", strict=True)
    lake.create("gold.prices", spark.createDataFrame([(1, "2.0")], "id bigint, price string"))
    with pytest.raises(ValueError, match="major"):
        catalog.publish(lake, "prices", "gold.prices", "1.2.0", strict=True)
    catalog.publish(lake, "prices", "gold.prices", "2.0.0", strict=True)
    found = rows(catalog.schema_changes("prices"), "version", "path", "change", "level")
    assert found == [
        ("1.1.0", "id", "widened", "minor"), ("1.1.0", "note", "added", "minor"), ("2.0.0", "note", "removed", "major"), ("2.0.0", "price", "retyped", "major")
    ]
