"""The pipeline's stages on planted cases, the queries' twins, and the components below several operators."""

import math
import random

import duckdb
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline as pipeline
from stratalake.llm.queries import QUERIES, TWINS
from stratalake.llm.tables import components
from tests.llm.conftest import Groups

TABLES = "documents embeddings pages benchmark labels conversations".split()
STEMS = ["grobnix", "vlarp", "mudfoot", "krelli"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Tables with clean, toxic, copied and contaminated documents; their ids by kind."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice(["ta", "ri", "on", "el", "su", "me", "ko"]) for _ in range(rng.randrange(2, 5))) for _ in range(3000)]
    text = lambda n: "\n".join(" ".join(rng.choices(vocabulary, k=25)) for _ in range(n))
    items = [(j, text(2).replace("\n", " ")) for j in range(10)]
    rows, kinds = [], {}
    for i in range(600):
        kind, body = "clean", text(rng.randrange(2, 8))
        if i % 6 == 1:
            kind, body = "toxic", body + " " + " ".join(rng.choice(STEMS) + rng.choice(["", "ta"]) for _ in range(4))
        elif i % 12 == 2:
            kind, body = "leak", body + "\n" + rng.choice(items)[1]
        elif i % 12 == 3:
            kind, body = "copy", rows[i - 3][1]
        rows.append((i, body))
        kinds[i] = kind
    rows += [(700, None), (701, ""), (None, text(3))]
    folder = str(tmp_path_factory.mktemp("planted"))
    make = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    make([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    make([(i, 1, int(k == "toxic")) for i, k in kinds.items()], "doc_id long, quality int, toxic int", "labels")
    make(items, "item_id long, text string", "benchmark")
    return folder, kinds, rows


def test_stages_keep_and_drop(spark, planted):
    folder, kinds, rows = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, folder), "stage")
        assert docs.columns == names
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    ids = lambda kind: {i for i, k in kinds.items() if k == kind}
    assert len(ids("toxic") & kept["toxicity"]) <= 0.05 * len(ids("toxic"))
    assert ids("clean") <= kept["decontamination"] and {700, 701, None} <= kept["decontamination"]
    assert not ids("copy") & kept["near duplicates"]
    # A passage is gone with its document, or as a line that an earlier document has too.
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert not any(x in (r.text or "") for r in docs.collect() for x in items)
    assert len(kept["near duplicates"] - kept["decontamination"]) >= len(items) / 2
    texts = dict(rows)
    for r in docs.filter("doc_id is not null").collect():
        if kinds.get(r.doc_id) == "clean":
            assert r.text == texts[r.doc_id] and r.n_chars == len(r.text)
    packed = pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.collect()} == kept["decontamination"]


def test_stages_on_empty_tables(spark, planted):
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, folder), "stage")
        assert docs.count() == 0


def test_extra_and_clashing_columns(spark, planted):
    folder = planted[0]
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"score": F.lit("s"), "removed": F.lit(1), "component_id": F.lit(2)})
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, folder), "stage")
    assert {(r["score"], r["removed"], r["component_id"]) for r in docs.collect()} == {("s", 1, 2)}


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else str(value)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twins(name, spark, data):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    twin = connection.execute(TWINS[name])
    columns = [d[0] for d in twin.description]
    names = sorted(columns)
    result = QUERIES[name](spark, data)
    assert sorted(result.columns) == names
    want = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in twin.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in result.collect()) == want


def test_registered():
    assert {k for k in entry_module.queries() if k.startswith("op")} == set(QUERIES) and len(QUERIES) == 10
    assert entry_module.queries()["pipeline"] is pipeline.run


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    edges += [(5, 5), (None, 3), (3, None)]
    groups = Groups()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            groups.link(a, b)
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: groups.find(x) for x in list(groups.parent)}
