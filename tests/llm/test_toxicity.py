"""Toxicity: held-out accuracy, and what counts as a window."""

import random
import zlib

from stratalake.llm import toxicity
from tests.llm.conftest import EDGES


def corpus(rng, n):
    vocabulary = ["".join(rng.choice(["ta", "ri", "on", "el", "su", "me"]) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    stems = ["grobnix", "vlarp", "zunk", "mudfoot", "krelli"]
    rows = []
    for i in range(n):
        text = rng.choices(vocabulary, k=rng.randrange(5, 80))
        toxic = int(rng.random() < 0.3)
        for _ in range(toxic * rng.randrange(1, 5)):
            text.insert(rng.randrange(len(text) + 1), rng.choice(stems) + rng.choice(["", "en", "ta", "os"]))
        rows.append((i, " ".join(text), toxic))
    return rows


def test_held_out_accuracy(spark, docs):
    rows = corpus(random.Random(8), 900)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    table = docs([(i, t) for i, t, _ in rows])
    scored = toxicity.score(table, toxicity.learn(table, labels), into="rating").collect()
    assert "source" in scored[0].asDict() and scored[0]["score"] == 1
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum((r.rating >= 0.7) == bool(rows[r.doc_id][2]) for r in held)
    assert len(held) > 200 and right >= 0.95 * len(held)
    assert all(0 <= r.rating <= 1 for r in scored)


def test_held_out_rows_are_not_learned_from(spark, docs):
    rows = corpus(random.Random(9), 300)
    table = docs([(i, t) for i, t, _ in rows])
    label = lambda flip: spark.createDataFrame(
        [(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows], "doc_id long, toxic int"
    )
    assert toxicity.learn(table, label(False)) == toxicity.learn(table, label(True))


def test_edge_cases(spark, docs):
    rows = corpus(random.Random(8), 300)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    table = docs([(i, t) for i, t, _ in rows])
    model = toxicity.learn(table, labels)
    found = toxicity.score(docs([*EDGES, (8, "vlarp " * 50_000), (9, "x" * 100_000)]), model).collect()
    assert len(found) == len(EDGES) + 2 and all(r["score"] is not None for r in found)
    assert toxicity.score(docs([]), model).count() == 0
    assert toxicity.learn(docs([]), labels) is None
    assert toxicity.learn(table, labels.filter("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(table, None).collect()} == {0.0}


def test_held_out_rule(spark):
    rows = spark.createDataFrame([(i,) for i in [None, *range(50)]], "doc_id long")
    found = {r[0]: r[1] for r in rows.select("doc_id", toxicity.held_out(rows.doc_id)).collect()}
    assert found == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in [None, *range(50)]}
