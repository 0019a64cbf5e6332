"""Benchmark decontamination against all windows of all documents."""

import random
from collections import Counter

import corpus_pipeline
from stratalake.llm import decontaminate, queries
from tests.llm.conftest import EDGES, words

ITEMS = "item_id long, text string, doc_id int"


def counted(found):
    if len(found) < 5:
        return Counter([tuple(found)]) if found else Counter()
    return Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def brute(rows, items, similarity=0.75):
    found = {}
    for i, text in rows:
        mine = words(text)
        for j, item in items:
            theirs = words(item)
            if not theirs or not mine:
                continue
            size, best = min(len(theirs), len(mine)), 0.0
            if len(theirs) < 5 and len(mine) >= 5:
                continue
            want = counted(theirs)
            for a in range(len(mine) - size + 1):
                have = counted(mine[a : a + size])
                best = max(best, sum((want & have).values()) / sum((want | have).values()))
            if best >= similarity:
                found[(i, j)] = best
    return found


def test_against_all_windows(spark, docs):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(80)}" for _ in range(n)]
    items = [(j, " ".join(text(rng.randrange(8, 60)))) for j in range(40)]
    rows = []
    for i in range(120):
        body = text(rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            passage = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.randrange(len(passage))] = "changed"
            body[(at := rng.randrange(len(body) + 1)) : at] = passage
        rows.append((i, " ".join(body)))
    bench = spark.createDataFrame([(j, t.upper(), 0) for j, t in items], ITEMS)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs(rows), bench).collect()}
    want = brute(rows, items)
    exact = {k for k, v in want.items() if v > 0.85}
    assert len(want) > 60 and exact <= set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 or got[k] <= want[k] for k in got)


def test_items_of_the_whole_table(table):
    bench = [(r.item_id, " " + " ".join(words(r.text)) + " ") for r in table("benchmark").collect()]
    want = {(r.doc_id, j) for r in table("documents").collect() for j, t in bench if t in " " + " ".join(words(r.text)) + " "}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table("documents"), table("benchmark")).filter("similarity = 1").collect()}
    assert want and got == want


def test_edge_cases(spark, docs):
    long = "alpha beta gamma delta epsilon zeta eta theta"
    items = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (None, long, 0), (3, "one two", 0), (4, long, 0), (4, long, 0)], ITEMS
    )
    rows = [*EDGES, (20, f"x {long}. y"), (21, f"{long} " * 20_000), (None, long), (22, "we say one two here often")]
    got = sorted((str(r.doc_id), r.item_id) for r in decontaminate.contaminated(docs(rows), items).collect())
    assert got == sorted([("4", 3), ("5", 3), ("21", 4), ("21", 4), ("None", 4), ("None", 4)])
    assert decontaminate.contaminated(docs([]), items).count() == 0
    assert decontaminate.contaminated(docs(rows), items.filter("item_id = 2")).count() == 0
    assert decontaminate.contaminated(docs(rows), items.limit(0)).count() == 0


def test_blocks_of_items(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    items = [(j, " ".join(f"i{j}w{k}" for k in range(9))) for j in range(5)]
    rows = [(j, f"before {t} after") for j, t in items]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(rows), spark.createDataFrame([(*x, 0) for x in items], ITEMS)).collect()}
    assert got == {(j, j) for j in range(5)}


def test_short_items_inside_documents(spark, docs, tmp_path):
    """By the registered query and the pipeline's stage, against all windows of an item's number of words."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(12)}" for _ in range(n))
    items = [(j, text(j % 4 + 1)) for j in range(12)] + [(12, "这是没有空格的项目"), (13, "one two"), (13, " ".join(f"i{k}" for k in range(9))), (14, "nowhere")]
    rows = [(i, text(rng.randrange(0, 14))) for i in range(60)]
    rows += [(60, "前 这是没有空格的项目 后 a b c"), (61, "we say One two here, one two"), (62, " ".join(f"i{k}" for k in range(9))), (63, None), (64, "nothing of it")]
    want = set()
    for i, body in rows:
        for j, item in items:
            mine, theirs = words(body), words(item)
            places = [a for a in range(len(mine) - len(theirs) + 1) if mine[a : a + len(theirs)] == theirs]
            want |= {(i, j, places[0], len(theirs))} if places else set()
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in items], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.op9_decontamination(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.n_words) for r in found) == sorted(want) and {r.similarity for r in found} == {1.0}
    kept = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs(rows), str(tmp_path)).collect()}
    assert kept == {i for i, _ in rows} - {x[0] for x in want} and {63, 64} <= kept
