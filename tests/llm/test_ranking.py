"""Ranked search against scores of every document, and its SQL twin."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from stratalake.llm import queries, ranking

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    docs = [(i, Counter(w)) for i, t in docs if (w := split(t))]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in docs:
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in split(text)}
            scores.append((-sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in split(text)), i is None, i or 0))
        best = sorted(s for s in scores if s[0] < 0)[:k]
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def made(spark, items):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in items], "item_id long, text string, terms string, score int")


def corpus(rng, n):
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(400)] + ["Ñandú", "x-y", "ÀB", "it's", "中文字", "a_b"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 8, 20, 60, 300])))) for i in range(n)]
    return rows + [(None, "w1 w2 w3"), (None, None), (7, rows[8][1]), (9000, rows[8][1]), (9001, ""), (9002, "-- ,,")]


def test_against_all_documents(spark, docs, monkeypatch):
    """Several rounds, many ties, several blocks of queries."""
    rng = random.Random(6)
    rows = corpus(rng, 500)
    rows += [(10_000 + i, "w1 w2 common copy") for i in range(60)]
    items = [(i, " ".join(rng.choices(rows[rng.randrange(500)][1].split() or ["w1"], k=rng.randrange(1, 25)))) for i in range(40)]
    items += [(50, "common copy"), (51, None), (52, ""), (53, "nowhere seen"), (50, "common copy"), (50, "w3 w3 w3"), (None, "copy Common")]
    monkeypatch.setattr(ranking, "FIRST", 16)
    monkeypatch.setattr(ranking, "GROWTH", 2)
    want = brute(rows, items)
    assert result(ranking.rank(docs(rows), made(spark, items))) == want
    assert result(ranking.rank(docs(rows), made(spark, items), block_bytes=600)) == want


def test_buckets_are_skipped_and_filtered(spark, docs):
    """Bounds spare work: with a known best, batches of short vectors and documents without the heavy terms are not scored."""
    items = [([0, 1], [1, 1])]
    known = ranking.Queries(items, np.array([10_000, 10], np.int64))
    best = ranking.Best(np.array([4_000_000_000]), 2)
    counted = spark.createDataFrame([(i, 10, [0, 1] if i % 10 == 0 else [1], [1, 1] if i % 10 == 0 else [1]) for i in range(100)], "doc_id long, n long, terms array<int>, tf array<long>")
    batch = ranking.impacts(counted.coalesce(1), known.weight, 100, 1000).toArrow().combine_chunks().to_batches()[0]
    ranking.search_batch(batch, known, best)
    score, doc, _ = best.held[0]
    assert doc.tolist() == [0, 10] and score[0] == score[1] == 10_010 * (10**9 // (1000 + 12 * 100))
    before = best.held[0]
    short = batch.filter(batch.column("length").to_numpy() < 1e7)
    assert short.num_rows == 90
    best.least[0] = 10**9
    ranking.search_batch(short, known, best)
    assert best.held[0] is before


def test_long_text_in_pieces(monkeypatch):
    text = ("word " * 100 + "x" * 50 + " é" * 30 + "A1b2").encode()
    whole = [t for piece in ranking.terms(text) for t in piece]
    monkeypatch.setattr(ranking, "PIECE", 16)
    assert [t for piece in ranking.terms(text) for t in piece] == whole == [t.encode() for t in split(text.decode())]


def test_empty_tables(spark, docs):
    items = made(spark, [(1, "a b")])
    assert ranking.rank(docs([]), items).count() == 0
    assert ranking.rank(docs([(1, "a")]), items.limit(0)).count() == 0
    assert result(ranking.rank(docs([(1, None), (2, "a A")]), items)) == brute([(1, None), (2, "a A")], [(1, "a b")])


def test_registered_query_and_twin(spark, data):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    found = result(queries.op11_ranked_search(spark, data))
    twin = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.TWINS['op11_ranked_search']})").fetchall()
    assert found == sorted(twin, key=str) and len(found) >= 800
