"""Embedding near duplicates: recall against brute force, and links that are right."""

import numpy as np

from stratalake.llm import vectors
from tests.llm.conftest import Groups

SCHEMA = "vec_id long, embedding array<float>, label int, copies int"


def brute(rows, cosine=0.95):
    ids = [i for i, _ in rows]
    unit = np.array([v for _, v in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    return {(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if ids[a] < ids[b]}


def test_recall_and_precision(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 64))
    rows = [(i, rng.normal(size=64).astype("f4").tolist()) for i in range(800)]
    rows += [(1000 + i, (centres[i % 60] + rng.normal(size=64) * rng.uniform(0.05, 0.35)).astype("f4").tolist()) for i in range(700)]
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    _, links = vectors.linked_pairs(frame)
    got, want = {(r.a, r.b) for r in links.collect()}, brute(rows)
    assert len(want) > 1000 and len(got & want) >= 0.95 * len(want) and got <= want


def test_copies_and_counts(spark):
    rng = np.random.default_rng(1)
    one, two = (rng.normal(size=32).astype("f4") for _ in range(2))
    near = (one + rng.normal(size=32).astype("f4") * 0.02).astype("f4")
    rows = [(9, one), (3, one), (5, one), (4, near), (7, two), (8, 2 * two), (6, -two)]
    frame = spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(frame).collect()}
    groups = Groups()
    links = brute([(i, v) for i, v in rows])
    for a, b in links:
        groups.link(a, b)
    assert got == {i: (sum(i in x for x in links), groups.find(i), groups.find(i) == i) for i, _ in rows}


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]),
        (None, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (10, [1e-30, 2e-30]), (11, [3e38, 3e38]), (12, [0.0, 0.0]), (12, [0.0, 0.0]),
    ]
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    found = vectors.near_duplicates(frame).collect()
    assert len(found) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    for i in (1, 2, 3, 4, 5, 6, 9, 12):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, True)
    assert got[7][1:] == (7, True) and got[8][1:] == (7, False)
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_with_a_shared_direction(spark):
    """Vectors of a mean cosine of about 0.72, and pairs just above the threshold."""
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    shared = unit(rng.normal(size=(1, 64)))
    ones = unit(0.72**0.5 * shared + 0.28**0.5 * unit(rng.normal(size=(800, 64))))
    move = rng.normal(size=ones.shape)
    move = unit(move - (move * ones).sum(axis=1, keepdims=True) * ones)
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack((ones, 0.951 * ones + (1 - 0.951**2) ** 0.5 * move)).astype("f4"))]
    _, links = vectors.linked_pairs(spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA))
    got, want = {(r.a, r.b) for r in links.collect()}, brute(rows)
    assert len(want) >= 800 and len(got & want) >= 0.95 * len(want) and got <= want


def test_planner_ends(monkeypatch):
    """For every number of vectors and bits, and several shared directions, with the wanted part of pairs found."""
    monkeypatch.setattr(vectors, "ROUNDS", 3)
    monkeypatch.setattr(vectors, "PAIRS", 100)
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for bits in (4, 16, 33, 64):
        for share in (0.0, 0.5, 0.72, 0.9):
            some = unit(share**0.5 * unit(rng.normal(size=(1, bits))) + (1 - share) ** 0.5 * unit(rng.normal(size=(300, bits))))
            for n in (1000, 200_000, 4_000_000, 10**9):
                coders, tables, radius = vectors.coded(some, n, 0.95, 0.98)
                width = bits // tables
                assert 1 <= tables <= bits and 0 < radius <= bits
                for one, two in vectors.threshold_pairs(some, 0.95):
                    met = np.zeros(len(one), bool)
                    for coder in coders:
                        differ = coder.codes(one) ^ coder.codes(two)
                        for t in range(tables):
                            met |= np.bitwise_count((differ >> np.uint64(t * width)) & np.uint64((1 << width) - 1)) <= 1
                    assert met.mean() >= 0.98 or width == 1


def test_tiny_and_huge_components(spark):
    rng = np.random.default_rng(6)
    one = rng.normal(size=8)
    near = one + rng.normal(size=8) * 0.01
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate([(one, 1e-200), (near, 1e200), (one, 1.0), (-one, 1e200), (near, 1e-310), (one, 5e306)])]
    rows += [(10 + i, (rng.normal(size=8) * 10.0 ** rng.integers(-250, 250)).tolist()) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    groups = Groups()
    links = brute(plain)
    for a, b in links:
        groups.link(a, b)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(frame).collect()}
    assert got == {i: (sum(i in x for x in links), groups.find(i)) for i, _ in rows}
    assert {got[i][1] for i in (0, 1, 2, 4, 5)} == {0} and got[3][1] == 3
