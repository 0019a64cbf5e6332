"""Bottom-k near duplicates and the hashes below them, against brute force."""

import random
from collections import Counter, defaultdict

from stratalake.llm import bottom_k, tables, words as w
from tests.llm.conftest import EDGES, SENTENCE, Groups, shingles, words


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    groups, lists = Groups(), defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in lists[x])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                groups.link(i, j)
        for x in s:
            lists[x].append(i)
    return {i: (len(s), groups.find(i), groups.find(i) == i) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table(table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    assert result(bottom_k.near_duplicates(table("documents"))) == brute(rows)


def test_large_group_of_near_copies(docs):
    """Many documents that are alike to different degrees: pivots, then what is left."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(8)):
            text[rng.randrange(120)] = f"n{rng.randrange(10_000)}"
        rows.append((i, " ".join(text)))
    rows += [(200 + i, " ".join(base)) for i in range(40)]
    assert result(bottom_k.near_duplicates(docs(rows))) == brute(rows)


def test_edge_cases(docs):
    found = bottom_k.near_duplicates(docs(EDGES)).collect()
    assert len(found) == len(EDGES)
    by_id = {r.doc_id: r for r in found}
    assert (by_id[5].component_id, by_id[5].kept, by_id[5].n_shingles) == (4, False, 1)
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept for i in (1, 2, 3))
    assert by_id[None].component_id is None and by_id[None].kept
    assert by_id[6].component_id == 6 and by_id[6].kept
    assert bottom_k.near_duplicates(docs([])).count() == 0


def test_long_text(docs):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    found = result(bottom_k.near_duplicates(docs([(1, text), (2, text + " end"), (3, SENTENCE)])))
    assert found[2] == (149_997, 1, False) and found[1][0] == len(shingles(text)) and found[3][2]


def test_word_hashes_do_not_depend_on_blocks():
    texts = [("Aé b\tC  " + "x" * 50 + " ") * 30_000, "", None, "tail É é"]
    hashes, cuts = w.document_words([None if t is None else t.encode() for t in texts])
    assert [b - a for a, b in zip(cuts[:-1], cuts[1:])] == [len(words(t)) for t in texts]
    ids = dict(zip((x for t in texts for x in words(t)), hashes.tolist()))
    assert [ids[x] for t in texts for x in words(t)] == hashes.tolist()
    assert len(set(ids.values())) == len(ids)


def test_bits_tell_sketches_apart(spark):
    """The bits that differ are never more than the values that do, and many between sketches that share little."""
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(256)]
    fines = [base, base[:250] + [rng.getrandbits(63) for _ in range(6)], [rng.getrandbits(63) for _ in range(256)], base[:3], []]
    rows = [(i, i, len(x), x) for i, x in enumerate(fines)]
    found = bottom_k.with_bits(spark.createDataFrame(rows, "rep long, component long, n_shingles int, fine array<long>")).collect()
    bits = {r.rep: [r[f"b{i}"] for i in range(bottom_k.BITS // 64)] for r in found}
    differ = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(bits[a], bits[b]))
    for a in range(5):
        for b in range(5):
            assert differ(a, b) <= len(set(fines[a]) ^ set(fines[b]))
    assert differ(0, 1) > 0 and differ(0, 2) > 512 - 2 * 0.63 * 256


def test_lists_meet_in_blocks(spark, monkeypatch):
    """A pair that shares many lists is made once, by tasks that hold a part of a list."""
    monkeypatch.setattr(tables, "WIDE", 3)
    monkeypatch.setattr(bottom_k, "PAIRS", 4)
    rng = random.Random(6)
    base = [rng.getrandbits(62) for _ in range(100)]
    fines = {i: sorted(base[: 100 - i % 9] + [rng.getrandbits(62) for _ in range(i % 9 + 30 * (i % 3))]) for i in range(40)}
    component = {i: 0 if i < 12 else i // 2 * 2 for i in fines}
    rows = [(i, component[i], len(x), x) for i, x in fines.items()]
    fine = bottom_k.with_bits(spark.createDataFrame(rows, "rep long, component long, n_shingles int, fine array<long>"))
    lists = spark.createDataFrame([(v, i, component[i]) for v in base[:20] for i in fines], "value long, rep long, component long")
    found = [(r.a, r.b) for r in bottom_k.cross_pairs(lists, fine, 75).collect()]
    share = lambda a, b: len(set(fines[a]) & set(fines[b])) / min(len(fines[a]), len(fines[b]))
    sizes = lambda a, b: 100 * min(len(fines[a]), len(fines[b])) >= 75 * max(len(fines[a]), len(fines[b]))
    every = {(a, b) for a in fines for b in fines if a < b and component[a] != component[b] and sizes(a, b)}
    assert len(found) == len(set(found)) and set(found) <= every
    assert {p for p in every if share(*p) >= bottom_k.NEED_FINE} <= set(found)
