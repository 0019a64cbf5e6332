"""Line dedup against brute force."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
from stratalake.llm import line_dedup, queries, tables
from tests.llm.conftest import EDGES, words


def brute(rows, similarity=0.75, least=5):
    lines = [(i, k, frozenset(words(x))) for i, t in sorted(rows) for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least]
    gone = {i: [] for i, _ in rows}
    for n, (i, k, s) in enumerate(lines):
        if any(len(s & o) >= similarity * len(s | o) - 1e-9 for _, _, o in lines[:n]):
            gone[i].append(k)
    return gone


def result(df):
    return {r.doc_id: r["removed"] for r in df.collect()}


def test_many_alike_lines(docs):
    """Lines of every likeness, more of them per word than a light list holds."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(6, 30))] for _ in range(6)]
    rows = []
    for i in range(120):
        text = []
        for line in rng.choices(base, k=4):
            line = list(line)
            for _ in range(rng.randrange(6)):
                line[rng.randrange(len(line))] = f"n{rng.randrange(200)}"
            text.append(" ".join(line))
        rows.append((i, "\n".join(text)))
    found = line_dedup.dedup_lines(docs(rows))
    assert result(found) == brute(rows)
    texts = dict(rows)
    for r in found.collect():
        kept = [x for k, x in enumerate(texts[r.doc_id].split("\n")) if k not in r["removed"]]
        assert r.text == "\n".join(kept) and r.n_lines == 4


def test_part_of_the_table(table):
    rows = [(r.doc_id, r.text) for r in table("documents").filter("doc_id < 60").collect()]
    assert result(line_dedup.dedup_lines(table("documents").filter("doc_id < 60"))) == brute(rows)


def test_edge_cases(docs):
    found = line_dedup.dedup_lines(docs(EDGES)).collect()
    assert len(found) == len(EDGES)
    assert all(r["removed"] == [] for r in found)  # equal rows are one document
    assert {r.doc_id: r.text for r in found}[1] is None
    assert "source" in found[0].asDict() and found[0]["score"] == 1
    assert line_dedup.dedup_lines(docs([])).count() == 0


def test_order_and_short_lines(docs):
    line, near = "a b c d e f g h", "a b c d e f g x"
    rows = [(1, f"short line\n{line}"), (2, f"{near}\nshort line\nother words that are all new"), (3, line + "\n" + line)]
    assert result(line_dedup.dedup_lines(docs(rows))) == {1: [], 2: [0], 3: [0, 1]}
    assert result(line_dedup.dedup_lines(docs([(None, line), (7, line)]))) == {None: [0], 7: []}


def test_same_id_with_different_texts(docs):
    line = "a b c d e f g h"
    found = line_dedup.dedup_lines(docs([(1, line + "\nx"), (1, line + "\ny")])).collect()
    assert sorted(len(r["removed"]) for r in found) == [0, 1]


def test_query_and_stage_take_short_lines(spark, docs, tmp_path):
    """Lines of one to four words, also of scripts without spaces, by the registered query and the pipeline's stage."""
    rng = random.Random(3)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 7))) for _ in range(60)] + ["这是一行很长的文字没有空格", "  "]
    rows = [(i, "\n".join(rng.choices(lines, k=3))) for i in range(40)] + [(40, "p q r s\np q r\np q"), (41, "new 这是\nSHORT\nshort")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows, least=1)
    found = queries.op7_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.removed for r in found} == {i: ",".join(map(str, gone)) for i, gone in want.items()}
    assert want[40][-1:] == [1] and want[41] == [2]
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs(rows), str(tmp_path)).collect()}
    cut = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in rows}
    assert kept == {i: t for i, t in cut.items() if t.strip() or not want[i]}


def test_common_words_and_small_parts(docs, monkeypatch):
    """Lists of common words beside packed ones, in many parts of few words, against brute force."""
    rng = random.Random(9)
    base = [[f"w{rng.randrange(80)}" for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    rows = []
    for i in range(90):
        text = []
        for line in rng.choices(base, k=5):
            line = list(line)
            for _ in range(rng.randrange(4)):
                line[rng.randrange(len(line))] = f"n{rng.randrange(60)}"
            text.append(" ".join(line[: rng.randrange(len(line) // 2, len(line)) + 1]))
        rows.append((i, "\n".join(text)))
    want = brute(rows, least=1)
    for common, part in ((1024, 1 << 19), (20, 50)):
        monkeypatch.setattr(line_dedup, "COMMON", common)
        monkeypatch.setattr(line_dedup, "PART", part)
        assert result(line_dedup.dedup_lines(docs(rows), least=1)) == want


def test_lists_are_packed(table):
    """Entries of the lists take few rows, and about 32 bytes each, however many lines there are."""
    found = line_dedup.lists(table("documents"), 0.75, 1)
    lines, rows, entries = found.selectExpr("count_if(kind = -1)", "count_if(kind >= 0)", "sum(octet_length(data)) / 40").first()
    assert entries > 2 * lines and rows < lines / 4


def test_texts_that_lose_nothing_are_not_dealt(docs, monkeypatch):
    """They pass beside the join with what is removed, with all columns; lists of common words meet in blocks."""
    monkeypatch.setattr(line_dedup, "COMMON", 3)
    monkeypatch.setattr(tables, "WIDE", 4)
    rng = random.Random(2)
    rows = [(i, "\n".join(" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 9))) for _ in range(4))) for i in range(40)]
    rows += [(90, None), (91, ""), (92, "\n"), (93, "alone here"), (94, "alone\r\nhere too \n")]
    found = line_dedup.dedup_lines(docs(rows), least=1)
    assert result(found) == brute(rows, least=1)
    by_id = {r.doc_id: r for r in found.collect()}
    for i, text in rows:
        assert by_id[i].n_lines == (0 if text is None else len(text.split("\n"))) and by_id[i].lang == "en"
        if not by_id[i].removed:
            assert by_id[i].text == text
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Union" in plan


def test_lists_of_common_words(docs, monkeypatch):
    """They are packed as others are unless huge, their classes meet as by brute force, and those of other sizes don't."""
    rng = random.Random(8)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 25))] for _ in range(9)]
    rows = []
    for i in range(80):
        text = []
        for line in rng.choices(base, k=5):
            line = list(line)
            for _ in range(rng.randrange(4)):
                line[rng.randrange(len(line))] = f"n{rng.randrange(30)}"
            text.append(" ".join(line[: rng.randrange(len(line) // 2, len(line)) + 1]))
        rows.append((None if i == 70 else i, "\n".join(text)))
    want = brute([(10**6 if i is None else i, t) for i, t in rows], least=1)
    want[None] = want.pop(10**6)
    monkeypatch.setattr(line_dedup, "COMMON", 8)
    # Also with huge lists, in blocks; and with all words in parts of their own.
    monkeypatch.setattr(tables, "WIDE", 4)
    for huge, part in ((1 << 15, 1 << 18), (40, 50), (8, 1 << 18)):
        monkeypatch.setattr(line_dedup, "HUGE", huge)
        monkeypatch.setattr(line_dedup, "PART", part)
        kinds = {r.kind: r["count"] for r in line_dedup.lists(docs(rows), 0.75, 1).groupBy("kind").count().collect()}
        assert (line_dedup.HEAVY in kinds) == (huge < 1 << 15) and (line_dedup.BUSY in kinds) == (huge > 8)
        assert result(line_dedup.dedup_lines(docs(rows), least=1)) == want


def test_blocks_meet_by_size():
    """Of a block's pairs only those of sizes in reach are looked at."""
    rng = np.random.default_rng(1)
    n = rng.integers(1, 400, 600)
    word, left = np.sort(rng.integers(0, 3, 600)), rng.random(600) < 0.5
    rows = pa.table({"left": left, "right": ~left | (rng.random(600) < 0.5), "word": word, "i": np.zeros(600, int), "j": np.zeros(600, int)})
    low, high = np.ceil(0.75 * n).astype(int), n // 3 * 4
    right = rows.column("right").to_numpy()
    want = {(x, y) for x in np.flatnonzero(left) for y in np.flatnonzero(right & (word == word[x]) & (n >= low[x]) & (n <= high[x]))}
    found = [p for x, y in tables.facing(rows, "word", 1000, n, low, high) for p in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(found) == len(set(found)) and set(found) == want
    assert len(found) < 0.5 * sum(len(x) for x, _ in tables.facing(rows, "word", 1000))
