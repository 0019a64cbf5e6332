"""Small helpers for the tests of the corpus operators."""

import re

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    found = words(text)
    if len(found) < 5:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


class Groups:
    """Connected components by union-find."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


@pytest.fixture
def docs(spark):
    """Make a table like documents, with columns that clash with names the operators use."""

    def make(rows):
        data = [(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in rows]
        return spark.createDataFrame(
            data, "doc_id long, text string, lang string, source string, n_chars long, removed string, score int"
        )

    return make


@pytest.fixture
def table(spark, data):
    return lambda name: spark.read.parquet(f"{data}/{name}.parquet")


SENTENCE = "the quick brown fox jumps over a lazy dog while many other small animals watch it from the far side of the river"
EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "one two"), (None, "nobody has this id here"), (6, SENTENCE), (6, SENTENCE)]
