"""Licence scans: phrases against a plain scan, spans of bent templates."""

import re

from stratalake.llm import licenses
from tests.llm.conftest import EDGES


def report(df):
    return licenses.report(*licenses.scan(df)).collect()


def test_phrases_of_the_whole_table(table):
    docs = table("documents")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in report(docs)}
    want = {}
    for r in docs.collect():
        found = licenses.words_of(r.text or "")
        places = [
            (i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()
        ]
        starts = [i for i, _ in places]
        want[r.doc_id] = (len(found), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
    assert got == want


def test_templates_bend(docs):
    mit = re.sub(r"\s+", " ", licenses.TEMPLATES["mit"])
    bent = mit.replace("to deal in the Software", "to deal freely in that Software")
    half = " ".join(mit.split()[:15])
    rows = [(1, f"some words\n{mit}\nmore"), (2, "x " + bent), (3, half), (4, "the of and to in"), (5, f"{half} {'word ' * 200} {half}")]
    got = {r.doc_id: (r.labels, r.score) for r in report(docs(rows))}
    assert got[1] == ("mit", 1.0)
    assert got[2][0] == "mit" and 0.75 <= got[2][1] < 1
    assert all(got[i] == ("", 0.0) for i in (3, 4, 5))


def test_deciding_words(docs):
    """Relatives of a licence cover most of its statement, but not the words that tell it."""
    rows = [
        (1, "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
        (2, "this is not licensed under the GNU General Public License version 2"),
        (3, "Licensed under a Creative Commons Attribution 4.0 International License"),
        (4, "It is licensed under the GNU General Public License, version 3, or later"),
        (5, "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License, and more words"),
        (6, re.sub(r"\s+", " ", licenses.TEMPLATES["apache-2"]).replace("Version 2.0", "Version 1.1")),
        (7, licenses.TEMPLATES["mpl-2"].replace("v. 2.0", "v. 1.1")),
        (8, licenses.TEMPLATES["mpl-2"] + " " + licenses.TEMPLATES["apache-2"]),
    ]
    got = {r.doc_id: r.labels for r in report(docs(rows))}
    assert got == {1: "", 2: "", 3: "cc-by", 4: "gpl-3", 5: "", 6: "", 7: "", 8: "apache-2,mpl-2"}


def test_spans(docs):
    _, spans = licenses.scan(docs([(1, "a b under the MIT license c CC-BY-NC d under the mit License")]))
    assert sorted((r.label, r.start, r.stop, r.phrase) for r in spans.collect()) == [
        ("cc-by-nc", 7, 10, True), ("mit", 2, 6, True), ("mit", 11, 15, True)
    ]


def test_edge_cases(docs):
    rows = [*EDGES, (7, "cc by nc " * 30_000), (8, "Apache License, Version 2"), (8, "Apache License, Version 2")]
    got = report(docs(rows))
    assert len(got) == len(rows)
    assert [r.n_base for r in got if r.doc_id == 7] == [30_000]
    assert [(r.n_base, r.labels) for r in got if r.doc_id == 8] == [(1, "apache-2")] * 2
    assert [(r.n_words, r.labels, r.base_labels, r.first_word) for r in got if r.doc_id in (1, 2)] == [(0, "", "", None)] * 2
    assert report(docs([])) == []
