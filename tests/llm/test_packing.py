"""Packing: an exact round trip of tokens, and full sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratalake.llm import packing
from tests.llm.conftest import EDGES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, packed, tokenizer, size):
    """Each document's ids lie in exactly one piece each; sequences are gapless and at most full."""
    want = {}
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), size):
            want.setdefault((i, a, len(ids[a : a + size]), zlib.crc32(ids[a : a + size].tobytes()), len(ids)), []).append(1)
    got = packed.collect()
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=str) == sorted(
        (k for k, n in want.items() for _ in n), key=str
    )
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    return sequences


@pytest.mark.parametrize(
    "text",
    ["a  b", "x\n\ny", " lead", "trail ", "it's don't we'll\tx", "日本語 テスト", "<|endoftext|> a", "a\u0085b", "a\xa0b c",
     "x_1 12a ²", "\n", "é\n a", "a\u00adb", "A-b…c", "word" * 500, "\U0001f600 ok", "a\r\nb", "ſ ß ŉ Ǆ"],
)
def test_same_ids_as_the_tokenizer(text, tokenizer):
    ids = packing.Encoder(PATH, 1).ids(text)
    assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_round_trip(table, tokenizer):
    part = table("documents")
    packed = packing.pack_documents(part, PATH)
    rows = [(r.doc_id, r.text) for r in part.collect()]
    sequences = check(rows, packed, tokenizer, 2048)
    tokens = sum(n for pieces in sequences.values() for _, n in pieces)
    assert 2048 * len(sequences) < 1.02 * tokens + 2048


def test_edge_cases(docs, tokenizer):
    rows = [*EDGES, (9, "long " * 40_000), (10, "x")]
    check(rows, packing.pack_documents(docs(rows), PATH, size=64), tokenizer, 64)
    assert packing.pack_documents(docs([]), PATH).count() == 0


def test_placements_cover_every_piece():
    rng = random.Random(4)
    histogram = {rng.randrange(1, 101): rng.randrange(1, 500) for _ in range(60)} | {100: 7}
    placed = packing.place(histogram, 100)
    fill = {}
    for length, rank, used, first, offset in placed:
        assert offset + length <= 100
        for k in range(used):
            assert fill.get(first + k, 0) == offset
            fill[first + k] = offset + length
    assert {n: sum(p[2] for p in placed if p[0] == n) for n in histogram} == histogram
    assert sorted(fill) == list(range(len(fill)))
    assert sum(fill.values()) > 0.95 * 100 * len(fill)


def test_power_of_two_is_not_padded(spark):
    packed = spark.createDataFrame([(0, 1024), (1, 1000), (2, 1024), (2, 1024)], "sequence_id long, length long")
    assert tuple(packing.padding(packed).first()) == (3, 4072, 1048)


def test_white_space_next_to_words_as_the_tokenizer_has_it():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = packing.Encoder(path, 1)
    for text in (" a b", "a b ", "a  b", "a \nb", "a\n b", "a\n\nb", "\na b", "a b\n", "a\tb", "a\rb", "a b\nc d", "a<|endoftext|>b", "a", " "):
        assert encoder.ids(text) == np.array([*encoder.whole.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
