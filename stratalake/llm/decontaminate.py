"""Find benchmark items in documents: SimHash of item-sized windows, then exact weighted-shingle similarity.

Every item gets a 64-bit SimHash of its five-word shingles, each weighing as often as it occurs. In each document, a
window of an item's number of words is fingerprinted in the same way at every place where it could be similar: it must
share at least the wanted part of the item's shingles, which the places of shared shingles tell. The fingerprints are
looked up in an index of the items: RADIUS + 1 blocks of bits each, of which two fingerprints within RADIUS share at
least one; a candidate within RADIUS is verified by the weighted Jaccard similarity (sum of least over sum of greatest
counts). Copies have distance 0; a pair just at 0.75 is beyond RADIUS with a chance of about 1e-3.

The items are the bounded side: their index is sent to the tasks in blocks of `BLOCK_ITEMS`, one pass over the documents
per block. A task reads its documents one after another, whole, and holds fingerprints for a few thousand windows.

Null or empty texts contain nothing; null or empty items, and null item ids, are in nothing. An item of one to four
words is one shingle, which only a document of just these words has; with `short_inside` (as in `op9_decontamination`
and the pipeline) it is looked for in windows of its own number of words, of which only copies match, and the first one
is given. A document shorter than an item is one window.
Repeated rows and repeated items each give their pairs. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.words import SHINGLE, as_bytes, document_words, fold, mix, slices

RADIUS = 20
_SEEN, _WINDOWS = 1 << 20, 4096
BLOCK_ITEMS = 20_000
FOUND = "doc_id long, item_id long, start long, n_words long, similarity double"


@dataclass
class Index:
    """Items by shingle, and by the blocks of their fingerprints."""

    ids: list[int]
    words: list[int]
    runs: list[np.ndarray]
    shingles: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    seen: np.ndarray
    prints: np.ndarray
    blocks: list[tuple[int, int]]
    tables: list[dict[int, set[int]]]


def _signs(shingles: np.ndarray) -> np.ndarray:
    """The 64 bits of each shingle's hash as +1 and -1."""
    bits = np.unpackbits(mix(shingles + np.uint64(1)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _fingerprints(shingles: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """SimHash of the windows of `span` shingles; a tie counts as a set bit."""
    total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_signs(shingles), axis=0, dtype=np.int32)))
    return np.packbits(total[starts + span] >= total[starts], axis=1).view(np.uint64).ravel()


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(_SEEN - 1)).astype(np.int64)


def _shingled(words: np.ndarray) -> np.ndarray:
    return fold(words, min(SHINGLE, len(words))) if len(words) else np.zeros(0, np.uint64)


def build(ids: list[int], texts: list[str]) -> Index | None:
    """The index of a block of items; None if no item has words."""
    hashes, cuts = document_words([t.encode() for t in texts])
    known = [(ids[i], int(b - a), _shingled(hashes[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    if not known:
        return None
    kept, words, runs = map(list, zip(*known, strict=True))
    prints = np.concatenate([_fingerprints(r, np.array([0]), len(r)) for r in runs])
    sets = [np.unique(r) for r in runs]
    shingles, items = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(shingles, kind="stable")
    distinct, starts = np.unique(shingles[order], return_index=True)
    seen = np.zeros(_SEEN, bool)
    seen[_slot(distinct)] = True
    edges = np.linspace(0, 64, RADIUS + 2).astype(int).tolist()
    blocks = [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    tables: list[dict[int, set[int]]] = []
    for low, width in blocks:
        table: dict[int, set[int]] = {}
        for i, value in enumerate(_bits(prints, low, width).tolist()):
            table.setdefault(value, set()).add(i)
        tables.append(table)
    return Index(kept, words, runs, distinct, np.append(starts, len(order)), items[order], seen, prints, blocks, tables)


def build_short(ids: list[int], texts: list[str]) -> dict[int, dict[int, list[int]]]:
    """The ids of items of one to four words, by their number of words and the hash of all of them."""
    hashes, cuts = document_words([t.encode() for t in texts])
    tables: dict[int, dict[int, list[int]]] = {}
    for i, a, b in zip(ids, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if 0 < b - a < SHINGLE:
            tables.setdefault(b - a, {}).setdefault(int(fold(hashes[a:b], b - a)[0]), []).append(i)
    return tables


def _bits(prints: np.ndarray, low: int, width: int) -> np.ndarray:
    return (prints >> np.uint64(low)) & np.uint64((1 << width) - 1)


def _candidates(index: Index, prints: np.ndarray, item: int) -> np.ndarray:
    """The windows that some block's table gives for an item and that are within the radius of it."""
    shared = np.zeros(len(prints), bool)
    for (low, width), table in zip(index.blocks, index.tables, strict=True):
        values = _bits(prints, low, width)
        given = [v for v in np.unique(values).tolist() if item in table.get(v, ())]
        shared |= np.isin(values, np.array(given, np.uint64))
    return np.flatnonzero(shared & (np.bitwise_count(prints ^ index.prints[item]) <= RADIUS))


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two runs of shingles, each weighing as often as it occurs."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(a) + len(b) - common)


def search(index: Index, n_words: int, shingles: np.ndarray, similarity: float) -> list[tuple[int, int, int, float]]:
    """For one document the best window per item: (item id, first word, words, similarity)."""
    hits = np.flatnonzero(index.seen[_slot(shingles)])
    at = np.minimum(np.searchsorted(index.shingles, shingles[hits]), len(index.shingles) - 1)
    same = index.shingles[at] == shingles[hits]
    places: dict[int, list[int]] = {}
    for hit, k in zip(hits[same].tolist(), at[same].tolist(), strict=True):
        for item in index.items[index.starts[k] : index.starts[k + 1]].tolist():
            places.setdefault(item, []).append(hit)
    found = []
    for item, shared in places.items():
        run = index.runs[item]
        size, span = min(index.words[item], n_words), min(len(run), len(shingles))
        need = math.ceil(similarity * len(run))
        if len(shared) < need:
            continue
        # A window that ends in one of these places or shortly after and holds `need` of them; all starts of such.
        marks = np.array(shared)
        ends = marks[need - 1 :]
        low, high = np.maximum(0, ends - span + 1), np.minimum(marks[: len(ends)], len(shingles) - span)
        starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low.tolist(), high.tolist(), strict=True)] or [marks[:0]]))
        best: tuple[int, int, int, float] | None = None
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
            for chunk in np.split(part, range(_WINDOWS, len(part), _WINDOWS)):
                if not len(chunk):
                    continue
                first = int(chunk[0])
                prints = _fingerprints(shingles[first : int(chunk[-1]) + span], chunk - first, span)
                for k in _candidates(index, prints, item).tolist():
                    start = int(chunk[k])
                    value = _similarity(shingles[start : start + span], run)
                    if value >= similarity and (best is None or value > best[3]):
                        best = (index.ids[item], start, size, value)
        if best:
            found.append(best)
    return found


def search_short(table: dict[int, list[int]], n: int, hashes: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Where items of n words first stand in each document: (document, item id, first word, words, similarity)."""
    rolled = fold(hashes, n)
    at = np.flatnonzero(np.isin(rolled, np.fromiter(table, np.uint64, len(table))))
    doc = np.searchsorted(cuts, at, side="right") - 1
    inside = at + n <= cuts[doc + 1]
    seen, found = set(), []
    for d, place in zip(doc[inside].tolist(), at[inside].tolist(), strict=True):
        value = int(rolled[place])
        if (d, value) not in seen:
            seen.add((d, value))
            found += [(d, item, place - int(cuts[d]), n, 1.0) for item in table[value]]
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75, short_inside: bool = False) -> DataFrame:
    """Pairs doc_id, item_id with the best window: start (its first word, from 0), n_words, similarity.

    With `short_inside`, items of one to four words are also found inside longer documents.
    """
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = docs.sparkSession.createDataFrame([], FOUND)
    rows = items.orderBy("item_id", "text").toLocalIterator(prefetchPartitions=True)
    block: list = []
    for row in [*rows, None]:
        if row is not None:
            block.append(row)
        if block and (row is None or len(block) == BLOCK_ITEMS):
            ids, texts = [r["item_id"] for r in block], [r["text"] for r in block]
            short = build_short(ids, texts) if short_inside else {}
            if short:
                size = np.diff(document_words([t.encode() for t in texts])[1])
                left = [(i, t) for i, t, n in zip(ids, texts, size, strict=True) if n >= SHINGLE]
                ids, texts = [i for i, _ in left], [t for _, t in left]
            index = build(ids, texts)
            block = []
            if index is not None or short:
                result = result.unionByName(narrow.mapInArrow(_scanner(index, similarity, short), FOUND))
    return result


def _scanner(index: Index | None, similarity: float, short: dict[int, dict[int, list[int]]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "start", "n_words", "similarity"]
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, cuts = document_words(as_bytes(part.column("text")))
                out, ids = [], part.column("doc_id").to_pylist()
                for n, table in short.items():
                    out += [(ids[d], *f) for d, *f in search_short(table, n, hashes, cuts)]
                rolled = fold(hashes, SHINGLE)
                any_hit = np.concatenate(([0], np.cumsum(index.seen[_slot(rolled)]))) if index else None
                for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if index else ()):
                    if b - a >= SHINGLE:
                        if any_hit[b - SHINGLE + 1] == any_hit[a]:
                            continue
                        shingles = rolled[a : b - SHINGLE + 1]
                    elif b > a:
                        shingles = _shingled(hashes[a:b])
                    else:
                        continue
                    out += [(ids[i], *f) for f in search(index, b - a, shingles, similarity)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows
