"""Ranked lexical search: all documents against a set of queries, in buckets of vectors of like length.

A document is a vector over the queries' terms, a query too, and a score is their product; each side takes the square
root of a term's weight. Documents are stored by length, one folder per half octave. Buckets are searched from the
longest vectors down, in rounds of eight times as many documents each; after a round every query knows the score that a
document must reach to be among its best. By Cauchy-Schwarz a bucket whose longest vector can't reach it is not read for
that query, and not at all if no query is left. Inside a bucket a query's heaviest coordinates are taken until the others
together can't reach the score: only documents that hold one of these are looked at, and dropped unless their part on
these coordinates and the bound for the others reach it. What survives is scored exactly in integers. Bounds are floating
point and get a margin, so they never drop a document that belongs; ties at the threshold stay until ranks are given.

Terms are runs of ASCII letters, digits and characters beyond ASCII; only A to Z are lower-cased. Counts are over all
documents and whole texts. Every row is a document: rows that share a doc_id are ranked each; null doc_ids come after
others of the same score. Null texts and texts without terms have no score. Queries are the distinct (item_id, text)
rows; one without terms gets no rows, neither does a document of score 0. Empty tables give no rows; other columns are
ignored. Queries are taken in blocks, and what is broadcast is a block's terms (`BLOCK_BYTES` of text on average) with
one pass over the documents for each block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm.tables import stored, stored_by
from stratalake.llm.words import as_bytes, slices

BLOCK_BYTES = 4 << 20
FIRST, GROWTH = 1 << 15, 8
PIECE = 1 << 20
SALTS = 64
_MARGIN = 1 + 1e-9

_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    plain, start = (text or b"").translate(_TERM_BYTES), 0
    while start < len(plain):
        end = len(plain)
        if end - start > PIECE:
            cut = plain.rfind(b" ", start, start + PIECE)
            cut = plain.find(b" ", start + PIECE) if cut < 0 else cut
            end = end if cut < 0 else cut + 1
        yield plain[start:end].split()
        start = end


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms, counts of the distinct items that have terms."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [Counter(t for piece in terms(text) for t in piece) for text in as_bytes(part.column("text"))]
                names = pa.array([list(f) for f in found], pa.list_(pa.binary()))
                counts = pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("item_id"), names, counts], ["item_id", "terms", "counts"])

    narrow = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    kind = items.schema["item_id"].dataType.simpleString()
    return narrow.mapInArrow(rows, f"item_id {kind}, terms array<binary>, counts array<bigint>").filter(F.size("terms") > 0)


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), and the known terms with their counts, of every document that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        size = max(1, len(known))
        for batch in batches:
            for part in slices(batch, "text"):
                n = np.zeros(part.num_rows, np.int64)
                keys = []
                for i, text in enumerate(as_bytes(part.column("text"))):
                    for piece in terms(text):
                        n[i] += len(piece)
                        at = np.array([k for k in map(known.get, piece) if k is not None], np.int64)
                        keys.append(np.unique(at + i * size, return_counts=True))
                key = np.concatenate([k for k, _ in keys] or [np.zeros(0, np.int64)])
                tf = np.concatenate([c for _, c in keys] or [np.zeros(0, np.int64)])
                # Pieces of one long text may hold the same term.
                key, place = np.unique(key, return_inverse=True)
                tf = np.bincount(place, weights=tf, minlength=len(key)).astype(np.int64) if len(key) else tf.astype(np.int64)
                offsets = np.concatenate((np.searchsorted(key, np.arange(part.num_rows) * size), [len(key)])).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in ((key % size).astype(np.int32), tf)]
                whole = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])
                yield whole.filter(pa.array(n > 0))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(rows, "doc_id long, n long, terms array<int>, tf array<bigint>")


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _sizes(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.diff(batch.column(name).offsets.to_numpy())


def impacts(counted: DataFrame, weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, terms, impact (the integer part of a score that a term's weight multiplies), length, bucket (2 log2 of it)."""
    shared = counted.sparkSession.sparkContext.broadcast(weight)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, tf, size = _flat(batch, "terms"), _flat(batch, "tf"), _sizes(batch, "terms")
            m = 75 + (25 * batch.column("n").to_numpy() * n_docs) // n_terms
            row = np.repeat(np.arange(batch.num_rows), size)
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
            use = (impact > 0) & (shared.value[term] > 0)
            term, impact, row = term[use], impact[use], row[use]
            length = np.sqrt(np.bincount(row, shared.value[term] * impact.astype(float) ** 2, batch.num_rows))
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            bucket = np.floor(2 * np.log2(np.maximum(length, 1))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (term, impact)]
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *lists, pa.array(length), pa.array(bucket)], ["doc_id", "terms", "impact", "length", "bucket"]
            )
            yield out.filter(pa.array(length > 0))

    return counted.mapInArrow(rows, "doc_id long, terms array<int>, impact array<bigint>, length double, bucket int")


class Queries:
    """A block's queries as sparse vectors, heaviest coordinates first."""

    def __init__(self, items: list[tuple[list[int], list[int]]], weight: np.ndarray):
        self.terms, self.exact, self.root, self.rest = [], [], [], []
        for at, counts in items:
            at, counts = np.array(at, np.int64), np.array(counts, np.int64)
            use = weight[at] > 0
            at, counts = at[use], counts[use]
            order = np.argsort(-counts * np.sqrt(weight[at]), kind="stable")
            at, counts = at[order], counts[order]
            square = counts.astype(float) ** 2 * weight[at]
            self.terms.append(at)
            self.exact.append(counts * weight[at])
            # The length of what is left after the first k coordinates.
            self.rest.append(np.sqrt(np.concatenate((np.cumsum(square[::-1])[::-1], [0.0]))))
        self.length = np.array([r[0] for r in self.rest])
        self.weight = weight


class Best:
    """The best documents of each query seen by a task."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.held = {}

    def add(self, query: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        old = self.held.get(query)
        if old is not None:
            score, doc, null = (np.concatenate(x) for x in zip(old, (score, doc, null), strict=True))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.held[query] = score[order], doc[order], null[order]
        if len(order) == self.k:
            self.least[query] = max(self.least[query], score[order[-1]])


def search_batch(batch: pa.RecordBatch, queries: Queries, best: Best) -> None:
    """Find what a batch of document vectors adds to the best of each query."""
    term, impact, size = _flat(batch, "terms"), _flat(batch, "impact"), _sizes(batch, "terms")
    start = np.concatenate(([0], np.cumsum(size)))
    length = batch.column("length").to_numpy()
    null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    doc = batch.column("doc_id").fill_null(0).to_numpy()
    order = np.argsort(term, kind="stable")
    posted_term, posted_row, posted = term[order], np.repeat(np.arange(batch.num_rows), size)[order], impact[order]
    edge = np.searchsorted(posted_term, np.arange(len(queries.weight) + 1))
    dense = np.zeros(len(queries.weight), np.int64)
    longest = float(length.max())
    for query in np.flatnonzero(queries.length * longest * _MARGIN >= best.least).tolist():
        at, exact, rest = queries.terms[query], queries.exact[query], queries.rest[query]
        need = float(best.least[query])
        # Coordinates until the others alone can't reach the score, not even with the longest vector.
        focus = int(np.searchsorted(-rest * longest * _MARGIN, -need, side="right"))
        score, square = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        for t, x in zip(at[:focus].tolist(), exact[:focus].tolist(), strict=True):
            here = slice(edge[t], edge[t + 1])
            score[posted_row[here]] += x * posted[here]
            square[posted_row[here]] += queries.weight[t] * posted[here].astype(float) ** 2
        left = np.sqrt(np.maximum(length**2 * _MARGIN - square, 0.0))
        rows = np.flatnonzero((score > 0) & ((score + rest[focus] * left) * _MARGIN >= need))
        if not len(rows):
            continue
        dense[at] = exact
        n = size[rows]
        flat = np.repeat(start[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        score = np.add.reduceat(dense[term[flat]] * impact[flat], np.concatenate(([0], np.cumsum(n)[:-1])))
        dense[at] = 0
        keep = score >= best.least[query]
        if keep.any():
            best.add(query, score[keep], doc[rows][keep], null[rows][keep])


def _search(vectors: DataFrame, queries: Queries, least: np.ndarray, k: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((queries, least))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, need = shared.value
        best = Best(need, k)
        for batch in batches:
            if batch.num_rows:
                search_batch(batch, known, best)
        for query, (score, doc, null) in best.held.items():
            columns = [pa.array(np.full(len(score), query, np.int32)), pa.array(doc, mask=null), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    return vectors.select("doc_id", "terms", "impact", "length").mapInArrow(rows, "query int, doc_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank; first within salts, so that no task gets all tasks' finds of a query."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("query", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
    part = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k).drop("rank")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)


def rounds(counts: dict[int, int]) -> Iterator[list[int]]:
    """Buckets from the longest vectors down, in groups of about FIRST documents, then GROWTH times as many each."""
    group, size, most = [], 0, FIRST
    for bucket in sorted(counts, reverse=True):
        group.append(bucket)
        size += counts[bucket]
        if size >= most:
            yield group
            group, size, most = [], 0, most * GROWTH
    if group:
        yield group


def _rank_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    names = {t: i for i, t in enumerate(sorted({bytes(t) for _, ts, _ in items for t in ts}))}
    counted = stored(term_counts(docs, names), "terms")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), np.int64)
    for term, count in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[term] = count
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    queries = Queries([([names[bytes(t)] for t in ts], counts) for _, ts, counts in items], weight)

    vectors = stored_by(impacts(counted, weight, n_docs, max(1, n_terms)), "vectors", ["bucket"])
    counts = dict(vectors.groupBy("bucket").count().collect())
    least, top = np.ones(len(items), np.int64), None
    for group in rounds(counts):
        # The longest vector of a bucket is shorter than 2 ** ((bucket + 1) / 2).
        reach = [b for b in group if (queries.length * 2 ** ((b + 1) / 2) * _MARGIN >= least).any()]
        if not reach:
            break
        found = _search(vectors.filter(F.col("bucket").isin(reach)), queries, least, k)
        found = found if top is None else found.union(top.select("query", "doc_id", "score"))
        top = stored(_top(found, k), "top")
        for query, score in top.filter(F.col("rank") == k).select("query", "score").collect():
            least[query] = max(1, score)
    if top is None:
        top = spark.createDataFrame([], "query int, doc_id long, score long, rank int")
    return top


def rank(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    found = stored(item_terms(items), "items")
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 8)
    blocks = math.ceil((found.agg(F.sum(size)).first()[0] or 0) / block_bytes)
    out = []
    for block in range(blocks):
        mine = found.filter(F.pmod(F.xxhash64("item_id", F.concat_ws(" ", F.transform("terms", lambda t: F.hex(t)))), F.lit(blocks)) == block)
        rows = mine.collect()
        if rows:
            ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"query int, item_id {kind.simpleString()}")
            out.append(_rank_block(docs, rows, k).join(ids, "query").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result
