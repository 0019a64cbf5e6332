"""Toxicity by compression distance: how much shorter a window gets with a dictionary of toxic text.

Two zstandard dictionaries of equal size share a base trained on ordinary text; one ends with more ordinary text, the
other with toxic text: the passages that set the toxic rows apart from the ordinary ones, the most frequent last. A
window is one word between fixed pieces of the base, so its compressed lengths differ by what the toxic part saves.
A document's gains (the greatest, the second, and how many reach the calibrated threshold) give its score by a logistic
fit on rows that the dictionaries have not seen.

Labels are learned from a bounded sample: at most `SAMPLE_ROWS` rows of `SAMPLE_CHARS` characters or less per class, in
the order of a hash of their ids, and of those the first `SAMPLE_BYTES`. Scoring reads whole texts, each row by itself.

Null or empty texts have no windows and score as such. Null labels are not learned from; a doc_id with several labels
counts as toxic if one of them does. Without labels of both classes every score is 0. Repeated rows score alike; all
columns are kept (an input column of the score's name is replaced). No rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stratalake.llm.words import slices

SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_BYTES = 3000, 20_000, 4 << 20
GRAM, BEFORE, BASE, PIECE, FILL, LONGEST, LEVEL = 5, 6, 8192, 64, 96, 64, 12
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_KNOWN = 400_000
_gains: dict[Model, Gains] = {}


@dataclass(frozen=True)
class Model:
    """The two dictionaries, pieces that frame a window, the gain from which it counts, and the weights of the score."""

    ordinary: bytes
    toxic: bytes
    pieces: tuple[bytes, ...]
    threshold: int
    weights: tuple[float, ...]


class Gains(dict):
    """Bytes that the toxic dictionary saves on a window, kept for the words met first."""

    def __init__(self, model: Model):
        super().__init__()
        self.frames = [(p + b" ", b" " + p[:24]) for p in model.pieces]
        self.sizes = [self._compressor(d) for d in (model.ordinary, model.toxic)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(content), source_size=128, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        known.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=how)

    def __missing__(self, word: bytes) -> int:
        if len(word) > LONGEST:
            return max(self[word[i : i + LONGEST]] for i in range(0, len(word) - LONGEST // 4, LONGEST * 3 // 4))
        # The second least gain over several frames: a toxic passage saves about the same in each, a chance find doesn't.
        low = [LONGEST, LONGEST]
        for front, back in self.frames:
            ordinary, toxic = (len(c.compress(front + word + back)) for c in self.sizes)
            low = sorted([*low, ordinary - toxic])[:2]
            if low[1] <= 1:
                break
        gain = max(0, low[1])
        if len(self) < _KNOWN:
            self[word] = gain
        return gain


def _plain(text: str | None) -> bytes:
    return (text or "").lower().encode()


def _features(text: str | None, gains: Gains, threshold: int) -> tuple[float, float, float]:
    found = np.array([gains[w] for w in set(_WORD.findall(_plain(text)))] or [0])
    found.sort()
    return float(found[-1]), float(found[-2]) if len(found) > 1 else 0.0, float(np.log1p((found >= threshold).sum()))


def _grams(data: bytes) -> np.ndarray:
    """Every run of GRAM bytes as a number."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(a) - GRAM + 1)
    value = np.zeros(n, np.uint64)
    for k in range(GRAM):
        value = value * np.uint64(256) + a[k : k + n]
    return value


def _contexts(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte runs and in how many different contexts each occurs, so that copies of a text count once."""
    keys = []
    for text in set(texts):
        runs = _grams(text)
        before = (runs[:-BEFORE] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        keys.append((runs[BEFORE:] << np.uint64(24)) | before)
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    return np.unique(keys >> np.uint64(24), return_counts=True)


def _telling(toxic: Sequence[bytes], ordinary: Sequence[bytes], odds: float) -> np.ndarray:
    """Byte runs at least `odds` times as frequent in toxic text, and in enough contexts there."""
    runs, count = _contexts(toxic)
    others, other_count = _contexts(ordinary)
    rest = np.zeros(len(runs))
    if len(others):
        at = np.minimum(np.searchsorted(others, runs), len(others) - 1)
        rest = np.where(others[at] == runs, other_count[at], 0)
    share = (count + 0.5) / max(1, sum(map(len, set(toxic)))) / ((rest + 0.5) / max(1, sum(map(len, set(ordinary)))))
    return runs[(count >= max(6, len(set(toxic)) // 120)) & (share > odds)]


def _passages(toxic: Sequence[bytes], ordinary: Sequence[bytes], telling: np.ndarray, odds: float) -> list[bytes]:
    """What telling byte runs cover of words, the most frequent last.

    Each must itself be `odds` times as frequent in toxic text, and stand after several different words there.
    """
    seen: Counter[bytes] = Counter()
    known: dict[bytes, list[bytes]] = {}
    for text in set(toxic):
        for word in set(_WORD.findall(text)):
            if word not in known:
                spaced = b" " + word
                mask = np.zeros(len(spaced) + 2, np.int8)
                for k in np.flatnonzero(np.isin(_grams(spaced), telling)):
                    mask[k + 1 : k + 1 + GRAM] = 1
                edge = np.diff(mask)
                known[word] = [spaced[a:b] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
            seen.update(known[word])
    ours, theirs = b"\n".join(set(toxic)), b"\n".join(set(ordinary))
    kept = []
    for passage, _ in seen.most_common(1000):
        places = [m.start() for m in re.finditer(re.escape(passage), ours)]
        before = {ours[max(0, i - 4) : i] for i in places}
        rate = len(before) / len(ours) / ((theirs.count(passage) + 0.5) / max(1, len(theirs)))
        long_enough = passage.startswith(b" ") or len(passage) > GRAM + 1
        if len(before) >= 4 and rate > odds and long_enough:
            kept.append(passage)
    kept = [p for i, p in enumerate(kept) if not any(p in q for q in kept[:i])]
    return kept[::-1]


def _base(texts: Sequence[bytes], size: int) -> bytes:
    """A dictionary's worth of ordinary text."""
    parts = [t[i : i + 256] for t in texts for i in range(0, len(t), 256)]
    try:
        content = zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from
        content = b" ".join(parts)
    return content[-size:].rjust(size)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic fit by Newton's method, both classes weighing alike."""
    x = np.hstack((x, np.ones((len(x), 1))))
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * 100
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta = beta - np.linalg.solve(curve, slope)
    return beta


def fit(texts: Sequence[str], toxic: Sequence[int], odds: float = 15.0) -> Model | None:
    """Learn from labelled texts: three of five make the dictionaries, the others calibrate. None without both classes."""
    rows = [(_plain(t), int(y)) for t, y in zip(texts, toxic, strict=True)]
    learn, check = [r for i, r in enumerate(rows) if i % 5 < 3], [r for i, r in enumerate(rows) if i % 5 >= 3]
    sides = [[t for t, y in learn if y == k] for k in (0, 1)]
    if not all(sides) or {y for _, y in check} != {0, 1}:
        return None
    ordinary = _base(sides[0], 3 * BASE)
    base = ordinary[-BASE:]
    # A dictionary's last bytes are never matched, so the toxic part is followed by a few of the base.
    tail = b"".join(_passages(sides[1], sides[0], _telling(sides[1], sides[0], odds), odds))[-BASE // 2 :] + b" " + base[:FILL]
    more = ordinary[-2 * BASE :][: len(tail) - FILL - 1] + b" " + base[:FILL]
    pieces = tuple(base[k * BASE // 5 :][:PIECE] for k in range(1, 5))
    model = Model(base + more, base + tail, pieces, 1, ())
    gains = Gains(model)
    best = np.array([_features(t.decode(), gains, 1)[0] for t, _ in check])
    y = np.array([y for _, y in check])
    margin = [(best[y == 1] >= g).mean() - (best[y == 0] >= g).mean() for g in range(1, 16)]
    threshold = 1 + int(np.argmax(margin))
    x = np.array([_features(t.decode(), gains, threshold) for t, _ in check])
    return Model(base + more, base + tail, pieces, threshold, tuple(map(float, _logistic(x, y))))


def held_out(doc_id: Column) -> Column:
    """Rows that must not be learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample of the labelled rows (labels: doc_id, toxic) that are not held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = None
    for k in (0, 1):
        part = known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(SAMPLE_ROWS)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.filter((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS))
    found = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic", order.alias("o"), "doc_id").collect()
    rows, size = [], [0, 0]
    for r in sorted(found, key=lambda r: (r["o"], r["doc_id"], r["text"])):
        size[r["toxic"]] += len(r["text"])
        if size[r["toxic"]] <= SAMPLE_BYTES:
            rows.append(r)
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model | None, into: str = "score") -> DataFrame:
    """Add a score from 0 to 1 (higher: likelier toxic), in the column `into`, to rows with a column text."""
    docs = docs.drop(into)
    if model is None:
        return docs.withColumn(into, F.lit(0.0))
    names = docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = _gains.get(model)
        if gains is None:
            gains = _gains[model] = Gains(model)
        weights = np.array(model.weights)
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([_features(t.as_py(), gains, model.threshold) for t in part.column("text")])
                values = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values)], [*names, into])

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, StructField(into, DoubleType())]))
