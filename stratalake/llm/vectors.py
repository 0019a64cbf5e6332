"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, rerank by cosine.

From a bounded sample (`SAMPLE` vectors, in the order of a hash of their ids) a rotation is learned that turns centred
vectors into balanced binary codes: principal axes, then alternating between the nearest codes and the rotation that
fits them best. The fit takes one vector of each group of alike ones, so that a large group neither pulls the centre
into itself nor bends the axes. Every vector is coded. Codes are cut into substrings of about log2 of the
number of vectors, so that tables stay selective as the input grows; each vector is stored under its substrings and
asks for them and for all substrings one bit away. Pairs within a Hamming radius are reranked: linked if the cosine of
the original vectors, in double precision, reaches the threshold.

How many rotations (each with all its tables) are needed for the wanted recall is measured: pairs just at the threshold
are made from vectors of the sample and coded, and rotations are added until the tables find as many of them as wanted.
So a direction that all vectors share, which centring takes away and which widens their angles, is counted in. If
`MOST` rotations are not enough, the tables get narrower. A test measures recall against brute force.

Equal vectors are one class with a multiplicity: copies meet nothing in pairs. Vectors that are null, empty, zero, or
hold null or non-finite components link with nothing, nor do vectors of different lengths. Very small and very large
components are no exception: such vectors are scaled before anything is squared. Rows with a null vec_id
link with nothing. Rows that share a vec_id are one node, whose links are united. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm.tables import components, stored
from stratalake.llm.words import mix

SAMPLE, ROUNDS, PAIRS, MOST = 10_000, 40, 1000, 24


@dataclass(frozen=True)
class Coder:
    """Centre and projection that turn a vector into bits."""

    mean: np.ndarray
    axes: np.ndarray

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Up to 64 bits per row as an unsigned number."""
        bits = (unit - self.mean) @ self.axes > 0
        padded = np.zeros((len(unit), 64), np.uint8)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64).ravel()


def spread(unit: np.ndarray, alike: float = 0.8, most: int = 2000) -> np.ndarray:
    """Of the first `most` vectors those that no earlier kept one is alike."""
    unit = unit[:most]
    near = unit @ unit.T >= alike
    free = np.ones(len(unit), bool)
    for i in range(len(unit)):
        if free[i]:
            free[i + 1 :] &= ~near[i, i + 1 :]
    return unit[free]


def fit(unit: np.ndarray, seed: int) -> Coder:
    """Iterative quantisation of unit vectors to min(64, length) bits; few different vectors are not centred."""
    unit = spread(unit)
    mean = unit.mean(axis=0) if len(unit) >= 32 else np.zeros(unit.shape[1])
    centred = unit - mean
    bits = min(64, unit.shape[1])
    _, _, axes = np.linalg.svd(centred.T @ centred)
    projected = centred @ axes[:bits].T
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.where(projected @ rotation > 0, 1.0, -1.0).T @ projected)
        rotation = (left @ right).T
    return Coder(mean, axes[:bits].T @ rotation)


def plan(n: int, bits: int, cosine: float, recall: float) -> tuple[int, int, int]:
    """Tables per rotation, rotations, and the Hamming radius of candidates, for vectors that share no direction."""
    width = max(8, min(32, bits, math.ceil(math.log2(max(2, n)))))
    tables = max(1, bits // width)
    width = bits // tables
    share = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    near = (1 - share) ** width + width * share * (1 - share) ** (width - 1)
    rotations = max(1, math.ceil(math.log(1 - recall) / (tables * math.log(1 - min(near, 0.999999)))))
    radius = math.ceil(bits * share + 6 * math.sqrt(bits * share * (1 - share)))
    return tables, rotations, min(bits, radius)


def threshold_pairs(unit: np.ndarray, cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at the cosine: from the sample, moved in any direction, and towards others of the sample."""
    rng = np.random.default_rng(0)
    one = unit[np.arange(PAIRS) % len(unit)]
    pairs = []
    for move in (rng.normal(size=one.shape), unit[rng.integers(len(unit), size=PAIRS)] - unit.mean(axis=0)):
        move = move - (move * one).sum(axis=1, keepdims=True) * one
        size = np.linalg.norm(move, axis=1, keepdims=True)
        some = size[:, 0] > 1e-6
        if some.any():
            pairs.append((one[some], cosine * one[some] + math.sqrt(max(0.0, 1 - cosine**2)) * move[some] / size[some]))
    return pairs


def coded(unit: np.ndarray, n: int, cosine: float, recall: float) -> tuple[list[Coder], int, int]:
    """Coders, tables per rotation and radius with which the wanted part of threshold pairs meets."""
    bits = min(64, unit.shape[1])
    tables, least, radius = plan(n, bits, cosine, recall)
    pairs, coders, differ = threshold_pairs(unit, cosine), [], []
    while True:
        width = bits // tables
        mask = np.uint64((1 << width) - 1)
        met = [np.zeros(len(a), bool) for a, _ in pairs]
        for r in range(max(least, MOST)):
            if r == len(coders):
                coders.append(fit(unit, r))
                differ.append([coders[r].codes(a) ^ coders[r].codes(b) for a, b in pairs])
            for found, bits_off in zip(met, differ[r], strict=True):
                radius = max(radius, int(np.bitwise_count(bits_off).max()))
                for t in range(tables):
                    found |= np.bitwise_count((bits_off >> np.uint64(t * width)) & mask) <= 1
            if r + 1 >= least and all(found.mean() >= recall for found in met):
                return coders[: r + 1], tables, min(bits, radius)
        if width == 1:  # all pairs meet
            return coders[:1], tables, bits
        # The next narrower tables; what is left over of the bits stays unused.
        while bits // tables == width:
            tables += 1


def _unit(values: pa.Array) -> np.ndarray:
    matrix = np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(values), -1)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


#: Beyond these sizes squares leave the range of doubles; such vectors are first divided by their largest component.
LEAST, LARGEST = 1e-100, 1e100


def scaled(v: Column) -> Column:
    """A vector of which squares can be added; of the usual sizes the vector itself."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.when((top > 0) & ((top < LEAST) | (top > LARGEST)) & (top < float("inf")), F.transform(v, lambda x: x / top)).otherwise(v)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), for the vectors that can link."""
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("v", lambda x: x != 0)
    typed = typed.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & nonzero)
    return typed.select("vec_id", scaled(F.col("v")).alias("v"))


def substrings(classes: DataFrame, coders: list[Coder], tables: int, radius: int) -> DataFrame:
    """Candidate pairs (a, b) of classes from all tables of all rotations."""
    bits = coders[0].axes.shape[1]
    width = bits // tables

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                if not part.num_rows:
                    continue
                unit, ids = _unit(part.column("v")), part.column("vec_id").to_numpy()
                keys, own, codes, asks = [], [], [], []
                for r, coder in enumerate(coders):
                    code = coder.codes(unit)
                    for t in range(tables):
                        piece = (code >> np.uint64(t * width)) & np.uint64((1 << width) - 1)
                        for flip in (0, *(1 << i for i in range(width))):
                            key = mix(mix(piece ^ np.uint64(flip)) + np.uint64(r * tables + t))
                            keys.append(key.view(np.int64))
                            own.append(ids)
                            codes.append(code.view(np.int64))
                            asks.append(np.full(len(ids), flip != 0))
                columns = [np.concatenate(x) for x in (keys, own, codes, asks)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "code", "asks"])

    entries = classes.select("vec_id", "v").mapInArrow(rows, "key long, id long, code long, asks boolean")
    entries = stored(entries, "entries")
    kept = entries.filter(~F.col("asks")).select("key", F.col("id").alias("b"), F.col("code").alias("code_b"))
    near = F.bit_count(F.col("code").bitwiseXOR(F.col("code_b"))) <= radius
    met = entries.join(kept, "key").filter((F.col("id") < F.col("b")) & near)
    return met.select(F.col("id").alias("a"), "b").distinct()


def linked_pairs(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors (vec_id: the least, v, copies), and linked pairs (a, b) of them."""
    classes = usable(vectors).groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count_distinct("vec_id").alias("copies"))
    classes = stored(classes, "vectors")
    links = None
    for (size,) in classes.select(F.size("v")).distinct().collect():
        same = classes.filter(F.size("v") == size)
        sample = same.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
        unit = _unit(sample)
        coders, tables, radius = coded(unit, same.count(), cosine, recall)
        pairs = substrings(same, coders, tables, radius)
        side = lambda x, same=same: same.select(F.col("vec_id").alias(x), F.col("v").alias(f"v_{x}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b")
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
        cos = dot("v_a", "v_b") / (F.sqrt(dot("v_a", "v_a")) * F.sqrt(dot("v_b", "v_b")))
        found = stored(pairs.filter(cos >= cosine).select("a", "b"), "links")
        links = found if links is None else links.union(found)
    if links is None:
        links = vectors.sparkSession.createDataFrame([], "a long, b long")
    return classes, links


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.98) -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other vectors linked directly), component_id, kept."""
    classes, links = linked_pairs(vectors, cosine, recall)
    counts = classes.select(F.col("vec_id").alias("id"), "copies")
    both = links.union(links.select("b", "a"))
    others = both.join(counts, both["b"] == counts["id"]).groupBy("a").agg(F.sum("copies").alias("others"))
    groups = components(links)
    named = classes.select("v", F.col("vec_id").alias("rep"), "copies")
    named = named.join(others, named["rep"] == others["a"], "left").join(groups, named["rep"] == groups["id"], "left")
    named = named.select(
        "v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")
    )
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding").cast("array<double>")).alias("v"))
    result = typed.join(named, "v", "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNotNull(), F.col("n_links")).alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
    return result.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
