"""Near-duplicate documents from bottom-k sketches, inverted lists and exact Jaccard similarity.

One hash function maps each five-word shingle to 64 bits; a sketch keeps the k least hashes of a document. Documents
with equal sets become one class first, so copies never meet in pairs. Inverted lists hold the retained hashes of each
class, the rarest ones only: two sets of the wanted similarity share at least `NEED` of a sketch, so they share a value
among a sketch's rarest `1 - NEED` part (values that no other class retains take places there without a list). Pairs
from the lists are estimated on the union of both sketches and verified on the full sets.

A list that many alike documents share would give pairs by the square of its length. So each list first compares all
its members with one pivot; what links becomes one component, and only members of different components meet again. This
repeats while it shrinks the pairs that are left, which then all meet in tasks, by sizes and by bits of a larger sketch,
before their full sets are compared: no link between components is lost but by the sketch's own chance (about 1e-5 for a pair just at the threshold, none for sets of up to k shingles).

Null or empty texts, texts without words: an empty set, linked with nothing. With one to four words, the whole sequence
is the one shingle. Rows that share a doc_id count as one document's; a null doc_id is linked with nothing and kept.
Repeated rows are copies. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm.tables import components, distinct_pairs, faced, facing, stored, whole_blocks
from stratalake.llm.words import as_bytes, fingerprint, list_column, mix, shingle_sets, slices

#: The share of a sketch that similar sets have in common: with k = 64, four standard deviations below 0.75. For sets
#: that are smaller than their sketch it is below what a similarity of 0.75 implies.
NEED = 0.53
#: The same for the larger sketch by whose bits it is decided which pairs of a long list are worth their full sets.
FINE, NEED_FINE = 256, 0.63
#: Bits that tell most pairs apart which such a sketch would not pass.
BITS = 1024
#: Pairs that are looked at together.
PAIRS = 1 << 18


def sketches(docs: DataFrame, k: int = 64) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (fp1, fp2), and the k least hashes in rising order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, one, two, least = [], [], [], []
                for values in shingle_sets(as_bytes(part.column("text"))):
                    a, b = fingerprint(values)
                    sizes.append(len(values))
                    one.append(a)
                    two.append(b)
                    least.append(values[:k])
                columns = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, one, two)), list_column(least, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "fp1", "fp2", "sketch"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(rows, "doc_id long, n_shingles long, fp1 long, fp2 long, sketch array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id, shingles: each document's whole set of shingle hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(as_bytes(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), list_column(sets, pa.int64())], ["doc_id", "shingles"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(rows, "doc_id long, shingles array<long>")


def inverted_lists(heads: DataFrame, need: Column) -> DataFrame:
    """(value, rep): the rarest retained values of each class that other classes retain too.

    `need` is the share of its retained values that a class has in common with any similar one.
    """
    entries = heads.select("rep", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    own = entries.join(shared, "value").groupBy("rep", "kept").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    places = F.size("shared") - F.ceil(F.col("kept") * need).cast("int") + 1
    own = own.withColumn("places", places).filter("places > 0")
    lists = own.select("rep", F.explode(F.slice("shared", F.lit(1), F.col("places"))).alias("entry"))
    return lists.select(F.col("entry.value").alias("value"), "rep")


def pivot_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """Each list's members against one of them, chosen anew in every turn."""
    order = F.struct(F.xxhash64("rep", F.lit(turn)).alias("order"), F.col("rep").alias("pivot"), F.col("component").alias("other"))
    pivots = lists.groupBy("value").agg(F.min(order).alias("p")).select("value", "p.pivot", "p.other")
    pairs = lists.join(pivots, "value").filter("component <> other")
    return pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def promising(a: str, b: str, n_a: str, n_b: str, k: int, percent: int, need: float = NEED) -> Column:
    """Whether sizes allow the similarity and sketches of up to k values promise it (exactly so for sets of up to k)."""
    shared = F.array_intersect(a, b)
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    estimate = F.size(F.array_intersect(shared, union)) >= F.ceil(F.size(union) * need)
    exact = 100 * F.size(shared) >= percent * (F.size(a) + F.size(b) - F.size(shared))
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    # The first tests are the cheap ones; most pairs go no further.
    enough = F.size(shared) >= F.ceil(F.least(F.size(a), F.size(b)) * need)
    return sizes & enough & F.when(F.greatest(n_a, n_b) <= k, exact).otherwise(estimate)


def with_bits(fine: DataFrame) -> DataFrame:
    """The rows with `BITS` more bits of the sketch `fine`, as longs b0, b1, ...: whether an odd number of its values fall on each."""
    names = [f"b{i}" for i in range(BITS // 64)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 10):
                part = batch.slice(start, 1 << 10)
                lists = part.column("fine")
                row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                place = mix(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(BITS)
                odd = np.bincount(row * BITS + place.astype(np.int64), minlength=len(lists) * BITS) & 1
                bits = np.packbits(odd.astype(np.uint8).reshape(len(lists), BITS), axis=1, bitorder="little").view(np.int64)
                columns = [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *names])

    return fine.mapInArrow(rows, ", ".join(["rep long, component long, n_shingles int, fine array<long>", *(f"{n} long" for n in names)]))


def refined(lists: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Lists (value, rep, component) over the `FINE` least values, and those sketches (rep, n_shingles, fine).

    A set below percent of FINE values is whole here, like any similar one: then the exact bound holds, and documents
    that are too different from all others are in no list any more.
    """
    reps = lists.select("rep", "component").distinct()
    fine = sets.join(reps, sets["doc_id"] == reps["rep"]).select(
        "rep", "component", F.size("shingles").alias("n_shingles"), F.slice(F.array_sort("shingles"), 1, FINE).alias("fine")
    )
    fine = stored(with_bits(fine), "fine")
    need = F.when(F.col("kept") < FINE * percent // 100, percent / 100 - 1e-9).otherwise(NEED_FINE)
    found = inverted_lists(fine.select("rep", F.col("fine").alias("sketch")), need).join(reps, "rep")
    return stored(found.select("value", "rep", "component"), "refined"), fine


def meeting(percent: int):
    """For `mapInArrow` over rows of `faced` lists: pairs (a, b) of different components whose sizes and bits allow the similarity.

    The bits drop no pair that shares `NEED_FINE` of the larger sketch.
    """

    def pairs_of(rows: pa.Table) -> Iterator[np.ndarray]:
        rep, component, main, n, kept = (rows.column(c).to_numpy().astype(np.int64) for c in ("rep", "component", "main", "n_shingles", "kept"))
        # Of signed numbers numpy would count the bits of the absolute value.
        bits = np.stack([rows.column(f"b{k}").to_numpy() for k in range(BITS // 64)], axis=1).view(np.uint64)
        for x, y in facing(rows, "value", PAIRS):
            fits = (component[x] != component[y]) & ((component[y] == main[y]) | (rep[x] < rep[y]))
            fits &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            x, y = x[fits], y[fits]
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            fits = differ <= kept[x] + kept[y] - 2 * np.ceil(np.minimum(kept[x], kept[y]) * NEED_FINE).astype(np.int64)
            yield np.stack((rep[x[fits]], rep[y[fits]]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_blocks(batches, "value"):
            yield from distinct_pairs(list(pairs_of(block)))

    return rows


def cross_pairs(lists: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list that are in different components and that sizes and bits allow.

    A list's members outside its largest component meet all others; those inside don't meet each other. Tasks join narrow
    rows, in blocks of a list, and drop what a pair's other lists repeat.
    """
    parts = lists.groupBy("value", "component").agg(F.count("*").alias("n"))
    largest = F.max_by("component", F.struct("n", "component")).alias("main")
    main = parts.groupBy("value").agg(largest, (F.sum("n") - F.max("n")).alias("n_left"), F.sum("n").alias("n_all"))
    narrow = fine.select("rep", "n_shingles", F.size("fine").alias("kept"), *[f"b{k}" for k in range(BITS // 64)])
    rows = lists.join(main.filter("n_left > 0"), "value").join(narrow, "rep")
    rows = faced(rows, "value", "rep", F.col("component") != F.col("main"), "n_left", "n_all")
    return stored(rows.mapInArrow(meeting(percent), "a long, b long").distinct(), "met")


def pass_sketches(pairs: DataFrame, heads: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are promising."""
    side = lambda x: heads.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    return pairs.filter(promising("s_a", "s_b", "n_a", "n_b", k, percent)).select("a", "b")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar."""
    whole = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s_{x}"))
    pairs = pairs.join(whole("a"), "a").join(whole("b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    union = F.size("s_a").cast("long") + F.size("s_b") - common
    return pairs.filter(100 * common >= percent * union).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 64, percent: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A & B| >= percent * |A | B|; component_id is the least doc_id that links reach.
    """
    rows = stored(sketches(docs, k), "sketches")
    usable = rows.filter("doc_id is not null and n_shingles > 0")
    classes = stored(usable.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    heads = usable.join(classes.select(F.col("rep")).distinct(), F.col("doc_id") == F.col("rep"), "left_semi")
    heads = heads.select(F.col("doc_id").alias("rep"), "n_shingles", "sketch").dropDuplicates(["rep", "n_shingles", "sketch"])
    lists = stored(inverted_lists(heads, F.lit(NEED)), "lists")
    wanted = lists.select(F.col("rep").alias("doc_id")).distinct()
    heads = stored(heads.join(wanted, F.col("rep") == F.col("doc_id"), "left_semi"), "heads")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    sets = stored(full_sets(texts), "sets")

    links, groups, before = None, None, None
    for turn in count():
        now = lists.withColumn("component", F.col("rep"))
        if groups is not None:
            now = lists.join(groups, lists["rep"] == groups["id"], "left").select(
                "value", "rep", F.coalesce("component_id", "rep").alias("component")
            )
        parts = stored(now.groupBy("value", "component").agg(F.count("*").cast("double").alias("n")), "parts")
        open_lists = parts.groupBy("value").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q")).filter("n * n > q")
        now = stored(now.join(open_lists.select("value"), "value", "left_semi"), "open")
        entries, pairs = open_lists.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()
        if not pairs:
            break
        last = pairs <= 4 * entries or before is not None and pairs > 0.9 * before
        if last:
            met = cross_pairs(*refined(now, sets, percent), percent)
        else:
            met = pass_sketches(pivot_pairs(now, turn), heads, k, percent)
        found = stored(confirm(met, sets, percent), "links")
        links = found if links is None else links.union(found)
        groups, before = stored(components(links), "groups"), pairs
        if last:
            break

    named = rows.join(classes, ["fp1", "fp2", "n_shingles"], "left").select("doc_id", "n_shingles", "rep")
    if groups is not None:
        named = named.join(groups, named["rep"] == groups["id"], "left").withColumn("rep", F.coalesce("component_id", "rep"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    named = named.select("doc_id", "n_shingles", F.when(linked, F.col("rep")).otherwise(F.col("doc_id")).alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
