"""Line dedup: an exact set-similarity join of lines, and removal of later matches.

A line is the set of its words (split at white space, A-Z lower-cased). Lines are ordered by (doc_id, line number). A
line with at least `least` distinct words is removed if an earlier such line has a Jaccard similarity of `similarity`
or more; it does not matter whether the earlier one is itself removed. Shorter lines, and lines without words, always
stay; `op7_line_dedup` and the pipeline take every line with words (`least` 1).

Lines with equal sets become a class; only its first line can stay. For the others: words are ordered by rarity (from
counts over all documents, kept in a table of fixed size, which only ever merges counts), and two similar sets share a
word among the rarest `n - ceil(similarity * n) + 1` of each; a word that stands in one place only is not listed. Lists
are joined under the length filter, the positional filter and a bound on the differing words from bitmaps, packed by part
of the words, in tasks that hold a part. The list of a common word (in more than `COMMON` places) could give pairs by the square of its length: its classes first meet only one of
the earliest, and those that match are removed and done; the rest then meet all whose size and place leave room. A list of more than `HUGE` places is not held by one
task but in blocks. Candidates are verified on the full sets of 64-bit word hashes, read from the texts again.

Null or empty texts have no lines that can match. Null doc_ids sort last. Rows with the same doc_id: their lines are
told apart by a hash of the text, and equal rows count as one document, whose lines stay or go together. All columns
are kept; text is replaced by the lines that stay, joined as before. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from stratalake.llm.tables import distinct_pairs, drop_part, faced, facing, stored, stored_by, whole_blocks
from stratalake.llm.words import as_bytes, distinct, hash_words, list_column, mix, slices

CELLS = 1 << 22
#: Places of a word from which its classes first meet one of the earliest only, and from which its list is more than a task should hold.
COMMON, HUGE = 1024, 1 << 15
_HASH_BITS = np.uint64((1 << 40) - 1)

#: Rows of four kinds: a line (`EVERY`), an entry of a huge list (`HEAVY`), and the entries of other lists for a part of the
#: words, packed: those of common words (`BUSY`), and all others (kind: the turn that joins them).
LINE = "kind int, doc_id long, copy long, line int, n int, id long, set2 long, word long, at int, sign1 long, sign2 long, part int, data binary"
_LINE = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in LINE.split(", ")])
EVERY, HEAVY, BUSY = -1, -2, -3
ENTRY, KINDS = ("word", "id", "n", "at", "sign1", "sign2"), (np.int64, np.int64, np.int32, np.int32, np.uint64, np.uint64)
NO_ID = 2**63 - 1
KNOWN, TURNS = 300_000, 6
#: Cells whose counts travel as one row; words of text per part of the lists; entries that a task packs at a time; pairs
#: that are looked at together.
BLOCK, PART, HELD, PAIRS = 1 << 16, 1 << 18, 1 << 17, 1 << 18


class Lines:
    """The lines of some texts as sets of words, ordered by rarity."""

    def __init__(self, texts: list[bytes | None], rarity: np.ndarray | None, least: int):
        data = np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)
        breaks = np.flatnonzero(data == 10)
        hashes, places = hash_words(texts)
        line = np.searchsorted(breaks, places)
        # The word's hash keeps 40 bits here; verification uses all 64.
        word = hashes >> np.uint64(24)
        rank = np.zeros(len(word), np.uint64) if rarity is None else rarity[_cell(word)].astype(np.uint64)
        self.n_lines = len(breaks) + 1
        # Lines with words, numbered as they come, so that line, rank and word fit 64 bits.
        new = np.concatenate(([True], line[1:] != line[:-1]))[: len(line)]
        self.numbers, dense = line[new], np.cumsum(new) - 1
        parts = []
        cuts = np.searchsorted(dense, np.arange(0, len(self.numbers) + (1 << 16), 1 << 16))
        for block, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            key = ((dense[a:b] - (block << 16)).astype(np.uint64) << np.uint64(48)) | (rank[a:b] << np.uint64(40)) | word[a:b]
            parts.append((block, distinct(key)))
        self.line = np.concatenate([(k >> np.uint64(48)).astype(np.int64) + (b << 16) for b, k in parts] or [np.zeros(0, np.int64)])
        self.rank = np.concatenate([(k >> np.uint64(40)).astype(np.uint8) for _, k in parts] or [np.zeros(0, np.uint8)])
        self.word = np.concatenate([k & _HASH_BITS for _, k in parts] or [np.zeros(0, np.uint64)])
        self.size = np.bincount(self.line, minlength=len(self.numbers)) if len(self.numbers) else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.at = np.arange(len(self.line)) - np.repeat(self.first, self.size)
        self.use = self.size >= least
        # The text and the line within it, for each numbered line.
        ends = np.cumsum([(t or b"").count(b"\n") + 1 for t in texts])
        self.text = np.searchsorted(ends, self.numbers, side="right")
        self.within = self.numbers - np.concatenate(([0], ends))[self.text]

    def prefix(self, similarity: float) -> np.ndarray:
        """Which entries are in their line's prefix."""
        length = self.size - np.ceil(similarity * self.size - 1e-9).astype(np.int64) + 1
        return (self.at < np.repeat(length, self.size)) & np.repeat(self.use, self.size)


def _cell(word: np.ndarray) -> np.ndarray:
    """The place of a word in the table of counts."""
    return (word & np.uint64(CELLS - 1)).astype(np.int64)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _counts(docs: DataFrame, work, cells: int) -> tuple[np.ndarray, int]:
    """Counts per cell over all documents, on a logarithmic scale, and their sum; `work` gives the cells that some texts add to."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(cells, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                np.add.at(count, work(as_bytes(part.column("text"))), 1)
        # A row holds the counts of a range of cells: places in it, then counts.
        for block in range(0, cells, BLOCK):
            some = np.flatnonzero(count[block : block + BLOCK])
            if len(some):
                data = _pack([some.astype(np.uint32), count[block + some]])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, pieces in _by_part(batches, "block"):
            count = np.zeros(BLOCK, np.int64)
            for piece in pieces:
                some, n = _unpack(piece, (np.uint32, np.int64))
                count[some] += n
            # One byte per cell tells all that is needed: a count's size on a logarithmic scale.
            level = np.minimum(np.floor(8 * np.log2(np.maximum(count, 1))) + 1, 255).astype(np.uint8) * (count > 0)
            columns = [pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([int(count.sum())], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "level", "n"])

    blocks = _narrow(docs).mapInArrow(rows, "block int, data binary").repartition("block").sortWithinPartitions("block")
    table, total = np.zeros(cells, np.uint8), 0
    for r in blocks.mapInArrow(summed, "block int, level binary, n long").collect():
        level = np.frombuffer(r.level, np.uint8)[: cells - r.block]
        table[r.block : r.block + len(level)] = level
        total += r.n
    return table, total


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers as bytes, first all lowest bytes of a column, so that its leading zeros compress."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def _unpack(data: bytes, kinds: tuple) -> list[np.ndarray]:
    """The columns that `_pack` took."""
    widths = [np.dtype(k).itemsize for k in kinds]
    n, start, columns = len(data) // sum(widths), 0, []
    for kind, width in zip(kinds, widths, strict=True):
        piece = np.frombuffer(data, np.uint8, n * width, start).reshape(width, n)
        columns.append(np.ascontiguousarray(piece.T).view(kind).ravel())
        start += n * width
    return columns


def _by_part(batches: Iterator[pa.RecordBatch], column: str, name: str | None = None) -> Iterator[tuple]:
    """The data of each part of rows sorted by part; and, if the rows have such a column, the names that come without data."""
    now, held, names = None, [], []
    out = lambda: (now, held, np.array(names, np.int64)) if name else (now, held)
    for batch in batches:
        given = batch.column(name).to_pylist() if name and name in batch.schema.names else [None] * batch.num_rows
        for part, data, one in zip(batch.column(column).to_pylist(), batch.column("data").to_pylist(), given, strict=True):
            if part != now and (held or names):
                yield out()
                held, names = [], []
            now = part
            if data is None:
                names.append(one)
            else:
                held.append(data)
    if held or names:
        yield out()


def _level(n: int) -> int:
    return min(255, int(8 * math.log2(n)) + 1)


def lists(docs: DataFrame, similarity: float, least: int) -> DataFrame:
    """Every line of enough words: one row without a word, and one per listed prefix word."""
    context = docs.sparkSession.sparkContext

    def all_words(texts):
        return _cell(hash_words(texts)[0] >> np.uint64(24))

    table, total = _counts(docs, all_words, CELLS)
    rarity, single, common, huge = context.broadcast(table), _level(1), _level(COMMON), _level(max(COMMON, HUGE))
    parts = TURNS * (1 + total // (TURNS * PART))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        held: dict[int | None, list] = {None: [], BUSY: []}
        waiting = dict.fromkeys(held, 0)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = as_bytes(part.column("text"))
                found = Lines(texts, rarity.value, least)
                use = np.flatnonzero(found.use)
                if not len(use):
                    continue
                spread = mix(found.word + np.uint64(7))
                one = np.add.reduceat(mix(found.word), found.first).view(np.int64)
                two = np.add.reduceat(spread, found.first).view(np.int64)
                signs = [
                    np.bitwise_xor.reduceat(np.where((spread >> np.uint64(63)) == half, np.uint64(1) << (spread >> np.uint64(57) & np.uint64(63)), np.uint64(0)), found.first).view(np.int64)
                    for half in (0, 1)
                ]
                # A task lists the words of a class once.
                new = np.zeros(len(found.use), bool)
                for i, name in zip(use.tolist(), one[use].tolist(), strict=True):
                    if name not in known:
                        new[i] = True
                        if len(known) < KNOWN:
                            known.add(name)
                listed = np.flatnonzero(found.prefix(similarity) & (found.rank > single) & np.repeat(new, found.size))
                line = found.text[use]
                ids = part.column("doc_id").to_pylist()
                yield _rows(
                    EVERY, len(use), doc_id=pa.array([ids[i] for i in line.tolist()], pa.int64()), copy=np.array([hash_text(t) for t in texts], np.int64)[line],
                    line=found.within[use].astype(np.int32), n=found.size[use].astype(np.int32), id=one[use], set2=two[use],
                )
                level = found.rank[listed]
                for kind, some in ((HEAVY, listed[level > huge]), (BUSY, listed[(level > common) & (level <= huge)]), (None, listed[level <= common])):
                    if not len(some):
                        continue
                    of = found.line[some]
                    entries = [found.word[some].view(np.int64), one[of], found.size[of].astype(np.int32), found.at[some].astype(np.int32), *(sign[of] for sign in signs)]
                    if kind == HEAVY:
                        yield _rows(HEAVY, len(some), doc_id=pa.array([ids[i] for i in found.text[of].tolist()], pa.int64()), **dict(zip(ENTRY, entries, strict=True)))
                        continue
                    if kind == BUSY:
                        entries.append(np.array([NO_ID if i is None else i for i in ids], np.int64)[found.text[of]])
                    held[kind].append(entries)
                    waiting[kind] += len(some)
                    if waiting[kind] > HELD:
                        yield _dealt(held[kind], parts, kind)
                        held[kind], waiting[kind] = [], 0
        for kind in held:
            if waiting[kind]:
                yield _dealt(held[kind], parts, kind)

    return _narrow(docs).mapInArrow(rows, LINE)


def _rows(kind: int, count: int, **columns) -> pa.RecordBatch:
    """A batch of `LINE` of one kind; columns that are not given are null."""
    arrays = [columns[f.name] if f.name in columns else pa.nulls(count, f.type) for f in _LINE]
    arrays = [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, _LINE, strict=True)]
    arrays[_LINE.get_field_index("kind")] = pa.array(np.full(count, kind, np.int32))
    return pa.RecordBatch.from_arrays(arrays, schema=_LINE)


def _dealt(held: list, parts: int, kind: int | None) -> pa.RecordBatch:
    """Entries of lists, one row for each part of the words; without a kind the parts take turns."""
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    # Numbers of 16 bits are sorted by their digits.
    part = (columns[0] % parts).astype(np.uint16 if parts <= 1 << 16 else np.int32)
    order = np.argsort(part, kind="stable")
    columns, part = [c[order] for c in columns], part[order]
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    data = pa.array([_pack([c[a:b] for c in columns]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())
    part = part[edges[:-1]].astype(np.int32)
    given = {"kind": pa.array(part % TURNS if kind is None else np.full(len(part), kind, np.int32)), "part": pa.array(part), "data": data}
    return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(len(part), f.type) for f in _LINE], schema=_LINE)


def _most(n: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
    """The largest size of a similar set whose first shared word stands at `at`: the set still has room for what both must share."""
    share = similarity / (1 + similarity)
    return np.minimum(np.floor(n / similarity + 1e-9), np.floor((n - at) / share - n + 1e-6)).astype(np.int64)


def _listed(pieces: list[bytes], kinds: tuple) -> list[np.ndarray]:
    """The entries of packed lists, each class once in a list, by word and size."""
    columns = [np.concatenate(c) for c in zip(*(_unpack(p, kinds) for p in pieces), strict=True)]
    # Equal words, and then equal classes, stand together: a class has one size.
    order = np.lexsort((columns[1], columns[2], columns[0]))
    columns = [c[order] for c in columns]
    word, name = columns[:2]
    # Several tasks may have listed a class; the smallest of a further column counts.
    new = np.concatenate(([True], (word[1:] != word[:-1]) | (name[1:] != name[:-1])))
    further = [np.minimum.reduceat(c, np.flatnonzero(new)) for c in columns[len(KINDS) :]]
    return [*(c[new] for c in columns[: len(KINDS)]), *further]


def first_meeting(similarity: float):
    """For `mapInArrow` over rows (part, data) of common words: candidate pairs of a list's earliest class (a) and another (b)."""
    share = similarity / (1 + similarity)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pieces in _by_part(batches, "part"):
            word, name, n, at, one, two, since = _listed(pieces, (*KINDS, np.int64))
            n, at = n.astype(np.int64), at.astype(np.int64)
            order = np.lexsort((name, since, word))
            new = np.concatenate(([True], word[1:] != word[:-1]))
            # Sorted by word either way, so a list has the same places in both orders.
            x, y = order[np.flatnonzero(new)][np.cumsum(new) - 1], np.arange(len(word))
            need = np.ceil((n[x] + n[y]) * share - 1e-9).astype(np.int64)
            differ = np.bitwise_count(one[x] ^ one[y]).astype(np.int64) + np.bitwise_count(two[x] ^ two[y])
            fits = (x != y) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9)
            fits &= (np.minimum(n[x] - at[x], n[y] - at[y]) >= need) & (differ <= n[x] + n[y] - 2 * need)
            a, b = name[x[fits]], name[y[fits]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), part, np.int32)), pa.array(a), pa.array(b)], ["part", "a", "b"])

    return rows


def meeting(similarity: float, kinds: tuple = KINDS):
    """For `mapInArrow` over rows (part, data) sorted by part: candidate pairs (a, b) of classes that share a listed word.

    The filters are those of `_close`. Lists are sorted by the sets' sizes, so a class only meets those that may fit its size.
    Rows without data name classes (id) that have been removed: two of them don't meet.
    """

    def pairs_of(pieces: list[bytes], gone: np.ndarray) -> Iterator[np.ndarray]:
        word, name, n, at, one, two, *_ = _listed(pieces, kinds)
        over = np.isin(name, gone)
        group = np.cumsum(np.concatenate(([False], word[1:] != word[:-1])))
        n, at = n.astype(np.int64), at.astype(np.int64)
        share = similarity / (1 + similarity)
        stop = np.searchsorted(group << 32 | n, group << 32 | np.maximum(_most(n, at, similarity), 0), side="right")
        meets = np.maximum(stop - np.arange(len(n)) - 1, 0)
        total = np.concatenate(([0], np.cumsum(meets)))
        start = 0
        while start < len(n):
            end = max(start + 1, int(np.searchsorted(total, total[start] + PAIRS, side="right")) - 1)
            x = np.repeat(np.arange(start, end), meets[start:end])
            y = x + 1 + np.arange(len(x)) - (total[x] - total[start])
            need = np.ceil((n[x] + n[y]) * share - 1e-9).astype(np.int64)
            fits = np.minimum(n[x] - at[x], n[y] - at[y]) >= need
            if len(gone):
                fits &= ~(over[x] & over[y])
            x, y, need = x[fits], y[fits], need[fits]
            differ = np.bitwise_count(one[x] ^ one[y]).astype(np.int64) + np.bitwise_count(two[x] ^ two[y])
            fits = (differ <= n[x] + n[y] - 2 * need) & (n[x] >= similarity * n[y] - 1e-9)
            yield np.stack((name[x[fits]], name[y[fits]]))
            start = end

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces, gone in _by_part(batches, "part", "id"):
            if pieces:
                yield from distinct_pairs(list(pairs_of(pieces, gone)))

    return rows


def common_meeting(similarity: float):
    """For `mapInArrow` over `faced` rows of common words: candidate pairs (a, b), by the filters of `_close`, each once in a block.

    What has been removed meets only what has not.
    """
    share = similarity / (1 + similarity)

    def pairs_of(rows: pa.Table) -> Iterator[np.ndarray]:
        name, n, at, one, two = (rows.column(c).to_numpy().astype(np.int64) for c in ("id", "n", "at", "sign1", "sign2"))
        over = rows.column("over").to_numpy()
        # Of signed numbers numpy would count the bits of the absolute value.
        one, two = one.view(np.uint64), two.view(np.uint64)
        # Only sizes that may fit: by themselves, and by the room that the words from here on leave.
        low = np.ceil(similarity * n - 1e-9).astype(np.int64)
        high = np.maximum(_most(n, at, similarity), 0)
        for x, y in facing(rows, "word", PAIRS, n, low, high):
            fits = (name[x] != name[y]) & (over[y] | (name[x] < name[y]))
            x, y = x[fits], y[fits]
            need = np.ceil((n[x] + n[y]) * share - 1e-9).astype(np.int64)
            fits = np.minimum(n[x] - at[x], n[y] - at[y]) >= need
            x, y, need = x[fits], y[fits], need[fits]
            differ = np.bitwise_count(one[x] ^ one[y]).astype(np.int64) + np.bitwise_count(two[x] ^ two[y])
            fits = differ <= n[x] + n[y] - 2 * need
            yield np.stack((name[x[fits]], name[y[fits]]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_blocks(batches, "word"):
            yield from distinct_pairs(list(pairs_of(block)))

    return rows


def maybe_among(spark: SparkSession, ids: DataFrame, name: str = "doc_id", bits: int = 1 << 23) -> Column:
    """Whether a row's doc_id (or another long) may be among those of ids, by a bitmap of fixed size: true for all that are.

    Few others are true while there are fewer ids than bits. Only the place in the bitmap goes to Python, not the row.
    """
    place = F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("place"), F.lit(64)).cast("int"))
    words = ids.select(place.alias("place")).groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(one).alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    shared = spark.sparkContext.broadcast(table.view(np.uint64))

    @F.arrow_udf("boolean")
    def among(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False).astype(np.uint64)
        return pa.array(((shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool))

    return among(place)


def hash_text(text: bytes | None) -> int:
    """A 63-bit hash of a text, equal in every process."""
    return xxhash.xxh3_64_intdigest(text or b"") >> 1


def line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, copy, line, words: the full sets of the wanted lines (doc_id, copy, line)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, sets = [], []
                for doc, text, lines in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "lines")), strict=True):
                    copy, split = hash_text(text.encode()), text.encode().split(b"\n")
                    for copy_wanted, line in {(x["copy"], x["line"]) for x in lines}:
                        if copy_wanted == copy:
                            ids.append((doc, copy, line))
                            sets.append(distinct(hash_words([split[line]])[0]).view(np.int64))
                columns = list(zip(*ids, strict=True)) or [()] * 3
                kinds = (pa.int64(), pa.int64(), pa.int32())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, list_column(sets, pa.int64())], ["doc_id", "copy", "line", "words"])

    by_doc = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("copy", "line")).alias("lines")).withColumnRenamed("doc_id", "d")
    among = maybe_among(docs.sparkSession, by_doc.select(F.col("d").alias("doc_id")))
    texts = _narrow(docs).filter("text is not null").filter(among).join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")))
    return texts.select("doc_id", "text", "lines").mapInArrow(rows, "doc_id long, copy long, line int, words array<long>").distinct()


def _close(similarity: float):
    """The filters of the join of x and y: length, position, and the bound that the bitmaps give.

    Similar sets meet in the first word that they share, where both have room for all that they must share.
    """
    n_x, n_y = F.col("x.n"), F.col("y.n")
    need = F.ceil((n_x + n_y) * (similarity / (1 + similarity)) - 1e-9)
    after = F.least(n_x - F.col("x.at"), n_y - F.col("y.at"))
    differ = sum(F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in ("sign1", "sign2"))
    return (
        (F.least(n_x, n_y) >= similarity * F.greatest(n_x, n_y) - 1e-9) & (after >= need) & (differ <= n_x + n_y - 2 * need)
    )


def _meet(left: DataFrame, right: DataFrame, which, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of classes that share a listed word."""
    pairs = left.alias("x").join(right.alias("y"), (F.col("x.word") == F.col("y.word")) & which & _close(similarity))
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _later(docs: DataFrame, pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Of the candidate pairs whose full sets are similar, the class (id, first) that comes later."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    places = stored(classes.join(ids, "id", "left_semi").select("id", "first"), "places")
    sets = line_sets(docs, places.select("first.doc_id", "first.copy", "first.line"))
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.copy") == F.col("copy")) & (F.col("first.line") == F.col("line"))
    sets = stored(places.join(sets, same).select("id", "first", "words"), "sets")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("first").alias(f"f_{x}"), F.col("words").alias(f"w_{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("w_a", "w_b"))
    union = F.size("w_a") + F.size("w_b") - common
    later = F.when(F.col("f_a") < F.col("f_b"), F.struct(F.col("b").alias("id"), F.col("f_b").alias("first"))).otherwise(
        F.struct(F.col("a").alias("id"), F.col("f_a").alias("first"))
    )
    return pairs.filter(common >= similarity * union - 1e-9).select(later.alias("l")).select("l.*").distinct()


def removed_lines(docs: DataFrame, similarity: float = 0.75, least: int = 5) -> DataFrame:
    """Lines to remove: doc_id, copy (which text, if a doc_id has several), line (from 0)."""
    table = stored_by(lists(docs, similarity, least), "lines", ["kind"])
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "copy", "line").alias("place")
    keys = ["id", "set2", "n"]
    every = table.filter(F.col("kind") == EVERY).select(*keys, place)
    classes = stored(every.groupBy(*keys).agg(F.min("place").alias("first"), F.count("*").alias("lines")), "classes")

    # A common word's classes: all against one of the earliest, then what is left against all. Huge lists first: their
    # entries are rows of their own, as no task should hold a list.
    since = F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("since")
    heavy = table.filter(F.col("kind") == HEAVY).groupBy("word", "id").agg(*[F.first(c).alias(c) for c in ("n", "at", "sign1", "sign2")], since)
    heavy = stored(heavy, "heavy")
    pivots = heavy.groupBy("word").agg(F.min_by(F.struct("id", "n", "at", "sign1", "sign2"), F.struct("since", "id")).alias("p")).select("word", "p.*")
    packed = table.filter(F.col("kind") == BUSY).select("part", "data")
    firsts = packed.repartition("part").sortWithinPartitions("part").mapInArrow(first_meeting(similarity), "part int, a long, b long")
    firsts = stored(firsts, "firsts")
    early = _meet(pivots, heavy, F.col("x.id") != F.col("y.id"), similarity).union(firsts.select(F.least("a", "b"), F.greatest("a", "b")))
    early = stored(early.distinct(), "early")
    done = stored(_later(docs, early, classes, similarity), "done")
    over = done.select("id").distinct()
    heavy = heavy.join(over.withColumn("over", F.lit(True)), "id", "left").withColumn("over", F.col("over").isNotNull())
    heavy = stored(heavy, "heavy")
    counts = heavy.groupBy("word").agg(F.count_if(~F.col("over")).alias("n_left"), F.count("*").alias("n_all")).filter("n_left > 0")
    left_over = faced(heavy.drop("since").join(counts, "word"), "word", "id", ~F.col("over"), "n_left", "n_all")
    left_over = left_over.mapInArrow(common_meeting(similarity), "a long, b long").distinct()
    # Those that fit a list lie in a task, with what it needs to know of them.
    told = firsts.select("part", F.explode(F.array("a", "b")).alias("id")).distinct().join(over, "id", "left_semi")
    told = told.select("part", F.lit(None).cast("binary").alias("data"), "id")
    busy = packed.withColumn("id", F.lit(None).cast("long")).union(told).repartition("part").sortWithinPartitions("part")
    busy = busy.mapInArrow(meeting(similarity, (*KINDS, np.int64)), "a long, b long")

    # Other words stand in few lines: all their classes meet, in tasks that hold the lists of some words.
    found = [stored(left_over, "pairs"), stored(busy, "pairs")]
    for turn in range(TURNS):
        # Words take turns, so that few lists are shuffled at a time; those that have been joined are dropped.
        part = table.filter(F.col("kind") == turn).select("part", "data").repartition("part").sortWithinPartitions("part")
        found.append(stored(part.mapInArrow(meeting(similarity), "a long, b long"), "pairs"))
        drop_part(table, "kind", turn)
    pairs = reduce(lambda a, b: a.union(b), found).distinct().join(early, ["a", "b"], "left_anti")
    pairs = stored(pairs, "pairs")
    gone = done.union(_later(docs, pairs, classes, similarity)).distinct().withColumnRenamed("id", "gone").withColumnRenamed("first", "at_place")

    # The first lines of removed classes, and every line that repeats one: only classes of several lines have those.
    many = classes.filter("lines > 1").select(*keys, "first")
    repeats = every.filter(maybe_among(docs.sparkSession, many, "id")).join(many, keys).filter(F.col("place") != F.col("first"))
    return gone.select("at_place.*").union(repeats.select("place.*")).select("doc_id", "copy", "line").distinct()


def dedup_lines(
    docs: DataFrame, similarity: float = 0.75, least: int = 5, count: str = "n_lines", removed: str = "removed"
) -> DataFrame:
    """The rows of docs without the removed lines, and two columns: the number of lines, and the removed ones (sorted).

    Input columns of these two names are replaced.
    """
    gone = removed_lines(docs, similarity, least)
    per_text = gone.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    per_doc = per_text.groupBy(F.col("doc_id").alias("__doc__")).agg(F.collect_list(F.struct("copy", "removed")).alias("__gone__"))
    # Stored, so that what it took is off the disk before the texts are dealt by doc_id; texts that lose nothing stay where they are.
    per_doc = stored(per_doc, "gone")
    names = [c for c in docs.columns if c not in (count, removed)]
    among = maybe_among(docs.sparkSession, per_doc.select(F.col("__doc__").alias("doc_id")))
    marked = docs.select(*names).withColumn("__among__", among)
    joined = marked.filter("__among__").drop("__among__").join(per_doc, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc__")), "left").drop("__doc__")
    whole = marked.filter("not __among__").drop("__among__")
    fields = [f for f in joined.schema.fields if f.name in names]
    schema = StructType([*fields, StructField(count, IntegerType()), StructField(removed, ArrayType(IntegerType()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, counts, cut = [], [], []
                for text, every in zip(part.column("text").to_pylist(), part.column("__gone__").to_pylist(), strict=True):
                    copy = None if text is None or not every else hash_text(text.encode())
                    lines = next((x["removed"] for x in every or () if x["copy"] == copy), [])
                    split = [] if text is None else text.split("\n")
                    skip = set(lines)
                    texts.append("\n".join(x for i, x in enumerate(split) if i not in skip) if lines else text)
                    counts.append(len(split))
                    cut.append(lines)
                kept = {n: part.column(n) for n in names}
                kept["text"] = pa.array(texts, part.column("text").type)
                columns = [*kept.values(), pa.array(counts, pa.int32()), pa.array(cut, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, [*names, count, removed])

    breaks = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("int")
    whole = whole.select(*names, breaks.alias(count), F.array().cast("array<int>").alias(removed))
    return joined.mapInArrow(rows, schema).unionByName(whole)
