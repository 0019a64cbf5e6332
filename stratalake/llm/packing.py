"""Pack token pieces into sequences of a fixed size, shortest pack first over the histogram of lengths.

Documents become tokens in one pass, which also cuts them: as many full pieces as fit, then the rest. Only the
histogram of lengths (at most one entry per length) reaches the driver. There lengths are placed longest first, always into the pack that holds the fewest tokens among those with room, many
equal packs at a time; the outcome is a table of placements (length, first rank, count, first sequence, offset). Pieces
are ranked within their length by two-level counting and find their sequence by joining that table.

Nulls, empty texts: only the end token. Repeated rows and ids: each row is packed on its own; pieces of rows that share
a doc_id are told apart by their place only. A null doc_id is kept. No rows: no sequences. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm.tables import stored
from stratalake.llm.words import slices

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
)
#: Texts of these characters alone are split alike by every Unicode version; others go through `tokenizers` whole.
_PLAIN = re.compile(r"[\t\n\r -~\xa1-\xac\xae-ɏ]*")
#: Where words depend on the white space around them.
_GAPS = ("\t", "\r", "  ", " \n", "\n ", "\n\n")
_WORDS = 300_000
_loaded: dict[tuple[str, int], Encoder] = {}


class Encoder:
    """Token ids of a byte-level BPE file, as little-endian 32-bit bytes.

    `tokenizers` defines the ids. Plain texts are encoded with `tiktoken` on the same vocabulary (three times as fast,
    the same ids); words met before come from a bounded table.
    """

    def __init__(self, path: str, end_id: int):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = special
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = np.array([end_id], "<u4").tobytes()
        self.first, self.later = Words(self, ""), Words(self, " ")
        self.line_feed = self.plain("\n")

    def plain(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return self.end
        if not _PLAIN.fullmatch(text) or any(token in text for token in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end
        if text[0] in " \n" or text[-1] in " \n" or any(gap in text for gap in _GAPS):
            return self.plain(text) + self.end
        # Between single spaces and line feeds words don't depend on each other.
        parts = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            parts += [self.first[head], *map(self.later.__getitem__, rest), self.line_feed]
        parts[-1] = self.end
        return b"".join(parts)


class Words(dict):
    """Ids of words met so far; a full table encodes further words anew each time."""

    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder.plain(self.before + word)
        if len(self) < _WORDS and len(word) < 40:
            self[word] = ids
        return ids


def tokenize(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece of at most `size` tokens: doc_id, start, length, ids_crc32, doc_tokens.

    `tokenizer` names a file that the tasks can read. Each document's ids are followed by `end_id`; its pieces are
    full except the last one.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                encoder = _loaded.get((tokenizer, end_id))
                if encoder is None:
                    encoder = _loaded[(tokenizer, end_id)] = Encoder(tokenizer, end_id)
                rows, cuts = [], []
                for i, text in enumerate(part.column("text")):
                    ids = encoder.ids(text.as_py() or "")
                    n = len(ids) // 4
                    for a in range(0, n, size):
                        rows.append(i)
                        cuts.append((a, min(size, n - a), zlib.crc32(ids[4 * a : 4 * (a + size)]), n))
                columns = [pc.take(part.column("doc_id"), pa.array(rows, pa.int64()))]
                columns += [pa.array(c, pa.int64()) for c in zip(*cuts, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


def place(histogram: dict[int, int], size: int = 2048) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, count, first sequence, offset) of all pieces below `size`.

    Longest lengths come first; each goes into the packs with the fewest tokens among those with room. Packs of one
    pattern are a range of sequences, and a pack splits only where a length runs out, so there are at most two packs
    per length.
    """
    placements, sequence = [], 0
    packs: list[tuple[int, int, int]] = []  # tokens held, first sequence, count
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if packs and packs[0][0] + length <= size:
                held, first, count = heapq.heappop(packs)
                used = min(left, count)
                if used < count:
                    heapq.heappush(packs, (held, first + used, count - used))
            else:
                held, first, used = 0, sequence, max(1, left * length // size)
                sequence += used
            placements.append((length, rank, used, first, held))
            rank, left = rank + used, left - used
            heapq.heappush(packs, (held + length, first, used))
    return placements


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Give each piece (doc_id, start, length, ...) its sequence_id and its offset there."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    placements = place(histogram, size)

    # Groups within a length hold a small share of a task each, however common the length is.
    share = max(64, sum(histogram.values()) // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    groups = spark.createDataFrame([(k, 1 + n // share) for k, n in histogram.items()] or [(0, 1)], "length long, groups long")
    pieces = pieces.join(F.broadcast(groups), "length").withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("groups"))
    )
    order = Window.partitionBy("length").orderBy("group")
    counts = pieces.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = counts.select("length", "group", (F.sum("n").over(order) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "group").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("within", F.row_number().over(within) - 1).join(before, ["length", "group"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within")).drop("groups", "group", "before", "within")

    table = spark.createDataFrame(placements or [(0, 0, 0, 0, 0)], "length long, first long, used long, sequence long, offset long")
    table = table.withColumnRenamed("length", "of")
    if len(placements) <= 200_000:
        table = F.broadcast(table)
    packed = ranked.join(
        table, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("used"))
    ).withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first"))
    return packed.drop("of", "first", "used", "sequence", "rank")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Tokenize, cut and pack documents (doc_id, text); tokens are made once and their pieces stored."""
    return pack(stored(tokenize(docs, tokenizer, size, end_id), "pieces"), size)


def padding(packed: DataFrame, size: int = 2048) -> DataFrame:
    """Sequences, tokens and padding in total; a sequence whose tokens are a power of two is not padded."""
    each = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    odd = F.col("tokens").bitwiseAND(F.col("tokens") - 1) != 0
    return each.agg(
        F.count("*").alias("sequences"), F.sum("tokens").alias("tokens"),
        F.sum(F.when(odd, size - F.col("tokens")).otherwise(0)).alias("padding"),
    )
