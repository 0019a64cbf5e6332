"""Word and shingle hashes of whole texts, computed block by block with numpy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Bytes hashed at a time; arrays of this length stay in a core's cache.
BLOCK = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FOLD = np.uint64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER[_SPACE] = 0

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base (or of its inverse) modulo 2**64."""
    table = _powers[kind]
    if len(table) < n:
        factor = np.full(max(n, BLOCK + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        factor[0] = 1
        table = np.multiply.accumulate(factor)
        if n <= 4 * BLOCK:
            _powers[kind] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut a buffer at white space into blocks of about BLOCK bytes; only a longer word makes a longer one."""
    start, n = 0, len(data)
    while start < n:
        end, back = min(n, start + BLOCK), min(BLOCK, 256)
        while end < n:
            low = max(start, end - back)
            spaces = np.flatnonzero(_SPACE[data[low:end]])
            if len(spaces):
                end = low + int(spaces[-1]) + 1
                break
            if back == BLOCK:
                end = min(n, end + BLOCK)
            back = BLOCK
        yield start, end
        start = end


def hash_words(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the place of each word's first byte in the joined texts.

    A word is a run of bytes other than space and \\t to \\r; A to Z count as a to z. The texts are joined by one
    line feed, so the place tells which text a word is from.
    """
    data = np.frombuffer(b"\n".join(t or b"" for t in texts), dtype=np.uint8)
    hashes, places = [], []
    for start, end in _blocks(data):
        letters = np.take(_LOWER, data[start:end])
        inside = np.zeros(len(letters) + 2, bool)
        np.not_equal(letters, 0, out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edge[::2], edge[1::2]
        if not len(first):
            continue
        # White space counts nothing, so a word's sum may run up to the next word.
        np.multiply(letters, _power("up", len(letters)), out=letters)
        value = np.add.reduceat(letters, first) * _power("down", len(letters))[first]
        hashes.append(mix(value + (last - first).astype(np.uint64) * _FOLD))
        places.append(first + start)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def text_starts(texts: Sequence[bytes | None]) -> np.ndarray:
    """Where each text starts in the joined texts, and one past the end."""
    return np.concatenate(([0], np.cumsum([len(t or b"") + 1 for t in texts])))


def document_words(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each text's first word (one more entry than texts)."""
    hashes, places = hash_words(texts)
    return hashes, np.searchsorted(places, text_starts(texts))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in rising order, by sorting: `np.unique` hashes them first, at twenty times the cost."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def fold(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words; as many as there are starts."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    value = hashes[:count].copy()
    for k in range(1, n):
        value = value * _FOLD + hashes[k : k + count]
    return mix(value + np.uint64(n))


def shingle_sets(texts: Sequence[bytes | None]) -> Iterator[np.ndarray]:
    """For each text the distinct hashes of its five-word shingles in rising (signed) order.

    With one to four words the whole sequence is the only shingle; without words the set is empty.
    """
    hashes, cuts = document_words(texts)
    rolled = fold(hashes, SHINGLE)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        n = b - a
        if n >= SHINGLE:
            yield distinct(rolled[a : b - SHINGLE + 1].view(np.int64))
        elif n:
            yield fold(hashes[a:b], n).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    """128 bits that tell one set of hashes from another, whatever their order."""
    u = values.view(np.uint64)
    other = mix(u + _BASE)
    return int(np.add.reduce(u).view(np.int64)) if len(u) else 0, int(np.add.reduce(other).view(np.int64)) if len(u) else 0


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows of about `most` bytes of text; one longer text is a run of its own."""
    size = np.zeros(batch.num_rows, np.int64)
    if batch.num_rows:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        size = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(start, end - start)
        base, start = int(size[end - 1]), end


def as_bytes(array: pa.Array) -> list[bytes | None]:
    """The texts of a string column as UTF-8 bytes."""
    return array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()).to_pylist()


def list_column(parts: Sequence[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one numpy array per row."""
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts) if len(parts) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
