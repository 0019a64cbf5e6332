"""A user's record parser as a data source: large files are read in pieces that end where records end.

``register_records(spark, "app_log", parse, "at timestamp, message string")`` makes
``spark.read.format("app_log").load(folder)`` and ``spark.readStream.format("app_log").load(folder)`` work. A piece is a range
of bytes; it holds the records that start in it, so every record belongs to one piece wherever files are cut, and a task
holds one block and one record at a time.
"""

from __future__ import annotations

import fnmatch
import gzip
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructType

#: One record's bytes and its file's name to the rows in it (none for a record to leave out).
RecordParser = Callable[[bytes, str], Iterable[tuple]]
BLOCK = 1 << 20
PIECE = 64 << 20


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    stop: int
    #: Whether a record begins right at the start.
    whole: bool

    def __init__(self, path: str, start: int, stop: int, whole: bool):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop, self.whole = path, start, stop, whole


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    # Hadoop writes local paths with one slash.
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def list_files(uri: str, pattern: str = "*") -> list[tuple[str, int]]:
    """Files below a folder (or the file itself) with their sizes, without hidden ones."""
    store, path = _store(uri)
    info = store.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    if info.type == pafs.FileType.NotFound:
        return []
    found = store.get_file_info(pafs.FileSelector(path, recursive=True))
    inside = [(f, f.path[len(path) :].strip("/").split("/")) for f in found if f.type == pafs.FileType.File]
    return sorted((f.path, f.size) for f, names in inside if fnmatch.fnmatch(names[-1], pattern) and not any(n[0] in "._" for n in names))


def _can_start_anywhere(delimiter: bytes) -> bool:
    """Whether delimiters can't overlap each other, so that a reader finds the same ones wherever it starts."""
    return not any(delimiter.startswith(delimiter[-k:]) for k in range(1, len(delimiter)))


def pieces(path: str, start: int, stop: int, size: int, delimiter: bytes = b"\n") -> list[Piece]:
    """A range of a file, from where a record begins, in pieces of ``size`` bytes.

    Compressed files, and files with delimiters that may overlap, are one piece.
    """
    if path.endswith(".gz") or not _can_start_anywhere(delimiter):
        return [Piece(path, start, stop, True)] if start == 0 or not path.endswith(".gz") else []
    return [Piece(path, a, min(a + size, stop), a == start) for a in range(start, stop, size)]


def records_of(uri: str, piece: Piece, delimiter: bytes, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """The place and bytes of every record that starts in the piece; empty records are left out."""
    store, _ = _store(uri)
    packed = piece.path.endswith(".gz")
    with store.open_input_file(piece.path) as raw:
        source = gzip.GzipFile(fileobj=raw) if packed else raw
        # A delimiter that ends right at the start makes a record begin there.
        at = piece.start if piece.whole else max(0, piece.start - len(delimiter))
        source.seek(at)
        skipping, held, first = not piece.whole, b"", 0
        while True:
            cut = held.find(delimiter, first)
            while cut < 0:
                more = source.read(block)
                if not more:
                    break
                # A delimiter may lie across two blocks.
                look = max(0, len(held) - first - len(delimiter) + 1)
                held, first = held[first:] + more, 0
                cut = held.find(delimiter, look)
            record = held[first:] if cut < 0 else held[first:cut]
            if not skipping:
                if at >= piece.stop and not packed:
                    return
                if record:
                    yield at, record
            if cut < 0:
                return
            skipping, at, first = False, at + len(record) + len(delimiter), cut + len(delimiter)


class _Options:
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("load() needs a path")
        self.uri, self.pattern = options["path"], options.get("pattern", "*")
        self.piece = int(options.get("piecebytes", options.get("pieceBytes", PIECE)))
        self.delimiter = options.get("delimiter", "\n").encode()
        if self.piece < 1 or not self.delimiter:
            raise ValueError("pieceBytes and delimiter must not be empty")


class _Rows:
    """Reads a piece; shared by both readers."""

    def __init__(self, options: dict, parse: RecordParser):
        self.options, self.parse = _Options(options), parse

    def read(self, piece: Piece | None) -> Iterator[tuple]:
        if piece is None:  # what Spark passes where there are no files
            return
        name = piece.path.rsplit("/", 1)[-1]
        for at, record in records_of(self.options.uri, piece, self.options.delimiter):
            for row in self.parse(record, name):
                yield (*row, piece.path, at)


class RecordReader(_Rows, DataSourceReader):
    def partitions(self) -> list[Piece]:
        o = self.options
        return [p for path, size in list_files(o.uri, o.pattern) for p in pieces(path, 0, size, o.piece, o.delimiter)]


class RecordStreamReader(_Rows, DataSourceStreamReader):
    """New files, and what was added to known ones, since the last batch: an offset holds how much of each file was read.

    A file has to grow by whole records, each with its delimiter.
    """

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(list_files(self.options.uri, self.options.pattern))

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        grown = [(path, start.get(path, 0), size) for path, size in sorted(end.items()) if size > start.get(path, 0)]
        return [p for path, a, b in grown for p in pieces(path, a, b, self.options.piece, self.options.delimiter)]

    def commit(self, end: dict) -> None:
        pass


def record_source(name: str, parse: RecordParser, schema: str) -> type[DataSource]:
    """A data source class of that name, whose rows are the parser's, with ``_source_file`` and ``_offset`` (in bytes)."""
    columns = StructType.fromDDL(schema).add("_source_file", StringType()).add("_offset", LongType())

    class Records(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return columns

        def reader(self, schema: StructType) -> DataSourceReader:
            return RecordReader(dict(self.options), parse)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return RecordStreamReader(dict(self.options), parse)

    return Records


def register_records(spark: SparkSession, name: str, parse: RecordParser, schema: str) -> None:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read files of such records."""
    # Tasks get the reader and the parser as they are: neither module has to be installed on the executors.
    for module in {__name__, parse.__module__}:
        cloudpickle.register_pickle_by_value(sys.modules[module])
    spark.dataSource.register(record_source(name, parse, schema))
