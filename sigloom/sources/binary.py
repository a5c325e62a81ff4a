"""Binary files as data sources: read in byte ranges by many tasks, written by tasks that commit or abort together.

Files are opened by `pyarrow.fs` on the executors (local, hdfs, s3, gs and abfs paths), so a range is read and not its file, and no file is
a value. Paths of other schemes, which only Spark's own readers open, are read file by file (`whole_files`), at most 2 GB each.

A source is a class of `Format`: where its records lie in a file, and how their bytes become columns. Columns that the schema asked
for does not have are not decoded. Small files are put together in ranges of one task.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pf
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes that are read and decoded at once, and the first guess of a header's length.
CHUNK, HEADER = 4 << 20, 1 << 16


def opened(uri: str) -> tuple[pf.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is a local one."""
    return pf.FileSystem.from_uri(re.sub("^file:/*", "file:///", uri)) if ":" in uri else (pf.LocalFileSystem(), uri)


def readable(uri: str) -> bool:
    """Whether `pyarrow.fs` knows the scheme and can reach its store."""
    try:
        fs, at = opened(uri)
        fs.get_file_info(at)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


@dataclass(frozen=True)
class Layout:
    """Where the records of a file begin, and the bytes of one."""

    first: int
    size: int


class Format:
    """A kind of file; both functions run on executors."""

    name = ""
    columns: dict[str, str]

    @staticmethod
    def layout(head: bytes) -> Layout:
        """From the first bytes of a file; raises IndexError or struct.error where these are too few."""
        raise NotImplementedError

    @staticmethod
    def decode(path: str, head: bytes, n: int, data: bytes, wanted: list[str]) -> dict[str, pa.Array]:
        """The columns wanted of the records in `data`, of which the first is the file's n-th."""
        raise NotImplementedError


def _header(read: Callable[[int], bytes], length: int, kind: type[Format]) -> tuple[bytes, Layout]:
    import struct

    size = HEADER
    while True:
        head = read(min(size, length))
        try:
            return head, kind.layout(head)
        except (IndexError, struct.error):
            if size >= length:
                raise ValueError("the file ends in its header") from None
            size *= 4


def records(path: str, read_at: Callable[[int, int], bytes], length: int, start: int, end: int, kind: type[Format], wanted: list[str]) -> Iterator[pa.RecordBatch]:
    """The records that begin in the bytes start to end of a file; an incomplete one at the end of the file is left out."""
    head, layout = _header(lambda n: read_at(n, 0), length, kind)
    whole = max(length - layout.first, 0) // layout.size
    place = lambda byte: max(0, -(-(byte - layout.first) // layout.size))
    n, last, step = place(start), min(place(end), whole), max(1, CHUNK // layout.size)
    while n < last:
        many = min(step, last - n)
        columns = kind.decode(path, head, n, read_at(many * layout.size, layout.first + n * layout.size), wanted)
        yield pa.RecordBatch.from_arrays([columns[c] for c in wanted], names=wanted)
        n += many


class _Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, kind: type[Format], files: list[tuple[str, int]], most: int, wanted: list[str]):
        self.kind, self.files, self.most, self.wanted = kind, files, most, wanted

    def __getstate__(self) -> dict:
        # The list of all files is for the planner; a task has its own ranges.
        return self.__dict__ | {"files": []}

    def partitions(self) -> list[InputPartition]:
        out: list[list[tuple[str, int, int, int]]] = [[]]
        room = self.most
        for path, length in self.files:
            at = 0
            while at < length:
                end = min(length, at + room)
                out[-1].append((path, at, end, length))
                room -= end - at
                at = end
                if not room:
                    out.append([])
                    room = self.most
        return [_Ranges(x) for x in out if x] or [_Ranges([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path, start, end, length in partition.ranges:
            fs, at = opened(path)
            with fs.open_input_file(at) as file:
                yield from records(path, file.read_at, length, start, end, self.kind, self.wanted)


def source_of(kind: type[Format]) -> type[DataSource]:
    """The data source of a format."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind.name

        def schema(self) -> str:
            return ", ".join(f"{c} {t}" for c, t in kind.columns.items())

        def reader(self, schema) -> DataSourceReader:
            return _Reader(kind, [tuple(x) for x in json.loads(self.options["files"])], int(self.options["most"]), list(schema.names))

    return Source


def read(spark: SparkSession, kind: type[Format], paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """The records of files, directories or patterns; of the format's columns those wanted."""
    wanted = columns or list(kind.columns)
    schema = ", ".join(f"{c} {kind.columns[c]}" for c in wanted)
    found = [(r["path"], r["length"]) for r in spark.read.format("binaryFile").load(paths).select("path", "length").collect()]
    if not all(readable(p) for p in {re.sub("^([^:]+:/+[^/]*).*", r"\1", p): p for p, _ in found}.values()):
        return whole_files(spark, kind, paths, wanted, schema)
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    spark.dataSource.register(source_of(kind))
    return spark.read.format(kind.name).schema(schema).option("files", json.dumps(sorted(found))).option("most", str(most)).load()


def whole_files(spark: SparkSession, kind: type[Format], paths: str | list[str], wanted: list[str], schema: str) -> DataFrame:
    """The same by Spark's reader of whole files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                yield from records(path, lambda n, at, data=data: data[at : at + n].to_pybytes(), data.size, 0, data.size, kind, wanted)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, schema)


# Writing


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Each task writes beside the directory's files; they get their names only when all tasks have ended well."""

    def __init__(self, directory: str, encode: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, Iterator[bytes]]]], run: str):
        self.directory, self.encode, self.run = directory.rstrip("/"), encode, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = opened(self.directory)
        beside = f"{at}/_temporary-{self.run}"
        fs.create_dir(beside, recursive=True)
        moves = []
        for name, chunks in self.encode(iterator):
            # A task that runs twice writes twice; one of its messages reaches the driver.
            part = f"{beside}/{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as out:
                for chunk in chunks:
                    out.write(chunk)
            moves.append((part, f"{at}/{name}"))
        return _Written(moves)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = opened(self.directory)
        for message in messages:
            for part, place in message.moves if message else []:
                fs.move(part, place)
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        fs, at = opened(self.directory)
        if fs.get_file_info(f"{at}/_temporary-{self.run}").type != pf.FileType.NotFound:
            fs.delete_dir(f"{at}/_temporary-{self.run}")


def write(rows: DataFrame, directory: str, encode: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, Iterator[bytes]]]]) -> None:
    """Writes files: `encode` makes (name, chunks of bytes) of a task's rows, name by name. All files appear, or none."""
    if not readable(directory):
        raise ValueError(f"no file system of pyarrow for {directory}")
    run = uuid.uuid4().hex

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return "sigloom_files"

        def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
            return _Writer(directory, encode, run)

    rows.sparkSession.dataSource.register(Sink)
    rows.write.format("sigloom_files").mode("append").save()


def part_name(suffix: str) -> str:
    return f"part-{TaskContext.get().partitionId():05d}.{suffix}"
