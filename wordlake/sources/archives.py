"""Archives and shards that Hadoop can't decode by name, as a Python data source.

``spark.read.format("archive")`` lists the files below a path, by suffix, and makes one input partition per file; its
task streams the file in pieces (`PIECE` bytes) and gives Arrow batches, so no file and no list of its rows is ever held.
Files are opened by `pyarrow.fs`, which takes the URI of any store that it knows. Sinks write one file a partition, under
a name of the attempt that is then given its final name, so a repeated task replaces its own file only.
"""

from __future__ import annotations

import codecs
import gzip
import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE, ROWS = 1 << 20, 8192


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a local path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


class File(InputPartition):
    def __init__(self, uri: str, size: int):
        self.uri, self.size = uri, size


def _pieces(stream) -> Iterator[str]:
    """Decoded text of a byte stream, piece by piece; malformed bytes become the replacement character."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    while data := stream.read(PIECE):
        yield decode(data)
    yield decode(b"", True)


def _lines(pieces: Iterator[str]) -> Iterator[str]:
    rest = ""
    for piece in pieces:
        *whole, rest = (rest + piece).split("\n")
        yield from whole
    if rest:
        yield rest


def _words(pieces: Iterator[str]) -> Iterator[str]:
    rest = ""
    for piece in pieces:
        text = rest + piece
        words = text.split()
        rest = words.pop() if words and not text[-1:].isspace() else ""
        yield from words
    if rest:
        yield rest


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.unit, self.members = options.get("unit", "line"), options.get("members", "first")
        if self.unit not in ("line", "word") or self.members not in ("first", "all"):
            raise ValueError("unit is line or word, members is first or all")

    def partitions(self) -> list[File]:
        store, path = _opened(self.path)
        head = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else "file://"
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(path, recursive=True))
        return [File(head + f.path, f.size) for f in sorted(found, key=lambda f: f.path)
                if f.is_file and f.path.endswith(self.suffix) and not f.base_name.startswith(("_", "."))]

    def _members(self, file: File) -> Iterator[tuple[str, object]]:
        store, path = _opened(file.uri)
        if file.uri.endswith(".zip"):
            with store.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
                names = [i.filename for i in z.infolist() if not i.is_dir()]
                for name in names[:1] if self.members == "first" else names:
                    with z.open(name) as stream:
                        yield name, stream
        else:
            with store.open_input_stream(path, compression=None) as raw:
                zipped = file.uri.endswith((".gz", ".gzip"))
                yield "", gzip.GzipFile(fileobj=io.BufferedReader(raw)) if zipped else raw

    def read(self, file: File) -> Iterator[pa.RecordBatch]:
        names = ["path", "length", "member", "pos", "value"]
        for member, stream in self._members(file):
            units = (_words if self.unit == "word" else _lines)(_pieces(stream))
            held, start = [], 0

            def batch(values, start, member=member):
                n = len(values)
                return pa.RecordBatch.from_arrays([pa.array([file.uri] * n), pa.array([file.size] * n, pa.int64()), pa.array([member] * n),
                                                   pa.array(range(start, start + n), pa.int64()), pa.array(values, pa.string())], names=names)

            for value in units:
                held.append(value)
                if len(held) == ROWS:
                    yield batch(held, start)
                    held, start = [], start + ROWS
            if held:
                yield batch(held, start)


class ArchiveSource(DataSource):
    """Options: ``suffix`` (of file names), ``unit`` (line or word), ``members`` of a zip archive (first or all)."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "path string, length long, member string, pos long, value string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archive(spark: SparkSession, path: str, suffix: str = "", unit: str = "line", members: str = "first") -> DataFrame:
    """(path, length, member, pos, value): the lines or whitespace-separated words of zip archives (first or all members),
    gzip files of any suffix and plain files; ``length`` is the file's size, for a check."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("suffix", suffix).option("unit", unit).option("members", members).load(path)


def write_shards(df: DataFrame, value_col: str, path: str, suffix: str, files: int) -> int:
    """Writes a string column as lines to ``files`` shards ``part-<n><suffix>`` (.zip, .gzip or .gz); the number of lines."""
    store, folder = _opened(path)
    store.create_dir(folder, recursive=True)
    attempt = uuid.uuid4().hex

    def write(batches):
        store, folder = _opened(path)
        part, n = TaskContext.get().partitionId(), 0
        final, own = f"{folder}/part-{part:05d}{suffix}", f"{folder}/.{attempt}-{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(own) as raw:
            packed = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) if suffix == ".zip" else None
            out = packed.open(f"part-{part:05d}.txt", "w", force_zip64=True) if packed else gzip.GzipFile(fileobj=raw, mode="wb", mtime=0)
            for batch in batches:
                for value in batch.column(0).to_pylist():
                    if value is not None:
                        out.write(value.encode() + b"\n")
                        n += 1
            out.close()
            if packed:
                packed.close()
        store.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    done = df.select(value_col).repartition(files).mapInArrow(write, "n long")
    return sum(r["n"] for r in done.collect())  # one number a file
