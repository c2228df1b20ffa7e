"""Byte ranges of files, read by the tasks that need them: no task or row holds a whole file."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of a file that one task reads, and bytes fetched at once
RANGE_BYTES, FETCH_BYTES = 64 << 20, 4 << 20
#: tasks among which ranges are dealt at most
MOST_TASKS = 20_000


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """(the file system of a path, the path in it): local and mounted paths, and the stores that pyarrow knows."""
    local = re.fullmatch(r"(?:file:/*)?(/.*|[^:]*)", re.sub("^file:/+", "/", path))
    return (fs.LocalFileSystem(), os.path.abspath(local.group(1))) if local else fs.FileSystem.from_uri(path)


def _open(path: str) -> pa.NativeFile:
    store, inner = store_of(path)
    return store.open_input_file(inner)


def write_piece(path: str, chunks: Iterator[bytes]) -> int:
    """Bytes written to a new file."""
    store, inner = store_of(path)
    size = 0
    with store.open_output_stream(inner) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    return size


def join_pieces(spark: SparkSession, head: bytes, pieces: list[str], folder: str, name: str) -> None:
    """folder with one file: the head, then the pieces in order. One task streams them, as a file is one stream by format;
    what was in the folder goes when the new file is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():

                def chunks(r=r):
                    yield r["head"]
                    for piece in r["pieces"]:
                        with _open(piece) as f:
                            while block := f.read(FETCH_BYTES):
                                yield block

                yield pa.RecordBatch.from_arrays([pa.array([write_piece(r["to"], chunks())])], ["size"])

    unfinished = f"{folder.rstrip('/')}-{uuid.uuid4().hex}.tmp"
    spark.createDataFrame([(bytearray(head), pieces, unfinished)], "head binary, pieces array<string>, to string").coalesce(1).mapInArrow(run, "size long").collect()
    store, inner = store_of(folder)
    store.create_dir(inner, recursive=True)
    store.delete_dir_contents(inner)
    store.move(store_of(unfinished)[1], f"{inner}/{name}")


class Source:
    """Bytes of a file by position, fetched in blocks of at least `fetch` bytes; or of a bytes object."""

    def __init__(self, path: str | bytes, fetch: int = FETCH_BYTES):
        self.path, self.fetch = path, fetch
        self._file = None if isinstance(path, bytes) else _open(path)
        self.size = len(path) if self._file is None else self._file.size()
        self._at, self._block = 0, path if self._file is None else b""

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes from position at; fewer at the end of the file."""
        if self._file is not None and not (self._at <= at and at + n <= self._at + len(self._block)):
            self._at = at
            self._block = self._file.read_at(max(0, min(max(n, self.fetch), self.size - at)), at)
        return self._block[at - self._at : at - self._at + n]

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


def file_ranges(spark: SparkSession, path: str | list[str], size: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """((file, part, start, stop) of all files' ranges of `size` bytes, their number). Files are listed by Spark and not read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    parts = F.greatest(F.lit(1), F.ceil(F.col("length") / size)).cast("long")
    count = files.agg(F.sum(parts)).first()[0] or 1
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    ranges = ranges.select("file", "part", (F.col("part") * size).alias("start"), F.least("length", (F.col("part") + 1) * size).alias("stop"))
    return ranges.repartition(min(count, MOST_TASKS)), count
