"""BLF log files: frames and markers in, frames and markers out.

A file is one stream of containers that each hold compressed objects, and objects may go on in the next container.
`read_blf` reads byte ranges of files in as many tasks: a probe finds in each range the first container and the first
object (by signatures that chain), walks the objects that start there and reports where the next ones must start; the
reports of a file are compared in order, a range whose guess was wrong is walked again from the place known by then, and
counts number the objects. So ranges give the rows that one walk of the file gives, whatever the payloads hold.
`spark.read.format("blf")` and `df.write.format("blf")` (after `register`) work on paths that all machines mount.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from .ranges import FETCH_BYTES, MOST_TASKS, RANGE_BYTES, Source, file_ranges, join_pieces, store_of, write_piece

# Fixed values of the format: struct layouts, object types and flags
FILE_HEADER = struct.Struct("<4sLBBBBBBBBQQLL8H8H")
FILE_HEADER_SIZE = 144
OBJECT = struct.Struct("<4sHHLL")
OBJECT_V1 = struct.Struct("<LHHQ")
CONTAINER = struct.Struct("<H6xL4x")
CAN = struct.Struct("<HBBL8s")
CAN2_TAIL = struct.Struct("<LBBH")
CAN_FD = struct.Struct("<HBBLLBBB5x64s")
CAN_FD64 = struct.Struct("<BBBBLLLLLLLHBBL")
CAN_ERROR = struct.Struct("<HHLBBBxLLH2x8s")
MARKER = struct.Struct("<LLL3xBLLL12x")
T_CAN, T_CONTAINER, T_ERROR, T_CAN2, T_MARKER, T_FD, T_FD64 = 1, 10, 73, 86, 96, 100, 101
T_STATISTIC, T_TEXT, T_COMMENT, T_LOST_BEGIN, T_LOST_END = 4, 65, 92, 125, 126
STATISTIC, TEXT, COMMENT, LOST_BEGIN, LOST_END = (struct.Struct(x) for x in ("<HH6L", "<LLL4x", "<LL8x", "<L", "<LQL"))
NO_COMPRESSION, ZLIB = 0, 2
TEN_MICROS, NANOS = 1, 2
EXTENDED = 1 << 31
CONTAINER_BYTES = 128 * 1024
FD_LENGTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64)

FRAMES = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("object_no", T.LongType())]
    + [T.StructField(n, t) for n, t in (("timestamp_ns", T.LongType()), ("channel", T.IntegerType()), ("id", T.LongType()), ("extended", T.BooleanType()), ("direction", T.StringType()), ("kind", T.StringType()), ("data", T.BinaryType()), ("brs", T.BooleanType()), ("esi", T.BooleanType()), ("dlc", T.IntegerType()))]
)
MARKERS = T.StructType([T.StructField(n, t) for n, t in (("file", T.StringType()), ("object_no", T.LongType()), ("timestamp_ns", T.LongType()), ("group", T.StringType()), ("label", T.StringType()), ("description", T.StringType()), ("color", T.LongType()))])
EXTRAS = T.StructType([T.StructField(n, t) for n, t in (("file", T.StringType()), ("object_no", T.LongType()), ("timestamp_ns", T.LongType()), ("kind", T.StringType()), ("numbers", T.MapType(T.StringType(), T.LongType())), ("text", T.StringType()))])
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


class BlfError(ValueError):
    """A damaged or foreign file."""


def _start_ns(fields: tuple[int, ...]) -> int:
    """SYSTEMTIME (year, month, weekday, day, hour, minute, second, ms) to nanoseconds; all zero means unset."""
    if not any(fields):
        return 0
    year, month, _, day, hour, minute, second, ms = fields
    since = datetime(year, month, day, hour, minute, second, tzinfo=UTC) - EPOCH
    return (since // timedelta(milliseconds=1) + ms) * 1_000_000


def _system_time(ns: int) -> tuple[int, ...]:
    if ns <= 0:
        return (0,) * 8
    t = EPOCH + timedelta(milliseconds=ns // 1_000_000)
    return (t.year, t.month, t.isoweekday() % 7, t.day, t.hour, t.minute, t.second, t.microsecond // 1000)


def dlc_of(length: int) -> int:
    return next(i for i, n in enumerate(FD_LENGTHS) if n >= length)


@dataclass
class Report:
    """What a walk found: the range's first container and the stream bytes before its first object, its objects, the
    bytes of its containers, the first container past it and the stream bytes from there to the next object (-1: none)."""

    at: int
    skip: int
    objects: int = 0
    bytes: int = 0
    after: int = 0
    tail: int = 0


def _head(source: Source, at: int) -> tuple[int, int, int] | None:
    """(header size, size, type) of the object at a position, None if there is none."""
    raw = source.read(at, OBJECT.size)
    if len(raw) < OBJECT.size:
        return None
    sign, header, _, size, kind = OBJECT.unpack(raw)
    return (header, size, kind) if sign == b"LOBJ" and size >= header >= OBJECT.size else None


def _pieces(source: Source, at: int) -> Iterator[tuple[int, int, bytes]]:
    """(position, position of the next, stream bytes) of containers, and of objects outside of any, from `at` on."""
    while at + OBJECT.size <= source.size:
        head = _head(source, at)
        if head is None:
            raise BlfError(f"no object at byte {at}")
        _, size, kind = head
        after = at + size + size % 4
        if kind != T_CONTAINER:
            yield at, after, source.read(at, size)
        else:
            method, whole = CONTAINER.unpack(source.read(at + OBJECT.size, CONTAINER.size))
            data = source.read(at + OBJECT.size + CONTAINER.size, size - OBJECT.size - CONTAINER.size)
            if method == ZLIB:
                data = zlib.decompress(data, 15, whole)
            elif method != NO_COMPRESSION:
                raise BlfError(f"unknown compression {method}")
            yield at, after, data
        at = after


def _first_container(source: Source, start: int, stop: int) -> int | None:
    """The first position in [start, stop) from which objects chain through the range."""
    at = start
    while at < stop:
        block = source.read(at, min(FETCH_BYTES, stop - at + 3))
        found = block.find(b"LOBJ")
        if found < 0:
            at += max(1, len(block) - 3)
            continue
        at += found
        if at >= stop:
            return None
        place = at
        while place < stop and (head := _head(source, place)) is not None:
            place += head[1] + head[1] % 4
        if place >= stop or place + OBJECT.size > source.size:
            return at
        at += 4
    return None


def _first_object(data: bytes) -> int | None:
    """Where the first object starts: a signature whose object ends at the next one, or past the data."""
    at = data.find(b"LOBJ")
    while at >= 0:
        if at + OBJECT.size > len(data):
            return None
        _, header, _, size, _ = OBJECT.unpack_from(data, at)
        end = at + size
        if size >= header >= OBJECT.size and (end + 7 > len(data) or 0 <= data.find(b"LOBJ", end, end + 7) - end <= 3):
            return at
        at = data.find(b"LOBJ", at + 1)
    return None


def walk(source: Source, report: Report, stop: int, known: bool = True) -> Iterator[tuple[int, int, bytes]]:
    """(type, offset from start in ns, body) of the objects that start in the containers from report.at to before `stop`.

    The last one is read on from the containers behind. `report` is filled in; unless the first object's place is known,
    it is guessed (report.skip stays negative where there is no guess).
    """
    buffer, skip, left, done = b"", report.skip if known else None, None, 0
    report.after = report.at
    for at, after, data in _pieces(source, report.at):
        if left is None and at >= stop:  # what the buffer holds up to here is the range's own
            if skip is None:
                return
            if skip > 0:  # one object goes through the whole range
                report.tail = skip
                return
            left = len(buffer)
        if left is None:
            report.after, report.bytes = after, report.bytes + len(data)
            if skip is None:
                buffer += data
                skip = _first_object(buffer)
                if skip is None:
                    continue
                report.skip, data, buffer = skip, buffer, b""
            cut = min(skip, len(data))
            skip -= cut
            found, buffer = _walk(buffer + data[cut:])
            report.objects += len(found)
            yield from found
            continue
        buffer += data
        start = buffer.find(b"LOBJ", done)
        while 0 <= start < left:  # begun in the range
            size = OBJECT.unpack_from(buffer, start)[3] if start + OBJECT.size <= len(buffer) else len(buffer)
            if start + size > len(buffer) or start + OBJECT.size > len(buffer):
                break
            done = start + size
            found, _ = _walk(buffer[start:done])
            report.objects += len(found)
            yield from found
            start = buffer.find(b"LOBJ", done)
        if start >= left:
            report.tail = start - left
            return
    report.tail = -1  # the file ends


def objects(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(type, offset from start in ns, body) of all objects, which may straddle containers."""
    yield from walk(Source(content), Report(struct.unpack_from("<L", content, 4)[0], 0), len(content))


def _walk(data: bytes) -> tuple[list[tuple[int, int, bytes]], bytes]:
    """Complete objects of a run of bytes, and what is left of the last."""
    out, at = [], 0
    while True:
        at = data.find(b"LOBJ", at)
        if at < 0:
            return out, data[-3:]
        if at + OBJECT.size > len(data):
            return out, data[at:]
        _, header, _, size, kind = OBJECT.unpack_from(data, at)
        if size < header or header < OBJECT.size:
            raise BlfError("bad object size")
        if at + size > len(data):
            return out, data[at:]
        if header >= OBJECT.size + 16:
            flags, _, _, ticks = OBJECT_V1.unpack_from(data, at + OBJECT.size)
            out.append((kind, ticks * (10_000 if flags == TEN_MICROS else 1), data[at + header : at + size]))
        at += size


def frame_of(kind: int, body: bytes) -> tuple | None:
    """(channel, id, extended, direction, kind, data, brs, esi, dlc) with channels from 0, or None for other objects."""
    if kind in (T_CAN, T_CAN2):
        channel, flags, dlc, can_id, data = CAN.unpack_from(body)
        remote = bool(flags & 0x80)
        return channel - 1, can_id & ~EXTENDED, bool(can_id & EXTENDED), "Tx" if flags & 1 else "Rx", "remote" if remote else "classic", b"" if remote else data[: min(dlc & 15, 8)], None, None, min(dlc & 15, 8)
    if kind == T_FD:
        channel, flags, dlc, can_id, _, _, fd, valid, data = CAN_FD.unpack_from(body)
        classic = not fd & 1
        return channel - 1, can_id & ~EXTENDED, bool(can_id & EXTENDED), "Tx" if flags & 1 else "Rx", "classic" if classic else "fd", data[:valid], None if classic else bool(fd & 2), None if classic else bool(fd & 4), dlc
    if kind == T_FD64:
        channel, dlc, valid, _, can_id, _, flags, _, _, _, _, _, direction, _, _ = CAN_FD64.unpack_from(body)
        data = body[CAN_FD64.size : CAN_FD64.size + valid]
        side = "Rx" if direction == 0 else "Tx"
        if flags & 0x10:
            return channel - 1, can_id & ~EXTENDED, bool(can_id & EXTENDED), side, "remote", b"", None, None, dlc
        fd = bool(flags & 0x1000)
        return channel - 1, can_id & ~EXTENDED, bool(can_id & EXTENDED), side, "fd" if fd else "classic", data, bool(flags & 0x2000) if fd else None, bool(flags & 0x4000) if fd else None, dlc
    if kind == T_ERROR:
        channel, _, _, _, _, _, _, can_id, extra, _ = CAN_ERROR.unpack_from(body)
        return channel - 1, can_id & ~EXTENDED, bool(can_id & EXTENDED), "Rx" if extra & 0x20 else "Tx", "error", b"", None, None, None
    return None


def marker_of(body: bytes) -> tuple[str, str, str, int]:
    """(group, label, description, colour)."""
    _, color, _, _, group, name, text = MARKER.unpack_from(body)
    at = MARKER.size
    read = lambda a, n: body[a : a + n].rstrip(b"\0").decode("utf-8", "replace")
    return read(at, group), read(at + group, name), read(at + group + name, text), color


def extra_of(kind: int, body: bytes) -> tuple[str, dict[str, int], str | None] | None:
    """(kind, numbers, text) of bus statistics, texts, comments and gap brackets, or None for other objects."""
    if kind == T_STATISTIC:
        names = ("channel", "bus_load", "standard_data", "extended_data", "standard_remote", "extended_remote", "errors", "overloads")
        numbers = dict(zip(names, STATISTIC.unpack_from(body), strict=True))
        return "statistic", numbers | {"channel": numbers["channel"] - 1}, None
    if kind in (T_TEXT, T_COMMENT):
        layout, name = (TEXT, "source") if kind == T_TEXT else (COMMENT, "object_type")
        first, *_, size = layout.unpack_from(body)
        if layout.size + size > len(body):
            raise BlfError("a text leaves its object")
        return "text" if kind == T_TEXT else "comment", {name: first}, body[layout.size : layout.size + size].rstrip(b"\0").decode("utf-8", "replace")
    if kind == T_LOST_BEGIN:
        return "lost_begin", {"queue": LOST_BEGIN.unpack_from(body)[0]}, None
    if kind == T_LOST_END:
        return "lost_end", dict(zip(("queue", "first_lost_ns", "events"), LOST_END.unpack_from(body), strict=True)), None
    return None


def parse_extras(content: bytes, file: str) -> Iterator[tuple]:
    """Rows of EXTRAS: what a frame import skips."""
    start = _start_ns(FILE_HEADER.unpack_from(content)[14:22])
    for n, (kind, offset, body) in enumerate(objects(content)):
        if found := extra_of(kind, body):
            yield (file, n, start + offset, *found)


def parse(content: bytes, file: str, markers: bool = False) -> Iterator[tuple]:
    if len(content) < FILE_HEADER_SIZE or content[:4] != b"LOGG":
        raise BlfError(f"{file} has no BLF signature")
    start = _start_ns(FILE_HEADER.unpack_from(content)[14:22])
    for n, (kind, offset, body) in enumerate(objects(content)):
        if markers:
            if kind == T_MARKER:
                yield (file, n, start + offset, *marker_of(body))
        elif frame := frame_of(kind, body):
            yield (file, n, start + offset, *frame)


def _rows(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)
    as_arrow = lambda c: [list(x.items()) if isinstance(x, dict) else x for x in c]
    return pa.RecordBatch.from_arrays([pa.array(as_arrow(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


_REPORTS = "file string, part long, start long, stop long, at long, skip long, objects long, after long, tail long"
_RANGES = "file string, part long, stop long, at long, skip long, first_no long, start_ns long"


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reports of ranges (file, part, start, stop) that are guessed; at is -1 where nothing chains."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            source, report = Source(r["file"]), Report(-1, -1)
            try:
                at = _first_container(source, r["start"], r["stop"]) if r["part"] else None
                if at is not None:
                    report.at = at
                    for _ in walk(source, report, r["stop"], known=False):
                        pass
            except (BlfError, zlib.error, struct.error):
                report = Report(-1, -1)
            source.close()
            out.append((*r.values(), report.at, report.skip, report.objects, report.after, report.tail))
        names = [x.split()[0] for x in _REPORTS.split(", ")]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "file" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names)


def _stitched(reports: pd.DataFrame) -> pd.DataFrame:
    """One file's ranges from what is known of the ranges before; a range whose guess differs is walked again."""
    reports = reports.sort_values("part")
    file = reports["file"].iloc[0]
    source = Source(file)
    head = source.read(0, FILE_HEADER_SIZE)
    if len(head) < FILE_HEADER_SIZE or head[:4] != b"LOGG":
        raise BlfError(f"{file} has no BLF signature")
    start_ns = _start_ns(FILE_HEADER.unpack_from(head)[14:22])
    at, skip, number, out = struct.unpack_from("<L", head, 4)[0], 0, 0, []
    for r in reports.itertuples():
        if skip < 0 or at >= r.stop:
            continue
        report = Report(at, skip, r.objects, 0, r.after, r.tail)
        if (r.at, r.skip) != (at, skip):
            report = Report(at, skip)
            for _ in walk(source, report, r.stop):
                pass
        out.append((file, r.part, r.stop, at, skip, number, start_ns))
        at, skip, number = report.after, report.tail, number + report.objects
    source.close()
    return pd.DataFrame(out, columns=[x.split()[0] for x in _RANGES.split(", ")])


def blf_ranges(spark: SparkSession, path: str | list[str], size: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """(the exact ranges of files, their number): where each range's first object starts and which number it has."""
    ranges, n = file_ranges(spark, path, size)
    reports = ranges.mapInArrow(_probed, _REPORTS)
    return reports.groupBy("file").applyInPandas(_stitched, _RANGES), n  # a few numbers a range


def _rows_of(source: Source, r: dict, markers: bool, extras: bool) -> Iterator[tuple]:
    for n, (kind, offset, body) in enumerate(walk(source, Report(r["at"], r["skip"]), r["stop"]), r["first_no"]):
        at = r["start_ns"] + offset
        if extras:
            if found := extra_of(kind, body):
                yield (r["file"], n, at, *found)
        elif markers:
            if kind == T_MARKER:
                yield (r["file"], n, at, *marker_of(body))
        elif frame := frame_of(kind, body):
            yield (r["file"], n, at, *frame)


def read_blf(spark: SparkSession, path: str | list[str], markers: bool = False, extras: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames (or markers, or the other objects) of files, read by as many tasks as they have ranges. (file, object_no) is
    the order of the file. Tasks open files where pyarrow's file systems reach them: local and mounted paths, HDFS, S3, GCS."""
    schema = EXTRAS if extras else MARKERS if markers else FRAMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                source, rows = Source(r["file"]), []
                for row in _rows_of(source, r, markers, extras):
                    rows.append(row)
                    if len(rows) == 20_000:
                        yield _rows(schema, rows)
                        rows = []
                source.close()
                if rows:
                    yield _rows(schema, rows)

    ranges, n = blf_ranges(spark, path, range_bytes)
    return ranges.repartition(min(n, MOST_TASKS)).mapInArrow(run, schema)


def blf_census(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per file: channels, frames, first and last time, markers."""
    f = read_blf(spark, path).select("file", "channel", "timestamp_ns")
    m = read_blf(spark, path, markers=True).groupBy("file").agg(F.count("*").alias("markers"))
    g = f.groupBy("file").agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.count("*").alias("frames"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))
    return g.join(m, "file", "full").fillna(0, ["markers", "frames"])


@dataclass
class _Out:
    """Collects objects into containers of a file."""

    start_ns: int
    parts: list[bytes]
    buffer: bytearray
    count: int = 0
    whole: int = FILE_HEADER_SIZE
    clamped: int = 0
    worst_ns: int = 0

    def add(self, kind: int, timestamp_ns: int, body: bytes) -> None:
        offset = timestamp_ns - self.start_ns
        if offset < 0:
            self.clamped, self.worst_ns, offset = self.clamped + 1, max(self.worst_ns, -offset), 0
        size = OBJECT.size + OBJECT_V1.size + len(body)
        self.buffer += OBJECT.pack(b"LOBJ", OBJECT.size + OBJECT_V1.size, 1, size, kind) + OBJECT_V1.pack(NANOS, 0, 0, offset) + body + bytes(size % 4)
        self.count += 1
        while len(self.buffer) >= CONTAINER_BYTES:
            self._flush(CONTAINER_BYTES)

    def _flush(self, size: int) -> None:
        data = bytes(self.buffer[:size])
        del self.buffer[:size]
        packed = zlib.compress(data)
        total = OBJECT.size + CONTAINER.size + len(packed)
        self.parts.append(OBJECT.pack(b"LOBJ", OBJECT.size, 1, total, T_CONTAINER) + CONTAINER.pack(ZLIB, len(data)) + packed + bytes(total % 4))
        self.whole += OBJECT.size + CONTAINER.size + len(data)

    def flush(self) -> None:
        if self.buffer:
            self._flush(len(self.buffer))

    def close(self, last_ns: int) -> bytes:
        self.flush()
        body = b"".join(self.parts)
        return header(self.start_ns, last_ns, len(body), self.whole, self.count) + body


def header(start_ns: int, last_ns: int, size: int, whole: int, objects: int) -> bytes:
    """The head of a file of `size` bytes of containers, which hold `whole` bytes (head included) and so many objects."""
    head = FILE_HEADER.pack(b"LOGG", FILE_HEADER_SIZE, 5, 0, 0, 0, 2, 6, 8, 1, FILE_HEADER_SIZE + size, whole, objects, 0, *_system_time(start_ns), *_system_time(last_ns))
    return head.ljust(FILE_HEADER_SIZE, b"\0")


def object_of(r: dict) -> tuple[int, bytes]:
    """(type, body) of a frame."""
    can_id = r["id"] | (EXTENDED if r["extended"] else 0)
    data, tx = bytes(r["data"] or b""), r["direction"] == "Tx"
    channel = (r["channel"] or 0) + 1
    if r["kind"] == "error":
        return T_ERROR, CAN_ERROR.pack(channel, 0, 0, 0, 0, 0, 0, can_id, 0 if tx else 0x20, b"")
    if r["kind"] == "fd":
        flags = 0x1000 | (0x2000 if r["brs"] else 0) | (0x4000 if r["esi"] else 0)
        return T_FD64, CAN_FD64.pack(channel, dlc_of(len(data)), len(data), 0, can_id, 0, flags, 0, 0, 0, 0, 0, int(tx), 0, 0) + data
    remote = r["kind"] == "remote"
    return T_CAN2, CAN.pack(channel, int(tx) | (0x80 if remote else 0), (r["dlc"] or 0) if remote else len(data), can_id, data) + CAN2_TAIL.pack(0, 0, 0, 0)


def marker_body(group: str, label: str, description: str, color: int) -> bytes:
    g, n, d = (x.encode() for x in (group, label, description))
    return MARKER.pack(0, color, 0, 0, len(g), len(n), len(d)) + g + n + d


def build(frames: Iterator[dict], markers: list[dict] = (), start_ns: int | None = None) -> tuple[bytes, int, int]:
    """(file, events clamped to the start, worst clamp in ns). Frames stay in the order given; markers, by time, are merged in,
    frames first at equal times. The start is floored to a millisecond."""
    frames, notes = list(frames), sorted(markers, key=lambda m: m["timestamp_ns"])
    times = [r["timestamp_ns"] for r in frames] + [m["timestamp_ns"] for m in notes]
    first = min(times, default=0) if start_ns is None else start_ns
    out, k = _Out(first // 1_000_000 * 1_000_000, [], bytearray()), 0
    for r in frames:
        while k < len(notes) and notes[k]["timestamp_ns"] < r["timestamp_ns"]:
            m = notes[k]
            out.add(T_MARKER, m["timestamp_ns"], marker_body(m.get("group", ""), m.get("label", ""), m.get("description", ""), m.get("color", 0)))
            k += 1
        out.add(*(lambda o: (o[0], r["timestamp_ns"], o[1]))(object_of(r)))
    for m in notes[k:]:
        out.add(T_MARKER, m["timestamp_ns"], marker_body(m.get("group", ""), m.get("label", ""), m.get("description", ""), m.get("color", 0)))
    return out.close(max(times, default=0)), out.clamped, out.worst_ns


@dataclass
class _Range(InputPartition):
    range: dict


class _Reader(DataSourceReader):
    """Partitions are byte ranges. The format plans outside of any job, so it walks each file once to know them; read_blf
    finds them in parallel."""

    def __init__(self, options, markers: bool):
        self.path, self.markers, self.size = options["path"], markers, int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self):
        store, inner = store_of(self.path)
        found = store.get_file_info(inner)
        files = sorted(store.get_file_info(fs.FileSelector(inner)), key=lambda f: f.path) if found.type == fs.FileType.Directory else [found]
        out = []
        for info in files:
            if found.type == fs.FileType.Directory and not info.path.endswith(".blf"):
                continue
            file = self.path + info.path.removeprefix(inner)
            whole = info.size
            starts = range(0, max(1, whole), self.size)
            reports = pd.DataFrame([(file, k, a, min(whole, a + self.size), -1, -1, 0, 0, 0) for k, a in enumerate(starts)], columns=[x.split()[0] for x in _REPORTS.split(", ")])
            out += [_Range(r) for r in _stitched(reports).to_dict("records")]
        return out

    def read(self, partition):
        source = Source(partition.range["file"])
        yield from _rows_of(source, partition.range, self.markers, False)
        source.close()


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows):
        from pyspark import TaskContext

        content, _, _ = build(r.asDict() for r in rows)
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        temporary = f"{folder}/.{uuid.uuid4().hex}.tmp"
        write_piece(self.path.rstrip("/") + temporary.removeprefix(folder), iter([content]))
        return _Written(temporary, f"{folder}/part-{TaskContext.get().partitionId():05d}.blf")

    def commit(self, messages):
        store, folder = store_of(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.path.endswith(".blf"):
                    store.delete_file(f.path)
        for m in filter(None, messages):
            store.move(m.temporary, m.final)

    def abort(self, messages):
        store, _ = store_of(self.path)
        for m in filter(None, messages):
            store.delete_file(m.temporary)


class BlfDataSource(DataSource):
    """Format `blf`; option markers=true reads the markers instead of the frames."""

    @classmethod
    def name(cls):
        return "blf"

    def _markers(self) -> bool:
        return self.options.get("markers", "false").lower() == "true"

    def schema(self):
        return MARKERS if self._markers() else FRAMES

    def reader(self, schema):
        return _Reader(self.options, self._markers())

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlfDataSource)


def _packed(frames: DataFrame, start_ns: int, folder: str) -> DataFrame:
    """Each partition's frames as containers in a piece of its own under folder: (part, path, size, whole, objects)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = _Out(start_ns, [], bytearray(), whole=0)

        def containers() -> Iterator[bytes]:
            for batch in batches:
                for i in range(0, batch.num_rows, 4096):
                    for r in batch.slice(i, 4096).to_pylist():
                        kind, body = object_of(r)
                        out.add(kind, r["timestamp_ns"], body)
                    yield b"".join(out.parts)
                    out.parts = []
            out.flush()
            yield b"".join(out.parts)

        path = f"{folder}/{uuid.uuid4().hex}"
        size = write_piece(path, containers())
        row = (TaskContext.get().partitionId(), path, size, out.whole, out.count)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "path", "size", "whole", "objects"])

    return frames.mapInArrow(run, "part long, path string, size long, whole long, objects long")


def save_blf(frames: DataFrame, path: str) -> None:
    """One file of the whole capture in row order under path, in any store that pyarrow writes.

    Range partitions pack their frames into containers and write them aside as pieces, in parallel; then one task streams
    the head and the pieces into the file, which is moved in place. The driver sees a row a piece.
    """
    spark = frames.sparkSession
    first, last = frames.agg(F.min("timestamp_ns"), F.max("timestamp_ns")).first()
    start_ns = (first or 0) // 1_000_000 * 1_000_000
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    store, inner = store_of(aside)
    store.create_dir(inner, recursive=True)
    pieces = sorted(_packed(frames.orderBy("idx"), start_ns, aside).collect())
    size, whole, objects = (sum(p[c] for p in pieces) for c in ("size", "whole", "objects"))
    head = header(start_ns, last or 0, size, FILE_HEADER_SIZE + whole, objects)
    join_pieces(spark, head, [p["path"] for p in pieces], path, "part-00000.blf")
    store.delete_dir(inner)
