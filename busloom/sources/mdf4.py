"""MDF 4.x files: bus frames, recorded signals, events and attachments in; sorted finalized files out.

Reads sorted and unsorted, finalized and unfinalized files with plain, deflated and listed data blocks. One task a file
follows the links of its blocks by seeks, without reading data, and cuts the records into ranges; as many tasks read the
ranges, whose fields are taken from a (record, byte) matrix at once. Sorted groups are cut by arithmetic. Unsorted ones (of
records that only their ids tell apart) are walked first, every data block by a task of its own, to mark where ranges
start and to count the records before them; an unknown id, or a record that its block cuts off, ends that block.

Rows carry (group, record_no); emission_order() gives the order in which a merge of the groups by their next times emits.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.payloads import matrix
from ..model import running_max
from .ranges import FETCH_BYTES, MOST_TASKS, RANGE_BYTES, Source, file_ranges, join_pieces, store_of, write_piece

# Fixed values of the format: block layouts, channel and data types
HEAD = struct.Struct("<4s4xQQ")
HD = struct.Struct("<QhhBBBxdd")
CG = struct.Struct("<QQHH4xII")
CN = struct.Struct("<BBBBIIIIBxH6d")
CC = struct.Struct("<BBHHHdd")
EV = struct.Struct("<BBBBB3xIHHqd")
AT = struct.Struct("<HH4x16sQQ")
DZ = struct.Struct("<2sBxIQQ")
MASTER, FIXED = 2, 0
UINT_LE, UINT_BE, INT_LE, INT_BE, FLOAT_LE, FLOAT_BE, BYTES = 0, 1, 2, 3, 4, 5, 10
#: bytes fetched at once while links are followed, and records that are taken apart at once
META_BYTES, ROWS = 1 << 16, 1 << 16
#: seconds beyond which a time does not fit 63 bits of nanoseconds
MOST_SECONDS = 7e9
FRAME_GROUPS = {"CAN_DataFrame": "data", "CAN_ErrorFrame": "error", "CAN_RemoteFrame": "remote"}

_fields = lambda *x: T.StructType([T.StructField(n, t) for n, t in x])
_L, _S, _I, _B, _D = T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()
FRAMES = _fields(("file", _S), ("group", _I), ("record_no", _L), ("timestamp_ns", _L), ("channel", _I), ("id", _L), ("extended", _B), ("direction", _S), ("kind", _S), ("data", T.BinaryType()), ("brs", _B), ("esi", _B), ("dlc", _I))
SIGNALS = _fields(("file", _S), ("group", _I), ("group_name", _S), ("name", _S), ("unit", _S), ("record_no", _L), ("timestamp_ns", _L), ("value", _D))
EVENTS = _fields(("file", _S), ("timestamp_ns", _L), ("label", _S), ("comment", _S))
ATTACHMENTS = _fields(("file", _S), ("name", _S), ("mime", _S), ("content", T.BinaryType()))
TABLES = _fields(("file", _S), ("group", _I), ("name", _S), ("raw", _L), ("label", _S))
GROUPS = _fields(("file", _S), ("group", _I), ("group_name", _S), ("kind", _S), ("channels", _I), ("records", _L), ("decoded_source", _B))


class MdfError(ValueError):
    """A damaged or foreign file."""


@dataclass
class Channel:
    name: str
    kind: int
    data_type: int
    bit_offset: int
    byte_offset: int
    bit_count: int
    unit: str
    conversion: tuple[int, list[float], list[str]] | None
    invalid_bit: int | None
    composed: list[Channel] = field(default_factory=list)


@dataclass
class Block:
    """A data block: its kind, where its bytes stand, how many are stored and how many they are."""

    kind: bytes
    at: int
    stored: int
    size: int
    method: int = 0
    parameter: int = 0
    first: int = 0  # of the data group's bytes


@dataclass
class Group:
    index: int
    name: str
    record_id: int
    data_group: int
    data_bytes: int
    invalid_bytes: int
    cycles: int
    channels: list[Channel]
    source: int = 0

    @property
    def step(self) -> int:
        return self.data_bytes + self.invalid_bytes

    @property
    def master(self) -> Channel | None:
        return next((c for c in self.channels if c.kind == MASTER), None)

    @property
    def frames(self) -> tuple[Channel, str] | None:
        """The composed bus structure and what it records."""
        for c in self.channels:
            if c.composed and c.name in FRAME_GROUPS:
                return c, FRAME_GROUPS[c.name]
        return None


@dataclass
class DataGroup:
    record_id_size: int
    #: by record id: (group, whether it holds values of variable length)
    groups: dict[int, tuple[Group, bool]]
    blocks: list[Block]

    @property
    def sorted(self) -> bool:
        return not self.record_id_size and len(self.groups) == 1


class File:
    """The block graph of a file; data is read by ranges only."""

    def __init__(self, content: bytes | str):
        self.source = Source(content, META_BYTES)
        head = self.source.read(0, 64)
        if head[:8] not in (b"MDF     ", b"UnFinMF "):
            raise MdfError("no MDF signature")
        self.finalized = head[:8] == b"MDF     "
        if struct.unpack_from("<H", head, 28)[0] < 400:
            raise MdfError("not version 4")
        self.top = 0
        links, data = self._block(64, b"##HD")
        self.start_ns = HD.unpack_from(data)[0]
        self.links = links
        self.groups: list[Group] = []
        self.data_groups: list[DataGroup] = []
        at = links[0]
        while at:
            own, data = self._block(at, b"##DG")
            self._data_group(own, data[0])
            at = own[0]
        for own in self.data_groups:  # an unfinalized writer may not have set the size of the file's last block
            if not self.finalized and own.blocks and own.blocks[-1].size == 0 and own.blocks[-1].at == self.top + HEAD.size:
                own.blocks[-1].size = own.blocks[-1].stored = self.source.size - own.blocks[-1].at
        self.data = Source(content)

    def close(self) -> None:
        self.source.close()
        self.data.close()

    def _links(self, at: int) -> tuple[bytes, tuple[int, ...], int, int]:
        """(kind, links, where the data starts, where it ends)."""
        kind, size, n = HEAD.unpack(self.source.read(at, HEAD.size))
        first = at + HEAD.size + 8 * n
        last = self.source.size if size < HEAD.size + 8 * n else min(at + size, self.source.size)
        links = struct.unpack(f"<{n}Q", self.source.read(at + HEAD.size, 8 * n))
        self.top = max(self.top, at, *links)
        return kind, links, first, last

    def _block(self, at: int, sign: bytes | None = None) -> tuple[tuple[int, ...], bytes]:
        kind, links, first, last = self._links(at)
        if sign and kind != sign:
            raise MdfError(f"expected {sign!r} at byte {at}")
        return links, self.source.read(first, last - first)

    def text(self, at: int) -> str:
        return self._block(at)[1].split(b"\0")[0].decode("utf-8", "replace") if at else ""

    def _channels(self, at: int) -> list[Channel]:
        out = []
        while at:
            links, data = self._block(at, b"##CN")
            kind, _, data_type, bit_offset, byte_offset, bits, flags, invalid, *_ = CN.unpack_from(data)
            conversion = None
            if links[4]:
                refs, c = self._block(links[4], b"##CC")
                ctype, _, _, n_refs, n_vals, _, _ = CC.unpack_from(c)
                vals = list(struct.unpack_from(f"<{n_vals}d", c, CC.size))
                texts = [self.text(r) if r and self.source.read(r, 4) in (b"##TX", b"##MD") else "" for r in refs[4 : 4 + n_refs]]
                conversion = ctype, vals, texts
            own = Channel(self.text(links[2]), kind, data_type, bit_offset, byte_offset, bits, self.text(links[6]), conversion, invalid if flags & 2 else None)
            if links[1] and self.source.read(links[1], 4) == b"##CN":
                own.composed = self._channels(links[1])
            out.append(own)
            at = links[0]
        return out

    def _data_group(self, links: tuple[int, ...], record_id_size: int) -> None:
        own, at, number = {}, links[1], len(self.data_groups)
        while at:
            g, data = self._block(at, b"##CG")
            record_id, cycles, flags, _, size, invalid = CG.unpack_from(data)
            source = self._block(g[3])[1][0] if g[3] else 0
            group = Group(len(self.groups), self.text(g[2]), record_id, number, size, invalid, cycles, self._channels(g[1]), source)
            if not flags & 1:
                self.groups.append(group)
            own[record_id] = group, bool(flags & 1)
            at = g[0]
        blocks, first = [], 0
        for block in self._blocks(links[2]):
            block.first = first
            first += block.size
            blocks.append(block)
        self.data_groups.append(DataGroup(record_id_size, own, blocks))

    def _blocks(self, at: int) -> Iterator[Block]:
        seen = set()
        while at:
            if at in seen:
                raise MdfError(f"data blocks link in a circle at byte {at}")
            seen.add(at)
            kind, links, first, last = self._links(at)
            if kind in (b"##DT", b"##DV", b"##SD", b"##RD"):
                yield Block(b"DT", first, last - first, last - first)
                return
            if kind == b"##DZ":
                _, method, parameter, original, size = DZ.unpack(self.source.read(first, DZ.size))
                yield Block(b"DZ", first + DZ.size, size, original, method, parameter)
                return
            if kind == b"##HL":
                at = links[0]
                continue
            if kind != b"##DL":
                raise MdfError(f"unexpected data block {kind!r}")
            for part in links[1:]:
                if part:
                    yield from self._blocks(part)
            at = links[0]

    def bytes_of(self, block: Block, first: int, last: int) -> bytes:
        """Bytes [first, last) of what a data block holds."""
        if block.kind == b"DT":
            return self.data.read(block.at + first, last - first)
        plain = zlib.decompress(self.data.read(block.at, block.stored))
        if block.method == 1 and block.parameter:
            rows = block.size // block.parameter
            cut = rows * block.parameter
            plain = np.frombuffer(plain[:cut], np.uint8).reshape(block.parameter, rows).T.tobytes() + plain[cut:]
        return plain[first:last]

    def records_of(self, group: Group, first: int, last: int) -> np.ndarray:
        """Records [first, last) of a sorted group as (record, byte); they may go on from one data block to the next."""
        a, b = first * group.step, last * group.step
        parts = [self.bytes_of(k, max(0, a - k.first), min(k.size, b - k.first)) for k in self.data_groups[group.data_group].blocks if k.first < b and k.first + k.size > a]
        return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, group.step)

    def count(self, group: Group) -> int:
        """Records of a sorted group."""
        blocks = self.data_groups[group.data_group].blocks
        n = (blocks[-1].first + blocks[-1].size) // group.step if blocks and group.step else 0
        return min(n, group.cycles) if self.finalized else n

    def walk(self, data_group: int, block: int, first: int = 0, last: int | None = None) -> Iterator[tuple[int, Group | None, bytes, int, int]]:
        """(position, group or None, bytes, where in them the record is) of a block's records that start in [first, last)."""
        own, k = self.data_groups[data_group], self.data_groups[data_group].blocks[block]
        last, width = k.size if last is None else last, own.record_id_size
        data, base, at = b"", first, first
        if k.kind == b"DZ":
            data, base = self.bytes_of(k, 0, k.size), 0

        def need(n: int) -> bool:
            nonlocal data, base
            if at + n > base + len(data) and k.kind == b"DT":
                data, base = self.bytes_of(k, at, min(k.size, at + max(n, FETCH_BYTES))), at
            return at + n <= base + len(data)

        while at < last:
            if not need(width):
                return
            found = own.groups.get(int.from_bytes(data[at - base : at - base + width], "little"))
            if found is None:
                return
            group, variable = found
            size = group.step
            if variable:
                if not need(width + 4):
                    return
                size = 4 + int.from_bytes(data[at - base + width : at - base + width + 4], "little")
            if not need(width + size):
                return
            yield at, None if variable else group, data, at - base + width, at - base + width + size
            at += width + size

    def marks(self, data_group: int, block: int, size: int) -> Iterator[tuple[int, int, dict[int, int]]]:
        """(first, last, records by group) of ranges of about `size` bytes of an unsorted block."""
        start, counts, end = 0, {}, self.data_groups[data_group].blocks[block].size
        for at, group, *_ in self.walk(data_group, block):
            if at - start >= size:
                yield start, at, counts
                start, counts = at, {}
            if group is not None:
                counts[group.index] = counts.get(group.index, 0) + 1
        yield start, end, counts

    def plan(self, size: int) -> Iterator[dict]:
        """Ranges of records of about `size` bytes: (data_group, group, block, first, last), of unsorted groups whole blocks
        with group -1."""
        for number, own in enumerate(self.data_groups):
            if own.sorted:
                group, variable = next(iter(own.groups.values()))
                if variable or not group.step:
                    continue
                n, many = self.count(group), max(1, size // group.step)
                for first in range(0, n, many):
                    yield {"data_group": number, "group": group.index, "block": -1, "first": first, "last": min(n, first + many)}
            else:
                for k in range(len(own.blocks)):
                    yield {"data_group": number, "group": -1, "block": k, "first": 0, "last": own.blocks[k].size}

    def pieces(self, r: dict) -> Iterator[tuple[Group, int, np.ndarray]]:
        """(group, number of the first record, records) of a range; of an unsorted one `base` has the records before."""
        if r["group"] >= 0:
            group = self.groups[r["group"]]
            for first in range(r["first"], r["last"], ROWS):
                yield group, first, self.records_of(group, first, min(r["last"], first + ROWS))
            return
        held: dict[int, list[bytes]] = {}
        base = dict(r["base"])

        def out(g: int) -> tuple[Group, int, np.ndarray]:
            records = np.frombuffer(b"".join(held[g]), np.uint8).reshape(len(held[g]), -1)
            first, base[g] = base.get(g, 0), base.get(g, 0) + len(held[g])
            held[g] = []
            return self.groups[g], first, records

        for _, group, data, first, last in self.walk(r["data_group"], r["block"], r["first"], r["last"]):
            if group is not None:
                held.setdefault(group.index, []).append(data[first:last])
                if len(held[group.index]) == ROWS:
                    yield out(group.index)
        for g in held:
            if held[g]:
                yield out(g)

    def all_pieces(self, size: int = RANGE_BYTES) -> Iterator[tuple[Group, int, np.ndarray]]:
        """The pieces of the whole file."""
        before: dict[tuple[int, int], int] = {}
        for r in self.plan(size):
            if r["group"] >= 0:
                yield from self.pieces(r)
                continue
            for first, last, counts in self.marks(r["data_group"], r["block"], size):
                yield from self.pieces(r | {"first": first, "last": last, "base": {g: before.get((r["data_group"], g), 0) for g in counts}})
                for g, n in counts.items():
                    before[r["data_group"], g] = before.get((r["data_group"], g), 0) + n

    def time_ns(self, group: Group, records: np.ndarray) -> pa.Array:
        seconds, valid = number(group, records, group.master)
        valid = valid & (np.abs(seconds) < MOST_SECONDS)  # not so for not-a-number
        ns = self.start_ns + np.maximum(0, np.rint(np.where(valid, seconds, 0) * 1e9)).astype(np.int64)
        return pa.array(ns, mask=~valid)

    def frame_columns(self, group: Group, first: int, records: np.ndarray) -> list[pa.Array]:
        structure, kind = group.frames
        part = {c.name.rpartition(".")[2]: c for c in structure.composed}
        if "ID" not in part:
            raise MdfError(f"group {group.index} has no frame id")
        n = len(records)

        def get(name: str) -> np.ndarray:
            v = raw(records, part[name]) if name in part else None
            return np.zeros(n, np.int64) if v is None or v.ndim > 1 else v.astype(np.int64)

        fd = get("EDL") != 0 if kind == "data" else np.zeros(n, bool)
        data = raw(records, part["DataBytes"]) if kind == "data" and "DataBytes" in part else None
        data = np.zeros((n, 0), np.uint8) if data is None else data
        length = np.minimum(data.shape[1], get("DataLength") if "DataLength" in part else data.shape[1])
        payload = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.py_buffer(data[np.arange(data.shape[1]) < length[:, None]].tobytes())])
        kinds = np.where(fd, "fd", "classic") if kind == "data" else np.full(n, kind)
        flag = lambda name: pa.array(get(name) != 0, mask=~fd)
        dlc = pa.nulls(n, pa.int32()) if kind == "error" else pa.array((get("DLC") & 15).astype(np.int32))
        return [
            pa.array(np.full(n, group.index, np.int32)), pa.array(first + np.arange(n)), self.time_ns(group, records), pa.array(np.maximum(0, get("BusChannel") - 1).astype(np.int32)),
            pa.array(get("ID") & 0x1FFFFFFF), pa.array(get("IDE") != 0), pa.array(np.where(get("Dir") == 0, "Rx", "Tx")), pa.array(kinds), payload, flag("BRS"), flag("ESI"), dlc,
        ]

    def signal_columns(self, group: Group, first: int, records: np.ndarray) -> Iterator[list[pa.Array]]:
        n, time = len(records), self.time_ns(group, records)
        for c in group.channels:
            if c.kind == MASTER:
                continue
            value, valid = number(group, records, c)
            keep = pa.array(valid & ~np.asarray(time.is_null()))
            names = [pa.array([x] * n, pa.string()) for x in (group.name, c.name, c.unit)]
            yield [a.filter(keep) for a in (pa.array(np.full(n, group.index, np.int32)), *names, pa.array(first + np.arange(n)), time, pa.array(value))]

    def columns(self, what: str, pieces: Iterator[tuple[Group, int, np.ndarray]]) -> Iterator[list[pa.Array]]:
        """Columns of the frames or signals among pieces."""
        for group, first, records in pieces:
            if group.master is None or (group.frames is None) != (what == "signals"):
                continue
            if what == "signals":
                yield from self.signal_columns(group, first, records)
            else:
                yield self.frame_columns(group, first, records)

    def _tuples(self, what: str) -> Iterator[tuple]:
        for columns in self.columns(what, self.all_pieces()):
            yield from zip(*(c.to_pylist() for c in columns), strict=True)

    def frame_rows(self) -> Iterator[tuple]:
        return self._tuples("frames")

    def signal_rows(self) -> Iterator[tuple]:
        return self._tuples("signals")

    def table_rows(self) -> Iterator[tuple]:
        for g in self.groups:
            for c in g.channels:
                if c.conversion and c.conversion[0] == 7:
                    for code, label in zip(c.conversion[1], c.conversion[2], strict=False):
                        yield g.index, c.name, int(code), label

    def event_rows(self) -> Iterator[tuple]:
        at = self.links[4]
        while at:
            links, data = self._block(at, b"##EV")
            *_, base, factor = EV.unpack_from(data)
            yield self.start_ns + round(base * factor * 1e9), self.text(links[3]), self.text(links[4])
            at = links[0]

    def attachment_rows(self) -> Iterator[tuple]:
        at = self.links[3]
        while at:
            links, data = self._block(at, b"##AT")
            flags, _, _, _, size = AT.unpack_from(data)
            content = data[AT.size : AT.size + size] if flags & 1 else None
            yield self.text(links[1]), self.text(links[2]), zlib.decompress(content) if flags & 2 and content else content
            at = links[0]

    def group_rows(self, counts: dict[int, int] | None = None) -> Iterator[tuple]:
        if counts is None:
            counts = {}
            for g, _, records in self.all_pieces():
                counts[g.index] = counts.get(g.index, 0) + len(records)
        for g in self.groups:
            kind = g.frames[1] if g.frames else "signal"
            yield g.index, g.name, kind, len(g.channels), counts.get(g.index, 0), kind == "signal" and g.source == 2


def raw(records: np.ndarray, c: Channel) -> np.ndarray | None:
    """A channel's stored values, one a record (bytes as rows of a matrix); None if out of the record."""
    first, last = c.byte_offset, c.byte_offset + (c.bit_offset + c.bit_count + 7) // 8
    if last > records.shape[1]:
        return None
    part = records[:, first:last]
    if c.data_type > FLOAT_BE:
        return part
    big = c.data_type in (UINT_BE, INT_BE, FLOAT_BE)
    if c.data_type in (FLOAT_LE, FLOAT_BE):
        return np.ascontiguousarray(part).view(f"{'>' if big else '<'}f{c.bit_count // 8}")[:, 0]
    part = part[:, ::-1] if big else part
    words = np.zeros((len(records), 16), np.uint8)
    words[:, : min(16, part.shape[1])] = part[:, :16]
    low, high = words.view("<u8").T
    shift = np.uint64(c.bit_offset % 64)
    value = low >> shift | (high << (np.uint64(64) - shift) if shift else np.uint64(0))
    if c.bit_count < 64:
        value = value & np.uint64((1 << c.bit_count) - 1)
    if c.data_type in (INT_LE, INT_BE):
        unused = 64 - min(64, c.bit_count)
        return (value << np.uint64(unused)).view(np.int64) >> unused
    return value


def number(group: Group, records: np.ndarray, c: Channel) -> tuple[np.ndarray, np.ndarray]:
    """(physical values, whether valid); value tables keep the code."""
    values, valid = raw(records, c), np.ones(len(records), bool)
    if values is None or values.ndim > 1:
        return np.zeros(len(records)), ~valid
    if c.invalid_bit is not None and group.invalid_bytes:
        byte = group.data_bytes + c.invalid_bit // 8
        if byte < records.shape[1]:
            valid = records[:, byte] >> c.invalid_bit % 8 & 1 == 0
    values = values.astype(np.float64)
    if c.conversion and c.conversion[0] == 1 and len(c.conversion[1]) >= 2:
        values = c.conversion[1][0] + c.conversion[1][1] * values
    return values, valid


_META = {"events": (EVENTS, File.event_rows), "attachments": (ATTACHMENTS, File.attachment_rows), "tables": (TABLES, File.table_rows)}
_PLAN = _fields(("file", _S), ("data_group", _I), ("group", _I), ("block", _I), ("first", _L), ("last", _L), ("counts", T.MapType(_I, _L)))


def _arrow(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def _planned(size: int, batches: Iterator[pa.RecordBatch], marks: bool) -> Iterator[pa.RecordBatch]:
    """Rows of _PLAN: of whole files their plan; with marks, of unsorted blocks their ranges and counts."""
    for batch in batches:
        for r in batch.to_pylist():
            f, rows = File(r["file"]), []
            if marks:
                rows = [(r["file"], r["data_group"], -1, r["block"], a, b, list(c.items())) for a, b, c in f.marks(r["data_group"], r["block"], size)]
            else:
                rows = [(r["file"], *p.values(), []) for p in f.plan(size)]
            f.close()
            if rows:
                yield _arrow(rows, _PLAN)


def mdf_ranges(spark: SparkSession, path: str | list[str], size: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """(the ranges of files' records with the records of each group before them, an upper bound of their number)."""
    files, _ = file_ranges(spark, path, 1 << 62)
    plan = files.select("file").mapInArrow(lambda b: _planned(size, b, False), _PLAN)
    _, n = file_ranges(spark, path, size)
    tasks = min(n, MOST_TASKS)
    mixed = plan.filter("group < 0").repartition(tasks).mapInArrow(lambda b: _planned(size, b, True), _PLAN)
    before = Window.partitionBy("file", "data_group", "key").orderBy("block", "first").rowsBetween(Window.unboundedPreceding, -1)
    counted = mixed.select("file", "data_group", "block", "first", "last", F.explode_outer("counts").alias("key", "n"))
    based = counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row a range
    based = based.groupBy("file", "data_group", "block", "first", "last").agg(F.map_from_entries(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "base")))).alias("base"), F.map_from_entries(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "n")))).alias("counts"))
    based = based.select("file", "data_group", F.lit(-1).alias("group"), "block", "first", "last", "counts", "base")
    whole = plan.filter("group >= 0").select("file", "data_group", "group", "block", "first", "last", F.create_map("group", F.col("last") - F.col("first")).alias("counts"), F.create_map("group", F.lit(0).cast("long")).alias("base"))
    return whole.unionByName(based), tasks


def read_mdf(spark: SparkSession, path: str | list[str], what: str = "frames", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of files: frames, signals, events, attachments, tables (value to text) or groups (a census). Tasks open files
    where pyarrow's file systems reach them: local and mounted paths, HDFS, S3, GCS."""
    if what in _META:
        schema, rows_of = _META[what]

        def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file in batch.column(0).to_pylist():
                    f = File(file)
                    rows = [(file, *row) for row in rows_of(f)]
                    f.close()
                    if rows:
                        yield _arrow(rows, schema)

        return file_ranges(spark, path, 1 << 62)[0].select("file").mapInArrow(described, schema)
    ranges, tasks = mdf_ranges(spark, path, range_bytes)
    if what == "groups":
        counts = ranges.select("file", F.explode("counts").alias("key", "n")).groupBy("file", "key").agg(F.sum("n").alias("n"))
        counts = counts.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("counts"))
        files = file_ranges(spark, path, 1 << 62)[0].select("file").join(counts, "file", "left")

        def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    f = File(r["file"])
                    rows = [(r["file"], *row) for row in f.group_rows(dict(r["counts"] or []))]
                    f.close()
                    if rows:
                        yield _arrow(rows, GROUPS)

        return files.mapInArrow(census, GROUPS)
    schema = {"frames": FRAMES, "signals": SIGNALS}[what]
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, File] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] not in opened:
                    for f in opened.values():
                        f.close()
                    opened = {r["file"]: File(r["file"])}
                f = opened[r["file"]]
                for columns in f.columns(what, f.pieces(r | {"base": dict(r["base"] or [])})):
                    columns = [pa.array([r["file"]] * len(columns[0]), pa.string()), *columns]
                    yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

    return ranges.drop("counts").repartition(tasks).mapInArrow(run, schema)


def with_emission_key(frames: DataFrame) -> DataFrame:
    """frames with `_due`, the latest time of their group up to them: a merge that always takes the group whose next frame is
    earliest emits by (_due, group, record_no), also where a group's times fall back. Ranges of records carry it over."""
    return running_max(frames, F.col("timestamp_ns"), "_due", ("file", "group"), ("record_no",))


def emission_order(frames: DataFrame) -> DataFrame:
    """frames as a merge of each file's groups by their next frames emits them, ties in the order of groups."""
    return with_emission_key(frames).orderBy("file", "_due", "group", "record_no").drop("_due")


def mdf_census(spark: SparkSession, path: str | list[str]) -> DataFrame:
    f = read_mdf(spark, path).groupBy("file").agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.count("*").alias("frames"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))
    g = read_mdf(spark, path, "groups").filter("kind = 'signal' and records > 0").groupBy("file").agg(F.count("*").alias("signal_groups"), F.sum("records").alias("samples"))
    return f.join(g, "file", "full").fillna(0, ["frames", "signal_groups", "samples"])


class _Blocks:
    """Appends blocks and lets links be set afterwards."""

    def __init__(self):
        self.out = bytearray()

    def add(self, sign: bytes, links: list[int], data: bytes) -> int:
        self.out += bytes(-len(self.out) % 8)
        at = len(self.out)
        self.out += HEAD.pack(sign, HEAD.size + 8 * len(links) + len(data), len(links)) + struct.pack(f"<{len(links)}Q", *links) + data
        return at

    def link(self, block: int, n: int, target: int) -> None:
        struct.pack_into("<Q", self.out, block + HEAD.size + 8 * n, target)

    def text(self, text: str) -> int:
        data = text.encode() + b"\0"
        return self.add(b"##TX", [], data + bytes(-len(data) % 8)) if text else 0


#: members of a bus structure: name, byte, bit, bits (the payload follows)
_MEMBERS = (("BusChannel", 8, 0, 8), ("ID", 9, 0, 29), ("IDE", 12, 5, 1), ("Dir", 12, 6, 1), ("DLC", 13, 0, 4), ("EDL", 13, 4, 1), ("BRS", 13, 5, 1), ("ESI", 13, 6, 1), ("DataLength", 14, 0, 8))


@dataclass
class Written:
    """Frames of a kind that stand in data blocks behind the head: their number, most payload bytes, and the block sizes."""

    count: int = 0
    most: int = 0
    sizes: list[int] = field(default_factory=list)


def build(frames: list[dict], signals: list[dict] = (), events: list[dict] = (), attachments: list[tuple[str, bytes]] = (), start_ns: int | None = None, written: dict[str, Written] | None = None) -> bytes:
    """A sorted, finalized 4.10 file: data, error and remote frames in groups of their own, one group per signal
    {name, unit, points: [(ns, value)]}, events {timestamp_ns, label, comment}, embedded attachments.

    With `written` (by kind) it is the head of a file whose frames follow in data blocks, listed by where they will stand.
    """
    times = [f["timestamp_ns"] for f in frames] + [e["timestamp_ns"] for e in events] + [t for s in signals for t, _ in s["points"]]
    start = min(times, default=0) if start_ns is None else start_ns
    b = _Blocks()
    b.out += b"MDF     " + b"4.10    " + b"busloom " + bytes(4) + struct.pack("<H", 410) + bytes(34)
    hd = b.add(b"##HD", [0] * 6, HD.pack(start, 0, 0, 0, 0, 0, 0.0, 0.0))
    b.link(hd, 1, b.add(b"##FH", [0, 0], struct.pack("<QhhB3x", start, 0, 0, 0)))
    last = (hd, 0)

    def channel(name: str, kind: int, data_type: int, byte: int, bit: int, bits: int, unit: str = "", sync: int = 0) -> int:
        return b.add(b"##CN", [0, 0, b.text(name), 0, 0, 0, b.text(unit), 0], CN.pack(kind, sync, data_type, bit, byte, bits, 0, 0, 0, 0, *[0.0] * 6))

    lists: list[tuple[int, list[int]]] = []

    def group(name: str, first: int, size: int, records: list[bytes], bus: int, given: Written | None = None) -> None:
        nonlocal last
        source = b.add(b"##SI", [b.text(name), 0, 0], struct.pack("<BBB5x", 2 if bus else 0, bus, 0)) if bus else 0
        cg = b.add(b"##CG", [0, first, b.text(name), source, 0, 0], CG.pack(0, given.count if given else len(records), 6 if bus else 0, ord(".") if bus else 0, size, 0))
        if given:
            starts = np.concatenate([[0], np.cumsum([n - HEAD.size for n in given.sizes])]).astype(int)[:-1]
            data = b.add(b"##DL", [0] * (len(given.sizes) + 1), struct.pack("<B3xI", 0, len(given.sizes)) + struct.pack(f"<{len(starts)}Q", *starts))
            lists.append((data, given.sizes))
        else:
            data = b.add(b"##DT", [], b"".join(records))
        dg = b.add(b"##DG", [0, cg, data, 0], struct.pack("<B7x", 0))
        b.link(*last, dg)
        last = (dg, 0)

    for name, kind in FRAME_GROUPS.items():
        own = [f for f in frames if (f["kind"] if f["kind"] in ("error", "remote") else "data") == kind]
        given = written.get(kind, Written()) if written is not None else None
        most = given.most if given else max([len(f["data"] or b"") for f in own], default=0)
        first = channel("time", MASTER, FLOAT_LE, 0, 0, 64, "s", 1)
        parent = channel(name, FIXED, BYTES, 8, 0, (7 + most) * 8)
        b.link(first, 0, parent)
        before = (parent, 1)
        members = [(f"{name}.{n}", UINT_LE, byte, bit, bits) for n, byte, bit, bits in _MEMBERS]
        members += [(f"{name}.DataBytes", BYTES, 15, 0, most * 8)] if most else []
        for n, data_type, byte, bit, bits in members:
            at = channel(n, FIXED, data_type, byte, bit, bits)
            b.link(*before, at)
            before = (at, 0)
        records = []
        for f in own:
            data = bytes(f["data"] or b"")
            word = f["id"] | (1 << 29 if f["extended"] else 0) | (1 << 30 if f["direction"] == "Tx" else 0)
            dlc = f.get("dlc")
            dlc = len(data) if dlc is None else dlc
            flags = dlc & 15 | (1 << 4 if f["kind"] == "fd" else 0) | (1 << 5 if f.get("brs") else 0) | (1 << 6 if f.get("esi") else 0)
            records.append(struct.pack("<dBIBB", (f["timestamp_ns"] - start) / 1e9, (f["channel"] or 0) + 1, word, flags, len(data)) + data.ljust(most, b"\0"))
        group(name, first, 15 + most, records, 2, given)
    for s in signals:
        first = channel("time", MASTER, FLOAT_LE, 0, 0, 64, "s", 1)
        b.link(first, 0, channel(s["name"], FIXED, FLOAT_LE, 8, 0, 64, s.get("unit", "")))
        group(s.get("group", s["name"]), first, 16, [struct.pack("<dd", (t - start) / 1e9, v) for t, v in s["points"]], 0)
    before = (hd, 4)
    for e in sorted(events, key=lambda e: e["timestamp_ns"]):
        at = b.add(b"##EV", [0, 0, 0, b.text(e.get("label", "")), b.text(e.get("comment", ""))], EV.pack(6, 1, 0, 0, 0, 0, 0, 0, e["timestamp_ns"] - start, 1e-9))
        b.link(*before, at)
        before = (at, 0)
    before = (hd, 3)
    for name, content in attachments:
        at = b.add(b"##AT", [0, b.text(name), b.text("application/octet-stream"), 0], AT.pack(1, 0, bytes(16), len(content), len(content)) + content)
        b.link(*before, at)
        before = (at, 0)
    if lists:
        b.out += bytes(-len(b.out) % 8)
        at = len(b.out)
        for block, sizes in lists:
            for k, size in enumerate(sizes):
                b.link(block, k + 1, at)
                at += size + -size % 8
    return bytes(b.out)


def _records(batch: pa.RecordBatch, start_ns: int, most: int) -> bytes:
    """Frames of one kind as records of 15 + most bytes."""
    n = batch.num_rows
    column = lambda name, default=0: batch.column(name).fill_null(default).to_numpy(zero_copy_only=False)
    data, length = matrix(batch.column("data"), most)
    is_ = lambda name, value: np.asarray(batch.column(name).fill_null("")) == value
    word = column("id").astype(np.uint32) | column("extended", False).astype(np.uint32) << 29 | is_("direction", "Tx").astype(np.uint32) << 30
    dlc = np.where(np.asarray(batch.column("dlc").is_null()), length, column("dlc"))
    flags = dlc.astype(np.uint8) & 15 | is_("kind", "fd").astype(np.uint8) << 4 | column("brs", False).astype(np.uint8) << 5 | column("esi", False).astype(np.uint8) << 6
    seconds = (column("timestamp_ns") - start_ns) / 1e9
    parts = [seconds.astype("<f8").view(np.uint8).reshape(n, 8), (column("channel") + 1).astype(np.uint8)[:, None], word.astype("<u4").view(np.uint8).reshape(n, 4), flags[:, None], length.astype(np.uint8)[:, None], data[:, :most]]
    return np.concatenate(parts, axis=1).tobytes()


def save_mdf(frames: DataFrame, path: str, **parts) -> None:
    """One file of the whole capture in row order under path, in any store that pyarrow writes.

    Range partitions write the records of each kind of frame aside as a data block of their own, in parallel; the head
    lists the blocks at the places that their sizes give, and one task streams head and blocks into the file. `parts` are
    build()'s signals, events and attachments, given by the caller. The driver sees a row a block.
    """
    spark = frames.sparkSession
    columns = ("idx", "timestamp_ns", "channel", "id", "extended", "direction", "kind", "data", "brs", "esi", "dlc")
    of = F.when(F.col("kind").isin("error", "remote"), F.col("kind")).otherwise("data")
    size = F.coalesce(F.max(F.length("data")), F.lit(0))
    found = {r["of"]: r for r in frames.groupBy(of.alias("of")).agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("first"), size.alias("most")).collect()}
    written = {kind: Written(r["n"], r["most"]) for kind, r in found.items()}
    given = [e["timestamp_ns"] for e in parts.get("events", ())] + [t for s in parts.get("signals", ()) for t, _ in s["points"]]
    start = parts.pop("start_ns", None)
    start = min([r["first"] for r in found.values()] + given, default=0) if start is None else start
    most = {kind: w.most for kind, w in written.items()}
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    store, inner = store_of(aside)
    store.create_dir(inner, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        open_, names = {}, {kind: f"{aside}/{uuid.uuid4().hex}" for kind in most}
        for batch in batches:
            kinds = np.asarray(batch.column("of"))
            for kind in np.unique(kinds):
                if kind not in open_:
                    own, at = store_of(names[kind])
                    open_[kind] = [own.open_output_stream(at), 0]
                data = _records(batch.filter(pa.array(kinds == kind)), start, most[kind])
                open_[kind][0].write(data)
                open_[kind][1] += len(data)
        part = TaskContext.get().partitionId()
        for kind, (stream, n) in open_.items():
            stream.write(bytes(-n % 8))
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, str(kind), names[kind], n)], ["part", "kind", "path", "size"])

    rows = frames.select(*columns, of.alias("of")).orderBy("idx").mapInArrow(run, "part long, kind string, path string, size long").collect()
    pieces: list[str] = []
    for kind in FRAME_GROUPS.values():
        for r in sorted(rows):
            if r["kind"] == kind:
                # a block's own head is a piece too
                header = f"{aside}/{uuid.uuid4().hex}"
                write_piece(header, iter([HEAD.pack(b"##DT", HEAD.size + r["size"], 0)]))
                written[kind].sizes.append(HEAD.size + r["size"])
                pieces += [header, r["path"]]
    join_pieces(spark, build([], start_ns=start, written=written, **parts), pieces, path, "part-00000.mf4")
    store.delete_dir(inner)
