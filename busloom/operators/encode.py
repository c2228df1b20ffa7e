"""Encoding signals into payloads, calculated fields, periodic schedules, rest-of-bus payloads and bus arbitration."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import positions, runs
from ..functions.crc import crc_rows, lookup
from ..functions.payloads import binary, matrix, names_where, put
from ..model import same, small, with_dense_index
from ..plans.catalog import Catalog
from ..sources.dbc import CounterConfig, CrcConfig, Message, Signal
from .decode import raw_value
from .series import numbered
from .verify import resolve


def put_bits(payload: bytearray, signal: Signal, raw: int) -> bool:
    """Write a raw value; False (and nothing written) if the field does not fit the payload."""
    bits = positions(signal.start, signal.size, signal.little)
    if bits is None or max(bits) // 8 >= len(payload):
        return False
    for i, b in enumerate(bits):
        mask = 1 << b % 8
        payload[b // 8] = payload[b // 8] & ~mask | (mask if raw >> i & 1 else 0)
    return True


def get_bits(payload: bytes, signal: Signal) -> int | None:
    bits = positions(signal.start, signal.size, signal.little)
    if bits is None or max(bits) // 8 >= len(payload):
        return None
    return sum((payload[b // 8] >> b % 8 & 1) << i for i, b in enumerate(bits))


def limits(signal: Signal) -> tuple[int, int]:
    n = signal.size
    return (-(1 << n - 1), (1 << n - 1) - 1) if signal.signed else (0, (1 << n) - 1)


def physical_to_raw(signal: Signal, value: float) -> tuple[int, bool]:
    """(raw bit pattern, whether it was saturated). Rounds half away from zero; values that are no number or infinite
    become the largest raw value."""
    low, high = limits(signal)
    if signal.is_float:
        import struct

        x = (value - signal.offset) / signal.factor if signal.factor else math.nan
        kinds = ("<f", "<I") if signal.size == 32 else ("<d", "<Q")
        try:
            return struct.unpack(kinds[1], struct.pack(kinds[0], x))[0], False
        except OverflowError:
            return struct.unpack(kinds[1], struct.pack(kinds[0], math.copysign(math.inf, x)))[0], True
    x = (value - signal.offset) / signal.factor if signal.factor else math.nan
    if not math.isfinite(x):
        return high & (1 << signal.size) - 1, True
    whole = math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)
    kept = min(max(whole, low), high)
    return kept & (1 << signal.size) - 1, kept != whole


def raw_rows(signal: Signal, value: np.ndarray) -> np.ndarray:
    """physical_to_raw of many values, as unsigned 64-bit patterns."""
    with np.errstate(all="ignore"):
        x = (value - signal.offset) / signal.factor if signal.factor else np.full(len(value), np.nan)
        if signal.is_float:
            return x.astype(np.float32).view(np.uint32).astype(np.uint64) if signal.size == 32 else x.view(np.uint64)
        whole = np.where(x >= 0, 1.0, -1.0) * np.floor(np.abs(x) + 0.5)
        low, high = limits(signal)
        over, under = ~np.isfinite(x) | (whole >= float(high)), whole <= float(low)
        inside = np.where(over | under, 0.0, whole)
        kept = inside.astype(np.int64).view(np.uint64) if signal.signed else inside.astype(np.uint64)
    mask = (1 << signal.size) - 1
    return np.where(over, np.uint64(high & mask), np.where(under, np.uint64(low & mask), kept & np.uint64(mask)))


def raw_column(signal: Signal, value: Column) -> Column:
    """physical_to_raw for integer signals of up to 53 bits, as a Column."""
    low, high = limits(signal)
    x = (value - F.lit(signal.offset)) / F.lit(signal.factor)
    whole = F.floor(F.abs(x) + 0.5) * F.signum(x)
    good = ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = F.when(good, F.greatest(F.least(whole, F.lit(float(high))), F.lit(float(low)))).otherwise(float(high)).cast("long")
    return kept.bitwiseAND(F.lit((1 << signal.size) - 1))


def encode_frames(frames: DataFrame, message: Message, values: dict[str, Column]) -> DataFrame:
    """frames with `data` overwritten by the given physical values, other bits kept, and written / skipped signal names.

    Signals are written in declaration order; an absent payload starts from zeros of the message's length.
    """
    names = [s.name for s in message.signals if s.name in values]
    skipped = sorted(set(values) - set(names))
    specs = [message.signal(n) for n in names]

    places = [runs(x.start, x.size, x.little) for x in specs]

    def run(data: pa.Array, *columns: pa.Array) -> pa.Array:
        rows, length = matrix(data, message.length)
        length = np.where(np.asarray(data.is_null()), message.length, length)
        done = np.zeros((len(rows), len(specs)), bool)
        for k, (signal, place, column) in enumerate(zip(specs, places, columns, strict=True)):
            value = column.to_numpy(zero_copy_only=False).astype(np.float64)
            given = ~np.asarray(column.is_null()) & ~np.isnan(value)
            done[:, k] = put(rows, length, place, raw_rows(signal, value), given)
        left = np.concatenate([np.ones((len(rows), len(skipped)), bool), ~done], axis=1)
        parts = [binary(rows, length), names_where(names, done), names_where([*skipped, *names], left)]
        return pa.StructArray.from_arrays(parts, ["data", "written", "skipped"])

    schema = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("written", T.ArrayType(T.StringType())), T.StructField("skipped", T.ArrayType(T.StringType()))])
    packed = F.arrow_udf(run, schema)(F.col("data"), *[values[n].cast("double") for n in names])
    return frames.withColumn("_e", packed).withColumns({"data": F.col("_e.data"), "written": F.col("_e.written"), "skipped": F.col("_e.skipped")}).drop("_e")


def merge_calc(base: Message, counter: CounterConfig | None = None, checksum: CrcConfig | None = None) -> tuple[CounterConfig | None, CrcConfig | None]:
    """Each field's override, else the database's; checked against the message."""
    out = counter or base.counter, checksum or base.crc
    resolve(base, *out)
    return out


def apply_calc(frames: DataFrame, message: Message, *key: str, counter: CounterConfig | None = None, checksum: CrcConfig | None = None) -> DataFrame:
    """Frames of one message with their counter stepped per key in idx order, then the checksum over the updated bytes.

    The counter is the first frame's own value plus the increment times the rank, so it needs no sequential state: a
    rank by ranges and one first value a key.
    """
    counter, checksum = merge_calc(message, counter, checksum)
    out = frames.withColumn("_count", F.lit(None).cast("long"))
    if counter:
        modulo = (counter.rollover if counter.rollover is not None else (1 << message.signal(counter.signal).size) - 1) + 1
        seeds = frames.groupBy(*key).agg(F.min_by(F.struct(raw_value(message.signal(counter.signal)).alias("v")), "idx")["v"].alias("_seed"))
        ranked = numbered(frames.withColumn("t", F.lit(0)), *key)
        of, on = same(ranked, small(seeds), key)
        step = F.pmod(F.col("_seed") + (F.col("rn") + 1) * counter.increment, F.lit(modulo))
        out = ranked.join(of, on).select(*frames.columns, step.alias("_count"))
    count_at, crc_at = message.signal(counter.signal) if counter else None, message.signal(checksum.signal) if checksum else None
    params = lookup(checksum.algorithm) if checksum else None

    place = lambda x: None if x is None else runs(x.start, x.size, x.little)
    count_runs, crc_runs = place(count_at), place(crc_at)

    def run(data: pa.Array, count: pa.Array) -> pa.Array:
        rows, length = matrix(data, 1)
        if count_runs is not None:
            put(rows, length, count_runs, count.fill_null(0).to_numpy().astype(np.uint64), ~np.asarray(count.is_null()))
        if crc_runs is not None:
            first, last = checksum.first_bit // 8, (checksum.first_bit + checksum.bits) // 8
            if rows.shape[1] >= last:
                put(rows, length, crc_runs, crc_rows(rows[:, first:last], params, checksum.prefix), length >= last)
        return binary(rows, length)

    return out.withColumn("data", F.arrow_udf(run, T.BinaryType())("data", "_count")).drop("_count")


def stagger_ns(identity: Column, period_ms: Column) -> Column:
    """A phase in [0, period) that depends on the identity alone."""
    return F.pmod(F.xxhash64(identity), (period_ms * 1_000_000).cast("long"))


def schedule(entries: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Due times of entries (entry, period_ms) on their fixed grids in [start, end): no catch-up bursts, no drift."""
    period = (F.col("period_ms") * 1_000_000).cast("long")
    first = F.lit(start_ns) + stagger_ns(F.col("entry"), F.col("period_ms"))
    ticks = F.when(first < end_ns, F.sequence(F.lit(0).cast("long"), F.floor((F.lit(end_ns - 1) - first) / period)))
    out = entries.filter("period_ms > 0").withColumns({"_first": first, "_period": period}).withColumn("tick", F.explode(ticks))
    return out.withColumn("due_ns", F.col("_first") + F.col("tick") * F.col("_period")).drop("_first", "_period")


@dataclass(frozen=True)
class RestOfBus:
    """A simulation document: what is muted, which buses and ECUs play, and overrides of messages."""

    document: dict

    def enabled(self, message: str) -> bool:
        return message not in self.document.get("disabled_messages", [])

    def override(self, bus: str, ecu: str, message: str) -> dict:
        return self.document.get("buses", {}).get(bus, {}).get("ecus", {}).get(ecu, {}).get("messages", {}).get(message, {})

    def playing(self, bus: str, ecu: str, message: str, running: bool = True, killed: bool = False) -> bool:
        b = self.document.get("buses", {}).get(bus, {})
        return running and not killed and b.get("enabled", True) and b.get("ecus", {}).get(ecu, {}).get("enabled", True) and self.enabled(message)

    def payload(self, bus: str, message: Message) -> tuple[bytes, list[str]]:
        """Fill bit, then start values, then overrides: numbers are physical, `0x` texts raw, other texts labels."""
        warnings: list[str] = []
        buffer = bytearray((b"\xff" if self.document.get("fill_bit") else b"\0") * message.length)
        for s in message.signals:
            if s.start_value is not None and not isinstance(s.mux, int):
                put_bits(buffer, s, int(s.start_value) & (1 << s.size) - 1)
        for name, value in self.override(bus, message.transmitter, message.name).get("signals", {}).items():
            s = message.signal(name)
            if s is None:
                warnings.append(f"{message.name} has no signal {name}")
                continue
            if isinstance(value, str) and re.fullmatch(r"0[xX][0-9a-fA-F]+", value):
                raw, cut = int(value, 16) & (1 << s.size) - 1, int(value, 16) >> s.size != 0
            elif isinstance(value, str):
                found = next((r for r, t in s.values if t == value), None)
                if found is None:
                    warnings.append(f"{name} has no value {value}")
                    continue
                raw, cut = found & (1 << s.size) - 1, False
            else:
                raw, cut = physical_to_raw(s, float(value))
            if cut:
                warnings.append(f"{name} was cut to its range")
            if not put_bits(buffer, s, raw):
                warnings.append(f"{name} does not fit the payload")
        return bytes(buffer), warnings

    def entries(self, catalog: Catalog) -> list[tuple[str, str, str, int, bool, int, bytes]]:
        """(entry, bus, message, id, extended, period_ms, payload) of what plays with a period."""
        out = []
        for bus, m, _ in catalog.winners():
            period = self.override(bus, m.transmitter, m.name).get("period_ms", m.cycle_ms)
            if period and self.playing(bus, m.transmitter, m.name):
                out.append((f"{bus}|{m.id}|{m.extended}", bus, m.name, m.id, m.extended, int(period), self.payload(bus, m)[0]))
        return out

    def view(self, catalog: Catalog) -> list[dict]:
        """Overrides joined to the databases' messages by bus and ECU; entries without a message stay."""
        rows = {(b, m.transmitter, m.name): {"bus": b, "ecu": m.transmitter, "message": m.name, "known": True, "period_ms": m.cycle_ms, "enabled": self.enabled(m.name)} for b, m, _ in catalog.winners()}
        for b, bus in self.document.get("buses", {}).items():
            for e, ecu in bus.get("ecus", {}).items():
                for n, own in ecu.get("messages", {}).items():
                    row = rows.setdefault((b, e, n), {"bus": b, "ecu": e, "message": n, "known": False, "period_ms": None, "enabled": self.enabled(n)})
                    row["period_ms"] = own.get("period_ms", row["period_ms"])
        return [rows[k] for k in sorted(rows)]


def transmitted(scheduled: DataFrame) -> DataFrame:
    """Tx frames of scheduled entries (bus_id, id, extended, due_ns, data): the confirmation that is stored."""
    return scheduled.select(
        F.col("due_ns").alias("timestamp_ns"), "bus_id", "id", "extended", F.lit("Tx").alias("direction"), F.lit("classic").alias("kind"), "data"
    )


_ARBITRATED = "bus_id string, sender string, id long, extended boolean, enqueued_ns long, start_ns long, end_ns long"


def arbitrate(requests: DataFrame) -> DataFrame:
    """Send times on each bus of requests (bus_id, sender, id, extended, enqueued_ns, duration_ns, ord).

    One timeline a bus: when it is free, the lowest raw id of what waits goes, then the earliest request. A bus is
    sequential by nature, so each is one group; its requests stream through a heap, sorted by time in Spark.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple] = []  # what has been enqueued, by id, then time
        free, bus = 0, None

        def drain(until: int | None) -> list[tuple]:
            """Send what starts before the next request arrives."""
            nonlocal free
            out = []
            while waiting and (until is None or free < until):
                *_, r = heapq.heappop(waiting)
                start = max(free, r.enqueued_ns)
                free = start + r.duration_ns
                out.append((r.bus_id, r.sender, r.id, r.extended, r.enqueued_ns, start, free))
            return out

        for pdf in batches:
            rows: list[tuple] = []
            for r in pdf.itertuples(index=False):
                if r.bus_id != bus:
                    rows += drain(None)
                    bus, free = r.bus_id, 0
                rows += drain(r.enqueued_ns)
                free = max(free, r.enqueued_ns) if not waiting else free
                heapq.heappush(waiting, (r.id, r.enqueued_ns, r.ord, r))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ARBITRATED.split(", ")])
        yield pd.DataFrame(drain(None), columns=[c.split()[0] for c in _ARBITRATED.split(", ")])

    sorted_ = requests.repartition("bus_id").sortWithinPartitions("bus_id", "enqueued_ns", "ord")
    return sorted_.mapInPandas(run, _ARBITRATED)


def fan_out(sent: DataFrame, participants: DataFrame) -> DataFrame:
    """Each sent frame to all other participants (bus_id, participant) of its bus, as Rx at its end; `acknowledged` tells
    whether anyone was there."""
    others = participants.withColumnRenamed("participant", "receiver")
    met = sent.join(F.broadcast(others), "bus_id", "left").filter(F.col("receiver").isNull() | (F.col("receiver") != F.col("sender")))
    lone = sent.join(F.broadcast(others), (sent["bus_id"] == others["bus_id"]) & (others["receiver"] != sent["sender"]), "left_anti")
    got = met.filter("receiver is not null").withColumns({"direction": F.lit("Rx"), "timestamp_ns": F.col("end_ns"), "acknowledged": F.lit(True)})
    none = lone.withColumns({"receiver": F.lit(None).cast("string"), "direction": F.lit(None).cast("string"), "timestamp_ns": F.col("end_ns"), "acknowledged": F.lit(False)})
    return got.unionByName(none)


def batches_by_route(frames: DataFrame) -> DataFrame:
    """Frames (destination, ord, ...) with the place of their batch and in it: batches stand by their destination's first
    frame, frames by ord. A batch stays rows, however many frames one destination has; sort by (batch, place) to send."""
    first = frames.groupBy("destination").agg(F.min("ord").alias("_first"))
    batch = small(first.withColumn("batch", F.row_number().over(Window.orderBy("_first", "destination")) - 1).drop("_first"))  # one row a destination
    placed = with_dense_index(frames, "destination", "ord", name="_at")
    start = small(placed.groupBy("destination").agg(F.min("_at").alias("_start")))
    return placed.join(start, "destination").join(batch, "destination").withColumn("place", F.col("_at") - F.col("_start")).drop("_at", "_start")
