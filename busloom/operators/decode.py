"""Decoding payload bits into physical signals with generated Column expressions.

Two rules choose among databases: `decode_frames` takes the whole message from the first database that knows the id on
the bus; `decode_series` takes each signal from the first database that yields it for the frame.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import ieee, raw_bits, sign_extend, unsigned, words_of
from ..plans.catalog import Catalog, message_table
from ..sources.dbc import Message, Signal

SIGNAL_TYPE = "struct<name:string,unit:string,raw_unsigned:bigint,raw_signed:bigint,value:double,is_enum:boolean,hex:boolean,label:string>"


def raw_value(signal: Signal, data: Column | str = "data") -> Column:
    data = F.col(data) if isinstance(data, str) else data
    return raw_bits(data, signal.start, signal.size, signal.little)


def physical(signal: Signal, raw: Column, exact: bool = False) -> Column:
    """Raw bits to the physical value. Multiply and add round separately; exact=True fuses them (Arrow-batched)."""
    if signal.is_float:
        number = ieee(raw, signal.size)
    elif signal.signed:
        number = sign_extend(raw, signal.size).cast("double")
    else:
        number = unsigned(raw, signal.size)
    if exact:
        factor, offset = signal.factor, signal.offset

        def fused(x: pd.Series) -> pd.Series:
            return x.map(lambda v: math.fma(v, factor, offset), na_action="ignore")

        return F.pandas_udf(fused, T.DoubleType())(number)
    if signal.factor == 1 and signal.offset == 0:
        return number
    return number * F.lit(signal.factor) + F.lit(signal.offset)


def label(signal: Signal, raw: Column) -> Column:
    """The value table's text for exactly this raw value (as signed where the signal is)."""
    if not signal.values or signal.is_float:
        return F.lit(None).cast("string")
    table = F.create_map(*[x for r, text in dict(reversed(signal.values)).items() for x in (F.lit(r).cast("long"), F.lit(text))])
    key = sign_extend(raw, signal.size) if signal.signed else F.when(raw >= 0, raw)
    return F.try_element_at(table, key)


def applies(signal: Signal, message: Message, data: Column) -> Column | None:
    """Whether a multiplexed signal is sent under the frame's selector; None if it always is."""
    if not isinstance(signal.mux, int):
        return None
    selector = message.multiplexor
    return F.lit(False) if selector is None else F.coalesce(raw_value(selector, data) == signal.mux, F.lit(False))


def signal_value(signal: Signal, message: Message, data: Column | str = "data", exact: bool = False) -> Column:
    """The physical value of a signal in a frame; null where the frame does not carry it."""
    data = F.col(data) if isinstance(data, str) else data
    value = physical(signal, raw_value(signal, data), exact)
    when = applies(signal, message, data)
    return value if when is None else F.when(when, value)


def signal_struct(signal: Signal, raw: Column, selector: Column | None) -> Column:
    """A signal of a frame from its raw bits, null where the frame does not carry it."""
    built = F.struct(
        F.lit(signal.name).alias("name"),
        F.lit(signal.unit).alias("unit"),
        raw.alias("raw_unsigned"),
        sign_extend(raw, signal.size).alias("raw_signed"),
        physical(signal, raw).alias("value"),
        F.lit(signal.is_enum).alias("is_enum"),
        F.lit(signal.hex).alias("hex"),
        label(signal, raw).alias("label"),
    )
    there = raw.isNotNull()
    if isinstance(signal.mux, int):
        there = there & (F.lit(False) if selector is None else F.coalesce(selector == signal.mux, F.lit(False)))
    return F.when(there, built)


def computed_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that later expressions may read any number of times: a generator of one row, through which the
    optimiser pushes conditions on other columns but doesn't copy the value into each of its uses."""
    return rows.select("*", F.inline_outer(F.array(F.struct(value.alias(name)))))


def mux_selector(message: Message, data: Column | str = "data") -> Column:
    selector = message.multiplexor
    return F.lit(None).cast("long") if selector is None else raw_value(selector, data)


def keyed(frames: DataFrame, keys: dict[tuple[str, int, bool], int], name: str, how: str = "inner") -> DataFrame:
    """frames with the number that keys gives to (bus_id, id, extended), by a broadcast join: keys are schema, not data."""
    rows = [(*k, v) for k, v in keys.items()]
    table = frames.sparkSession.createDataFrame(rows, f"bus_id string, id long, extended boolean, {name} int")
    return frames.join(F.broadcast(table), ["bus_id", "id", "extended"], how)


def by_number(column: str, values: list[Column], otherwise: Column) -> Column:
    """values[i] where the column is i."""
    out = None
    for i, v in enumerate(values):
        out = F.when(F.col(column) == i, v) if out is None else out.when(F.col(column) == i, v)
    return otherwise if out is None else out.otherwise(otherwise)


def decode_frames(frames: DataFrame, catalog: Catalog) -> DataFrame:
    """frames with message, ecu, expected_length and signals (null if no database knows the id on the bus).

    A short payload keeps the message with the signals that fit. Frames are joined with the broadcast catalogue; signal
    arrays are generated once per signal layout, shared by all messages and buses that use it.
    """
    layouts: dict[tuple[Signal, ...], tuple[int, Message]] = {}
    keys = {(bus, m.id, m.extended): layouts.setdefault(m.signals, (len(layouts), m))[0] for bus, m, _ in catalog.winners()}
    none, one = F.lit(None).cast(f"array<{SIGNAL_TYPE}>"), f"array<{SIGNAL_TYPE}>"
    empty = F.array().cast(one)
    fields = [(s.start, s.size, s.little) for _, m in layouts.values() for s in m.signals]
    raws, arrays = [], []
    for _, m in layouts.values():
        raws.append(F.array(*[raw_bits(F.col("data"), s.start, s.size, s.little, F.col("_words")) for s in m.signals]).cast("array<bigint>"))
        selector = next((F.get("_raw", i) for i, s in enumerate(m.signals) if s.mux == "M"), None)
        parts = [signal_struct(s, F.get("_raw", i), selector) for i, s in enumerate(m.signals)]
        # flatten, unlike a filter by a lambda, stays in generated code
        arrays.append(F.flatten(F.array(*[F.when(p.isNotNull(), F.array(p)).otherwise(empty) for p in parts])) if parts else empty)
    winners = message_table(frames.sparkSession, catalog).select("bus_id", "id", "extended", "message", "ecu", F.col("length").alias("expected_length"))
    named = keyed(winners, keys, "_layout", "left")
    joined = frames.join(F.broadcast(named), ["bus_id", "id", "extended"], "left")
    read = computed_once(joined, "_words", F.when(F.col("_layout").isNotNull(), words_of(F.col("data"), fields)))
    read = computed_once(read, "_raw", by_number("_layout", raws, F.lit(None).cast("array<bigint>")))
    return read.withColumn("signals", by_number("_layout", arrays, none)).drop("_layout", "_words", "_raw")


def decode_series(frames: DataFrame, catalog: Catalog, wanted: list[tuple[str, int, bool, str]]) -> DataFrame:
    """Long series (bus_id, id, extended, signal, idx, timestamp_ns, t, value) of the wanted signals.

    Frames are narrowed to the wanted ids first (pushed to the scan); each frame is decoded once for all its signals.
    """
    by_key: dict[tuple[str, int, bool], list[str]] = {}
    for bus, can_id, extended, name in wanted:
        by_key.setdefault((bus, can_id, extended), []).append(name)
    ids = sorted({k[1] for k in by_key})
    none = F.array().cast("array<struct<signal:string,value:double>>")
    layouts: dict[tuple, int] = {}
    arrays: list[Column] = []
    numbers: dict[tuple[str, int, bool], int] = {}
    for (bus, can_id, extended), names in by_key.items():
        chains = [(n, catalog.chain(bus, can_id, extended, n)) for n in dict.fromkeys(names)]
        chains = [(n, c) for n, c in chains if c]
        layout = tuple((n, tuple((s, m.multiplexor) for m, s in c)) for n, c in chains)
        if chains and layout not in layouts:
            layouts[layout] = len(arrays)
            arrays.append(F.array(*[F.struct(F.lit(n).alias("signal"), F.coalesce(*[signal_value(s, m) for m, s in c]).alias("value")) for n, c in chains]))
        if chains:
            numbers[bus, can_id, extended] = layouts[layout]
    narrow = frames.filter(F.col("id").isin(ids) & F.col("kind").isin("classic", "fd"))
    found = keyed(narrow, numbers, "_layout").select("bus_id", "id", "extended", "idx", "timestamp_ns", F.inline(by_number("_layout", arrays, none)))
    return found.filter("value is not null").withColumn("t", F.col("timestamp_ns") / F.lit(1e9))


def trace_rows(decoded: DataFrame) -> DataFrame:
    """Presentation columns of decoded frames: seconds, hexadecimal id and bytes, source name."""
    digits = F.when(F.col("extended"), F.lpad(F.hex("id"), 8, "0")).otherwise(F.lpad(F.hex("id"), 3, "0"))
    return decoded.withColumns(
        {
            "seconds": F.col("timestamp_ns") / F.lit(1e9),
            "id_hex": F.concat(F.lit("0x"), digits),
            "bytes": F.trim(F.regexp_replace(F.hex("data"), "(..)", "$1 ")),
        }
    )
