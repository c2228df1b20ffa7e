"""Counter and checksum verification of received frames.

Per (bus, id, extended) stream, a counter must step from the last seen value by its increment modulo rollover + 1; the
first sighting seeds it, a skip seeds it anew, and a payload too short for it does not touch it. The counter finding is
named before the checksum's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crc import crc_column, lookup
from ..model import STREAM_KEY, last_before
from ..plans.catalog import Catalog
from ..sources.dbc import CounterConfig, CrcConfig, Message
from .decode import by_number, keyed, raw_value


class ConfigError(ValueError):
    """A calculated field that does not fit its message."""


def resolve(message: Message, counter: CounterConfig | None, crc: CrcConfig | None) -> None:
    """Raise ConfigError if the configuration cannot work on the message."""
    for config in (counter, crc):
        if config is not None and message.signal(config.signal) is None:
            raise ConfigError(f"{message.name} has no signal {config.signal}")
    if counter is not None:
        top = (1 << message.signal(counter.signal).size) - 1
        if counter.increment < 1:
            raise ConfigError("the increment is zero")
        if counter.rollover is not None and not 1 <= counter.rollover <= top:
            raise ConfigError(f"rollover {counter.rollover} outside 1..{top}")
    if crc is not None:
        from ..functions.bits import positions

        signal = message.signal(crc.signal)
        try:
            width = lookup(crc.algorithm).width
        except KeyError as e:
            raise ConfigError(str(e)) from e
        if width > signal.size:
            raise ConfigError("the checksum is wider than its signal")
        if crc.first_bit % 8 or crc.bits % 8 or not crc.bits:
            raise ConfigError("the range is not in whole bytes")
        if crc.first_bit + crc.bits > 8 * message.length:
            raise ConfigError("the range leaves the payload")
        if {b // 8 for b in positions(signal.start, signal.size, signal.little)} & set(range(crc.first_bit // 8, (crc.first_bit + crc.bits) // 8)):
            raise ConfigError("the range covers the checksum itself")


def configured(catalog: Catalog) -> list[tuple[str, Message]]:
    """(bus, message) of the streams to verify: the first database per key decides."""
    out = []
    for bus, m, _ in catalog.winners():
        if m.counter or m.crc:
            resolve(m, m.counter, m.crc)
            out.append((bus, m))
    return out


def rollover(message: Message) -> int:
    top = (1 << message.signal(message.counter.signal).size) - 1
    return message.counter.rollover if message.counter.rollover is not None else top


def _fields(frames: DataFrame, streams: list[tuple[str, Message]]) -> DataFrame:
    """frames of the streams with _counter, _step, _modulo, _sent_crc, _own_crc, _has_counter and _has_crc: one
    expression per distinct configuration, chosen by a broadcast join."""
    layouts: dict[tuple, tuple[int, Message]] = {}
    keys = {}
    for bus, m in streams:
        layout = (m.counter, m.crc, *(m.signal(c.signal) for c in (m.counter, m.crc) if c))
        keys[bus, m.id, m.extended] = layouts.setdefault(layout, (len(layouts), m))[0]
    none = F.lit(None).cast("long")
    columns: dict[str, list[Column]] = {k: [] for k in ("_counter", "_step", "_modulo", "_sent_crc", "_own_crc")}
    for number, m in layouts.values():
        c, x = m.counter, m.crc
        columns["_counter"].append(raw_value(m.signal(c.signal)) if c else none)
        columns["_step"].append(F.lit(c.increment).cast("long") if c else none)
        columns["_modulo"].append(F.lit(rollover(m) + 1).cast("long") if c else none)
        columns["_sent_crc"].append(raw_value(m.signal(x.signal)) if x else none)
        payload = F.when(F.col("_config") == number, F.col("data"))
        columns["_own_crc"].append(crc_column(payload, x.algorithm, x.first_bit // 8, (x.first_bit + x.bits) // 8, x.prefix) if x else none)
    counters = [n for n, m in layouts.values() if m.counter]
    sums = [n for n, m in layouts.values() if m.crc]
    out = keyed(frames, keys, "_config").withColumns({k: by_number("_config", v, none) for k, v in columns.items()})
    return out.withColumns({"_has_counter": F.col("_config").isin(counters), "_has_crc": F.col("_config").isin(sums)})


def _crc_finding() -> Column:
    return F.when(F.col("_has_crc"), F.when(F.col("_sent_crc").isNull() | F.col("_own_crc").isNull(), "truncated").when(F.col("_sent_crc") != F.col("_own_crc"), "crc_mismatch"))


def checksum_findings(frames: DataFrame, catalog: Catalog) -> DataFrame:
    """(idx, bus_id, id, extended, finding) of Rx data frames whose checksum is wrong or cut off. Each frame is judged by
    itself, so frames may be a stream."""
    streams = [(bus, m) for bus, m in configured(catalog) if m.crc]
    wanted = (F.col("direction") == "Rx") & F.col("kind").isin("classic", "fd")
    rows = _fields(frames.filter(wanted), streams) if streams else frames.limit(0).withColumns({"_has_crc": F.lit(False), "_sent_crc": F.lit(None).cast("long"), "_own_crc": F.lit(None).cast("long")})
    return rows.withColumn("finding", _crc_finding()).filter("finding is not null").select("idx", *STREAM_KEY, "finding")


def verify_frames(frames: DataFrame, catalog: Catalog) -> DataFrame:
    """Configured Rx data frames with finding (null if valid): counter_skip, truncated or crc_mismatch."""
    streams = configured(catalog)
    wanted = F.col("direction").isin("Rx") & F.col("kind").isin("classic", "fd")
    ids = sorted({m.id for _, m in streams})
    rows = _fields(frames.filter(wanted & F.col("id").isin(ids)), streams)
    rows = last_before(rows, F.col("_counter"), "_before", STREAM_KEY, ("idx",))
    counter = F.when(
        F.col("_has_counter"),
        F.when(F.col("_counter").isNull(), "truncated").when(F.col("_before").isNotNull() & (F.pmod(F.col("_before") + F.col("_step"), F.col("_modulo")) != F.col("_counter")), "counter_skip"),
    )
    crc = _crc_finding()
    out = rows.withColumn("finding", F.coalesce(counter, crc)).withColumn("expected", F.pmod(F.col("_before") + F.col("_step"), F.col("_modulo")))
    return out.select(*frames.columns, "finding", F.when(F.col("finding") == "counter_skip", F.col("expected")).alias("expected_counter"))


def violations(frames: DataFrame, catalog: Catalog, start: int = 0, end: int | None = None) -> DataFrame:
    """(idx, finding) of failing frames in [start, end). The whole history is verified, as counters depend on it."""
    out = verify_frames(frames, catalog).filter("finding is not null").filter(F.col("idx") >= start)
    out = out if end is None else out.filter(F.col("idx") < end)
    return out.select("idx", *STREAM_KEY, "finding").orderBy("idx")


def validity(frames: DataFrame, catalog: Catalog) -> DataFrame:
    """The last verdict of each stream that ever failed."""
    found = verify_frames(frames, catalog)
    g = found.groupBy(*STREAM_KEY).agg(F.bool_or(F.col("finding").isNotNull()).alias("_ever"), F.max_by(F.col("finding").isNull(), "idx").alias("valid"), F.max_by("finding", "idx").alias("finding"))
    return g.filter("_ever").drop("_ever")


def with_violations(page: DataFrame, frames: DataFrame, catalog: Catalog) -> DataFrame:
    """A page of rows with the finding of each."""
    return page.join(violations(frames, catalog).select("idx", "finding"), "idx", "left")
