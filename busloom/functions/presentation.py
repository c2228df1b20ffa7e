"""Presentation columns: ids, bytes, elapsed times, axes, lanes, colours, log lines."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_text(can_id: Column, extended: Column) -> Column:
    return F.concat(F.lit("0x"), F.when(extended, F.lpad(F.hex(can_id), 8, "0")).otherwise(F.lpad(F.hex(can_id), 3, "0")))


def bytes_text(data: Column) -> Column:
    return F.trim(F.regexp_replace(F.hex(data), "(..)", "$1 "))


def elapsed_text(ns: Column) -> Column:
    """[d:][hh:][mm:]ss.ffff: the leading part unpadded, lower ones with two digits. Works on whole tenths of a ms, so
    rounding carries into the parts."""
    ticks = F.round(F.abs(ns) / 100_000).cast("long")
    part = lambda unit, size: F.floor(ticks / unit) % size if size else F.floor(ticks / unit)
    d, h, m, s = part(864_000_000, 0), part(36_000_000, 24), part(600_000, 60), part(10_000, 60)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    body = (
        F.when(d > 0, F.concat_ws(":", d.cast("string"), two(h), two(m), two(s)))
        .when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s)))
        .when(m > 0, F.concat_ws(":", m.cast("string"), two(s)))
        .otherwise(s.cast("string"))
    )
    return F.concat(F.when(ns < 0, "-").otherwise(""), body, F.lit("."), F.lpad((ticks % 10_000).cast("string"), 4, "0"))


def note_seconds(timestamp_ns: Column, window_start_ns: int | None) -> Column:
    return F.lit(None).cast("double") if window_start_ns is None else (timestamp_ns - window_start_ns) / F.lit(1e9)


def on_axis(value: Column, low: float, high: float, log: bool = False) -> Column:
    """Position of a value on an axis from 0 to 1; null for values a logarithmic axis can't show; the middle of an empty axis."""
    if log:
        if low <= 0:
            return F.lit(None).cast("double")
        span = math.log10(high) - math.log10(low)
        return F.when(value > 0, F.lit(0.5) if span <= 0 else (F.log10(value) - math.log10(low)) / span)
    return F.lit(0.5) if high <= low else (value - low) / (high - low)


def off_axis(position: Column, low: float, high: float, log: bool = False) -> Column:
    if log:
        start = math.log10(low)
        return F.pow(F.lit(10.0), F.lit(start) + position * (math.log10(high) - start))
    return F.lit(low) + position * (high - low)


def axis_range(auto: tuple[float, float] | None, low: float | None = None, high: float | None = None, log: bool = False, least_positive: float | None = None) -> tuple[float, float] | None:
    """An axis's bounds: settings before the data's own; logarithmic bounds at decades; constants widened by a tenth, or 1."""
    top = high if high is not None else auto[1] if auto else None
    if log:
        floor = least_positive if least_positive and least_positive > 0 else auto[0] if auto and auto[0] > 0 else None
        if top is None or top <= 0 or floor is None:
            return None
        first = 10.0 ** math.floor(math.log10(floor) + 1e-12)
        last = top if high is not None else 10.0 ** math.ceil(math.log10(top) - 1e-12)
        return first, last if last > first else first * 10
    bottom = low if low is not None else auto[0] if auto else None
    if bottom is None or top is None:
        return None
    if top > bottom:
        return bottom, top
    anchor = low if low is not None else high if high is not None else bottom
    pad = abs(anchor) * 0.1 or 1.0
    return anchor - pad, anchor + pad


def decade_ticks(low: float, high: float, most: int = 10) -> list[float]:
    """The decades within a logarithmic axis, thinned to at most `most`."""
    first, last = math.ceil(math.log10(low) - 1e-9), math.floor(math.log10(high) + 1e-9)
    return [10.0**e for e in range(first, last + 1, max(1, math.ceil((last - first + 1) / most)))]


def in_lane(value: Column, low: float, high: float, band_low: float, band_high: float) -> Column:
    share = F.lit(0.5) if high == low else F.greatest(F.least((value - low) / (high - low), F.lit(1.0)), F.lit(0.0))
    return F.lit(band_low) + share * (band_high - band_low)


def value_colors(values: DataFrame, rules: DataFrame) -> DataFrame:
    """values (row, bus_id, id, extended, signal, value) with the colour of the first map (map_order, bus_id or null, ...)
    that has a rule whose inclusive range holds the value, of its rules the first."""
    r = F.broadcast(rules.withColumnRenamed("bus_id", "_rule_bus"))
    met = values.join(r, ["id", "extended", "signal"]).filter((F.col("_rule_bus").isNull() | (F.col("_rule_bus") == F.col("bus_id"))) & F.col("value").between(F.col("min"), F.col("max")))
    best = met.groupBy("row").agg(F.min_by("color", F.struct("map_order", "rule_order")).alias("color"))
    return values.join(best, "row", "left")


def seeded_rules(table: DataFrame, palette: list[str]) -> DataFrame:
    """A colour rule per value table row (raw, label), the palette by position."""
    position = F.row_number().over(Window.orderBy("raw")) - 1
    colors = F.array(*[F.lit(c) for c in palette])
    return table.withColumn("rule_order", position).select(F.col("raw").cast("double").alias("min"), F.col("raw").cast("double").alias("max"), F.get(colors, (F.col("rule_order") % len(palette)).cast("int")).alias("color"), "rule_order")


def stable_hash(key: str) -> int:
    """FNV-1a 32 over the UTF-16 code units of a catalogue key."""
    h = 0x811C9DC5
    data = key.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
    return h


def generated_id(patterns: list[str], name: str) -> int | None:
    """The first pattern whose first group is a 32-bit number in the name; bad, long or groupless patterns are skipped."""
    for p in patterns:
        try:
            test = re.compile(p) if len(p) <= 512 else None
        except re.error:
            continue
        if test and test.groups and (m := test.search(name)) and (m[1] or "").isascii() and (m[1] or "").isdigit() and int(m[1]) < 1 << 32:
            return int(m[1])
    return None


def log_filter(messages: DataFrame, least_level: str, sources: list[str] | None = None) -> DataFrame:
    ranks = {"debug": 0, "info": 1, "warning": 2, "error": 3}
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.lower("level")), F.lit(0))
    out = messages.filter(rank >= ranks[least_level])
    return out if sources is None else out.filter(F.col("source").isin(sources))


def log_line() -> Column:
    return F.concat_ws(" ", F.date_format(F.timestamp_micros(F.floor(F.col("t") / 1000)), "yyyy-MM-dd HH:mm:ss.SSS"), F.upper("level"), F.col("source"), F.col("message"))


def solo_groups(paths: DataFrame, pattern: str) -> DataFrame:
    """Series paths grouped by the pattern's captures (the whole match without any)."""
    n = re.compile(pattern).groups
    keys = [F.regexp_extract("path", pattern, i).alias(f"g{i}") for i in (range(1, n + 1) if n else [0])]
    found = paths.filter(F.col("path").rlike(pattern)).select("path", *keys)
    names = [c for c in found.columns if c != "path"]
    return found.groupBy(*names).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def follow_window(edge_s: float, width_s: float, start_s: float = 0.0) -> tuple[float, float]:
    """The trailing window of a width, pinned at the trace's start."""
    first = max(start_s, edge_s - width_s)
    return first, first + width_s


def centered_window(at_s: float, width_s: float) -> tuple[float, float]:
    first = max(0.0, at_s - width_s / 2)
    return first, first + width_s


#: seconds of 2000-01-01: an origin before it names no instant
WALL_CLOCK_FLOOR = 946_684_800


def has_wall_clock(origin_seconds: Column) -> Column:
    """Whether an origin is an instant of the calendar rather than the start of a relative timeline."""
    return F.coalesce(origin_seconds >= WALL_CLOCK_FLOOR, F.lit(False))


def rate_text(rate: Column) -> Column:
    """Messages a second: blank for none, one decimal below 100, whole numbers above."""
    return F.when(rate <= 0, "").when(rate < 100, F.format_string("%.1f", rate)).otherwise(F.floor(rate + 0.5).cast("string"))


def float_text(value: Column, figures: int = 6, below: float = 1e-4, above: float = 1e6, decimals: int = 5) -> Column:
    """A number with `figures` significant figures and no trailing zeros; exponential outside [below, above)."""
    size = F.abs(value)
    rounded = F.format_string(f"%.{figures - 1}e", value).cast("double").cast("decimal(38,14)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(rounded, "0+$", ""), r"\.$", "")
    scientific = F.regexp_replace(F.format_string(f"%.{decimals}e", value), "e([+-])0([0-9])$", "e$1$2")
    odd = value.isNull() | F.isnan(value) | (size == float("inf"))
    return F.when(odd, "\u2014").when(value == 0, "0").when((size < below) | (size >= above), scientific).otherwise(plain)


def signal_color(pick: Column, generated: Column, stable: Column) -> Column:
    """A signal's colour: the user's pick, else a generator's, else the stable one of its identity."""
    return F.coalesce(F.when(pick != "", pick), generated, stable)
