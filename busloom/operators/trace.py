"""Trace queries: pages, latest per key, time to row, sorts, sections and rates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import FRAME_KEY, STREAM_KEY, held, ranges, small
from ..plans.catalog import Catalog
from ..plans.predicate import compiled, filter_frames, to_column
from ..sources.dbc import Message
from .decode import by_number, decode_frames, keyed, mux_selector

SECOND_NS = 1_000_000_000


def rows_between(frames: DataFrame, start: int, end: int) -> DataFrame:
    """Rows with start <= idx < end (statistics of idx prune the scan)."""
    return frames.filter((F.col("idx") >= max(0, start)) & (F.col("idx") < end))


def time_window(frames: DataFrame, start_ns: int | None, end_ns: int | None, prefix_stop: bool = False) -> DataFrame:
    """Frames within [start, end]. prefix_stop also drops what follows the first frame past the end, in row order."""
    out = frames
    if prefix_stop and end_ns is not None:
        first_past = frames.filter(F.col("timestamp_ns") > end_ns).agg(F.min("idx").alias("_stop"))
        out = out.join(F.broadcast(first_past), F.col("_stop").isNull() | (F.col("idx") < F.col("_stop"))).drop("_stop")
    if start_ns is not None:
        out = out.filter(F.col("timestamp_ns") >= start_ns)
    return out if end_ns is None else out.filter(F.col("timestamp_ns") <= end_ns)


def trace_page(frames: DataFrame, catalog: Catalog, start: int, end: int, predicate: object | None = None) -> DataFrame:
    """The decoded rows of an index range, optionally those that pass a predicate."""
    page = rows_between(frames, start, end)
    out = decode_frames(page, catalog)
    return (out if predicate is None else out.filter(to_column(predicate))).orderBy("idx")


def page_bounds(count: int, offset: int, limit: int, from_end: bool = False) -> tuple[int, int]:
    """[start, end) of a page of `count` rows; from_end takes the last rows."""
    if from_end:
        return max(0, count - limit), count
    start = min(max(0, offset), count)
    return start, min(count, start + limit)


def filtered_page(frames: DataFrame, predicate: object, catalog: Catalog, offset: int, limit: int, from_end: bool = False) -> tuple[DataFrame, int, int]:
    """(page, exact count of matches, first match's position). Only the page is decoded."""
    matches = filter_frames(frames, predicate, catalog)
    count = matches.count()
    start, end = page_bounds(count, offset, limit, from_end)
    if from_end:
        page = matches.orderBy(F.desc("idx")).limit(end - start)
    else:
        page = matches.orderBy("idx").offset(start).limit(end - start)
    return decode_frames(page, catalog).orderBy("idx"), count, start


def live_tail(frames: DataFrame, rows: int) -> DataFrame:
    return frames.orderBy(F.desc("idx")).limit(rows).orderBy("idx")


def rows_at(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the given (pos, idx) in the order of pos; unknown indices are skipped."""
    return wanted.join(frames, "idx").orderBy("pos")


def distinct_keys(frames: DataFrame) -> DataFrame:
    return frames.select(*STREAM_KEY).distinct().orderBy(*STREAM_KEY)


def key_rates(frames: DataFrame, *key: str) -> DataFrame:
    """Per key: count, last idx and rate in event time.

    The rate is (n - 1) / span over the frames of the last second before the key's last frame; with one frame there,
    one over the last distinct step; 0 below two distinct timestamps. Two partial aggregates: the keys' last times are a
    small table, against which all frames are counted where they are; no frame is shuffled.
    """
    last = small(frames.groupBy(*key).agg(F.max("timestamp_ns").alias("_last")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_last"))
    rows = frames.join(last, [frames[k].eqNullSafe(last[f"_k{i}"]) for i, k in enumerate(key)])
    recent = F.col("timestamp_ns") > F.col("_last") - SECOND_NS
    before = F.when(F.col("timestamp_ns") < F.col("_last"), F.col("timestamp_ns"))
    g = rows.groupBy(*key).agg(
        F.count("*").alias("count"),
        F.max("idx").alias("last_idx"),
        F.max("timestamp_ns").alias("_max"),
        F.count_if(recent).alias("_n"),
        F.min(F.when(recent, F.col("timestamp_ns"))).alias("_first"),
        F.max(before).alias("_before"),
    )
    span = (F.col("_max") - F.col("_first")) / F.lit(1e9)
    step = (F.col("_max") - F.col("_before")) / F.lit(1e9)
    rate = F.when(span > 0, (F.col("_n") - 1) / span).when(step > 0, 1 / step).otherwise(F.lit(0.0))
    return g.select(*key, "count", "last_idx", rate.alias("rate"))


def latest_by_key(frames: DataFrame, start: int = 0, end: int | None = None, *key: str) -> DataFrame:
    """Per key its last frame in [start, end), with count and rate of the whole session."""
    key = key or FRAME_KEY
    inside = frames if end is None and start <= 0 else rows_between(frames, start, end if end is not None else (1 << 62))
    rest = [c for c in frames.columns if c not in key]
    latest = inside.groupBy(*key).agg(F.max_by(F.struct(*rest), "idx").alias("_row")).select(*key, "_row.*")
    stats = key_rates(frames, *key).drop("last_idx")
    on = [latest[k].eqNullSafe(stats[k]) for k in key]
    return latest.join(stats, on).select(*[latest[c] for c in latest.columns], "count", "rate")


def with_selector(frames: DataFrame, catalog: Catalog) -> DataFrame:
    """The multiplexed frames with their selector's value; others go."""
    layouts: dict[object, tuple[int, Message]] = {}
    keys = {(bus, m.id, m.extended): layouts.setdefault(m.multiplexor, (len(layouts), m))[0] for bus, m, _ in catalog.winners() if m.multiplexor is not None}
    selectors = [mux_selector(m) for _, m in layouts.values()]
    chosen = keyed(frames, keys, "_layout").withColumn("selector", by_number("_layout", selectors, F.lit(None).cast("long")))
    return chosen.drop("_layout").filter("selector is not null")


def latest_per_mux(frames: DataFrame, catalog: Catalog, start: int = 0, end: int | None = None) -> DataFrame:
    """Per (bus, id, extended, selector) its last frame in the range, count and rate; the whole history counts."""
    return latest_by_key(with_selector(frames, catalog), start, end, *STREAM_KEY, "selector")


#: sort columns of the by-id view; texts before their decoding default
_BY_ID = {
    "rate": F.col, "idx": F.col, "time": lambda _: F.col("timestamp_ns"), "dir": lambda _: F.col("direction"), "id": F.col,
    "kind": F.col, "len": lambda _: F.length(F.coalesce("data", F.lit(b""))), "data": lambda _: F.coalesce(F.col("data"), F.lit(b"")),
    "msg": lambda _: F.coalesce(F.col("message"), F.lit("")), "ecu": lambda _: F.when(F.coalesce(F.col("ecu"), F.lit("")) == "", F.lit("~")).otherwise(F.col("ecu")),
}


def by_id_order(key: str | None, descending: bool = False, bus_names: dict[str, str] | None = None) -> list[Column]:
    """Sort keys of the by-id view: ties keep bus, channel, id order in both directions; unknown keys do not sort."""
    tie = [F.col(c).asc_nulls_first() for c in FRAME_KEY]
    if key == "bus":
        names = bus_names or {}
        by = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("bus_id")), F.col("bus_id"), F.lit("")) if names else F.coalesce(F.col("bus_id"), F.lit(""))
    elif key in _BY_ID:
        by = _BY_ID[key](key)
    else:
        return tie
    return [by.desc() if descending else by.asc(), *tie]


def by_id_page(frames: DataFrame, catalog: Catalog, start: int = 0, end: int | None = None, predicate: object | None = None, sort_key: str | None = None, descending: bool = False, offset: int = 0, limit: int = 100, bus_names: dict[str, str] | None = None) -> tuple[DataFrame, int]:
    """(page of latest frames per key, number of rows). The predicate tests only each key's latest frame."""
    rows = decode_frames(latest_by_key(frames, start, end), catalog)
    if predicate is not None:
        rows = rows.filter(to_column(predicate))
    rows = held(rows)  # one row a key
    count = rows.count()
    first, last = page_bounds(count, offset, limit)
    return rows.orderBy(*by_id_order(sort_key, descending, bus_names)).offset(first).limit(last - first), count


def index_at(frames: DataFrame, times: DataFrame) -> DataFrame:
    """For rows (event, ns): the first idx with timestamp_ns >= ns, else the number of rows.

    Frames and events are sorted together by time in ranges; within a range the least idx from a time on is a running
    minimum from the newest row down, and past the range's end it comes from the later ranges' minima (one row a range),
    so no task sees all rows and each reads its range once.
    """
    both = frames.select(F.col("timestamp_ns").alias("ns"), "idx", F.lit(None).cast("string").alias("event")).unionByName(
        times.select("ns", F.lit(None).cast("long").alias("idx"), F.col("event").cast("string").alias("event"))
    )
    dealt = ranges(both, "ns")
    low = dealt.groupBy("_part").agg(F.min("idx").alias("_low"))
    after = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    later = low.withColumn("_later", F.min("_low").over(after)).drop("_low")
    # equal times are peers of the running range, so a frame at the event's own time counts
    inside = Window.partitionBy("_part").orderBy(F.desc("ns")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumn("_next", F.min("idx").over(inside)).filter("event is not null").join(F.broadcast(later), "_part")
    total = frames.agg(F.count("*").alias("_total"))
    return found.crossJoin(F.broadcast(total)).select("event", "ns", F.coalesce(F.least("_next", "_later"), F.col("_next"), F.col("_later"), F.col("_total")).alias("idx"))


def filtered_position_at(frames: DataFrame, matches: DataFrame, times: DataFrame, window_base: int = 0) -> DataFrame:
    """For rows (event, ns): matches whose idx lies before the event's row, less the window base (may be negative).

    Matches and events are dealt together by ranges of idx; matches of earlier ranges come from one count per range.
    """
    at = index_at(frames, times)
    both = matches.select("idx", F.lit(1).alias("_match"), F.lit(None).cast("string").alias("event"), F.lit(None).cast("long").alias("ns")).unionByName(
        at.select("idx", F.lit(0).alias("_match"), "event", "ns")
    )
    dealt = ranges(both, "idx")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.sum("_match").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_part").orderBy("idx", "_match").rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt.withColumn("_before", F.sum("_match").over(inside)).filter("event is not null").join(F.broadcast(offsets), "_part")
    return counted.select("event", "ns", (F.col("_before") + F.col("_offset") - window_base).alias("position"))


def status(frames: DataFrame) -> DataFrame:
    """One row: rows, first and last rows' times, running maximum, seconds held (last row less first, not max less min)."""
    g = frames.agg(
        F.count("*").alias("rows"),
        F.min("idx").alias("low_water"),
        F.min_by("timestamp_ns", "idx").alias("first_ns"),
        F.max_by("timestamp_ns", "idx").alias("last_ns"),
        F.max("timestamp_ns").alias("live_edge_ns"),
    )
    return g.withColumn("buffer_seconds", F.greatest(F.col("last_ns") - F.col("first_ns"), F.lit(0)) / F.lit(1e9))


def fps(frames: DataFrame, *by: str) -> DataFrame:
    """Frames in the last second before the newest frame, per group (all of them without one)."""
    edge = frames.agg(F.max("timestamp_ns").alias("_edge"))
    recent = frames.join(F.broadcast(edge), F.col("timestamp_ns") > F.col("_edge") - SECOND_NS)
    return recent.groupBy(*by).agg(F.count("*").alias("fps"))


def fps_by_second(frames: DataFrame, *by: str) -> DataFrame:
    return frames.groupBy(*by, F.floor(F.col("timestamp_ns") / SECOND_NS).alias("second")).agg(F.count("*").alias("fps"))


def census(frames: DataFrame) -> DataFrame:
    """One row over raw columns only: channels, frames, first and last time."""
    return frames.agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.count("*").alias("frames"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))


def interleave_events(frames: DataFrame, events: DataFrame, rows: int) -> DataFrame:
    """Rows (anchor, is_frame, rank, idx, event): each event stands before the frame at its anchor; anchors outside
    [0, rows] go."""
    f = frames.select(F.col("idx").alias("anchor"), F.lit(1).alias("is_frame"), F.lit(0).cast("long").alias("rank"), "idx", F.lit(None).cast("string").alias("event"))
    e = events.filter(F.col("anchor").between(0, rows)).select("anchor", F.lit(0).alias("is_frame"), F.col("rank").cast("long").alias("rank"), F.lit(None).cast("long").alias("idx"), F.col("event").cast("string").alias("event"))
    return f.unionByName(e).orderBy("anchor", "is_frame", "rank")


def signal_snapshot(frames: DataFrame, catalog: Catalog, selected: DataFrame) -> DataFrame:
    """selected (bus_id, id, extended, signal, ...) with the latest value of each: blank rows stay.

    The newest frame of a stream counts whatever its channel; a multiplexed signal takes the newest frame of its own
    selector group, so it does not blank when another group is sent.
    """
    plain = decode_frames(latest_by_key(frames, 0, None, *STREAM_KEY), catalog)
    muxed = decode_frames(latest_per_mux(frames, catalog), catalog)
    cols = [*STREAM_KEY, "idx", "timestamp_ns", "count", "rate", "signals"]
    rows = plain.select(*cols).unionByName(muxed.select(*cols))
    values = rows.select(*STREAM_KEY, "idx", "timestamp_ns", "count", "rate", F.inline("signals"))
    values = values.groupBy(*STREAM_KEY, F.col("name").alias("signal")).agg(F.max_by(F.struct("idx", "timestamp_ns", "count", "rate", "value", "raw_signed", "label"), "idx").alias("v"))
    return selected.join(values, [*STREAM_KEY, "signal"], "left").select(*selected.columns, "v.*")


def signal_order(key: str | None, descending: bool = False) -> list[Column]:
    """Blanks last in both directions, ties by ordinal; enumerations compare by raw value, others by value."""
    ordinal = F.col("ordinal").asc()
    if key is None:
        return [ordinal]
    by = F.when(F.col("is_enum"), F.col("raw_signed").cast("double")).otherwise(F.col("value")) if key == "value" else F.col(key)
    return [by.desc_nulls_last() if descending else by.asc_nulls_last(), ordinal]


@dataclass
class Sections:
    names: list[str] = field(default_factory=list)
    #: signal identity to section
    assignments: dict[str, str] = field(default_factory=dict)
    patterns: dict[str, list[str]] = field(default_factory=dict)
    folded: set[str] = field(default_factory=set)


def arrange_sections(rows: DataFrame, sections: Sections, order: list[Column] | None = None) -> DataFrame:
    """rows (identity, path, ordinal, ...) under their sections, with header rows (is_header, section, section_count).

    An assignment to a live section wins, else the first section in creation order one of whose patterns matches the
    path (bad patterns never match), else the unnamed section, which is headed only beside others and if it has rows.
    Folded sections keep header and count.
    """
    names = list(dict.fromkeys(n for n in sections.names if n))
    slot = None
    for i, n in enumerate(names, 1):
        mine = sorted(k for k, v in sections.assignments.items() if v == n)
        if mine:
            slot = F.when(F.col("identity").isin(mine), i) if slot is None else slot.when(F.col("identity").isin(mine), i)
    for i, n in enumerate(names, 1):
        for p in sections.patterns.get(n, []):
            if compiled(p):
                slot = F.when(F.col("path").rlike(p), i) if slot is None else slot.when(F.col("path").rlike(p), i)
    placed = rows.withColumn("slot", F.lit(0) if slot is None else slot.otherwise(0))
    names_column = F.array(*[F.lit(n) for n in ["", *names]])
    counts = placed.groupBy("slot").agg(F.count("*").alias("section_count"))
    every = rows.sparkSession.createDataFrame([(i, n, n in sections.folded) for i, n in enumerate(["", *names])], "slot int, section string, folded boolean")
    headers = every.join(counts, "slot", "left").withColumn("section_count", F.coalesce("section_count", F.lit(0)))
    headers = headers.filter((F.col("slot") > 0) | (F.lit(bool(names)) & (F.col("section_count") > 0)))
    shown = placed.join(F.broadcast(headers.filter("folded").select("slot")), "slot", "left_anti").withColumn("section", F.get(names_column, F.col("slot")))
    rank = Window.partitionBy("slot").orderBy(*(order or [F.col("ordinal").asc()]))
    body = shown.withColumn("is_header", F.lit(False)).withColumn("rank", F.row_number().over(rank))
    top = headers.select("slot", "section", "section_count", F.lit(True).alias("is_header"), F.lit(0).alias("rank"))
    return top.unionByName(body, allowMissingColumns=True).orderBy("slot", "rank")


def fuzzy_regex(text: str) -> str:
    """A pattern that finds the characters of text in order, for narrowing catalogues."""
    return "(?i)" + ".*?".join(map(re.escape, text))
