"""Structured Streaming forms: ingest, latest per key, rates, verification, clock slew, log rate limits."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..model import STREAM_KEY, guard, route
from ..operators.decode import raw_value
from ..operators.trace import SECOND_NS, with_selector
from ..operators.verify import checksum_findings, configured, rollover
from ..plans.catalog import Catalog


def event_time(frames: DataFrame) -> DataFrame:
    """frames with a timestamp column `ts` (microseconds) for watermarks."""
    return frames.withColumn("ts", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000)))


def ingest(stream: DataFrame, mapping: DataFrame, session_start_ns: int | None, path: str, checkpoint: str):
    """Route, guard and append a stream of frames to Parquet. Late frames are kept in arrival order: no watermark drops."""
    out = guard(route(stream, mapping), session_start_ns)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def latest(stream: DataFrame, *key: str) -> DataFrame:
    """Update-mode state: per key the last idx, its frame and the count so far."""
    rest = [c for c in stream.columns if c not in key]
    return stream.groupBy(*key).agg(F.max_by(F.struct(*rest), "idx").alias("frame"), F.count("*").alias("count"))


def fps(stream: DataFrame, *by: str, late: str = "5 seconds") -> DataFrame:
    """Frames per second and group, by event time."""
    return event_time(stream).withWatermark("ts", late).groupBy(F.window("ts", "1 second"), *by).agg(F.count("*").alias("fps"))


def latest_per_mux(stream: DataFrame, catalog: Catalog) -> DataFrame:
    """Update-mode state: per (bus, id, extended, selector) the last idx, its frame and the count so far."""
    return latest(with_selector(stream, catalog), *STREAM_KEY, "selector")


def rates(stream: DataFrame, *key: str, window: str = "1 second", late: str = "5 seconds") -> DataFrame:
    """Per key and window of event time: frames, their first and last time and the rate between them (0 for one frame)."""
    timed = event_time(stream).withWatermark("ts", late)
    g = timed.groupBy(F.window("ts", window), *key).agg(F.count("*").alias("count"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))
    span = (F.col("last_ns") - F.col("first_ns")) / F.lit(1e9)
    return g.withColumn("rate", F.when(span > 0, (F.col("count") - 1) / span).otherwise(F.lit(0.0)))


def _trail(times: np.ndarray, before: int | None) -> tuple[list[int], int | None]:
    """Of a key's times: those of its last second, and the greatest below the last one (`before` is one more of them)."""
    last = times.max()
    lower = times[times < last]
    known = [int(lower.max())] if len(lower) else []
    known += [] if before is None or before >= last else [before]
    return np.sort(times[times > last - SECOND_NS]).tolist(), max(known, default=None)


def key_rates(stream: DataFrame, *key: str) -> DataFrame:
    """Update-mode state: per key of the frames so far count, last idx and rate, as `trace.key_rates` gives them for a batch.

    Frames are reduced to a row a key, batch of rows and task before the shuffle, so a busy key sends a few rows and not its
    frames. A key's state is its counters and the times of its last second. Order of arrival does not matter. Frames without
    a time are left out."""
    kinds = [stream.schema[k] for k in key]

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, part in pdf.groupby(list(key), dropna=False, sort=False):
                times, before = _trail(part["timestamp_ns"].to_numpy(), None)
                out.append((*(None if pd.isna(k) else k for k in own), len(part), int(part["idx"].max()), times, before))
            yield pd.DataFrame(out, columns=[*key, "count", "last_idx", "times", "before"], dtype=object)

    counters = [T.StructField("count", T.LongType()), T.StructField("last_idx", T.LongType())]
    held = [*counters, T.StructField("times", T.ArrayType(T.LongType())), T.StructField("before", T.LongType())]
    parts = stream.filter("timestamp_ns is not null").select(*key, "idx", "timestamp_ns").mapInPandas(reduced, T.StructType([*kinds, *held]))

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last_idx, times, before = state.get if state.exists else (0, -1, [], None)
        for pdf in batches:
            count, last_idx = count + int(pdf["count"].sum()), max(last_idx, int(pdf["last_idx"].max()))
            below = [int(b) for b in pdf["before"].dropna()] + ([] if before is None else [before])
            every = np.concatenate([np.array(times, np.int64), *(np.asarray(t, np.int64) for t in pdf["times"])])
            times, before = _trail(every, max((b for b in below if b < every.max()), default=None))
        state.update((count, last_idx, times, before))
        span, step = (times[-1] - times[0]) / 1e9, 0.0 if before is None else (times[-1] - before) / 1e9
        rate = (len(times) - 1) / span if span > 0 else 1 / step if step > 0 else 0.0
        yield pd.DataFrame([(*own, count, last_idx, rate)], columns=[*key, "count", "last_idx", "rate"], dtype=object)

    out = T.StructType([*kinds, *counters, T.StructField("rate", T.DoubleType())])
    return parts.groupBy(*key).applyInPandasWithState(run, out, T.StructType(held), "update", GroupStateTimeout.NoTimeout)


def verify_checksums(stream: DataFrame, catalog: Catalog) -> DataFrame:
    """Checksum findings of a stream: no state, so late and repeated frames are judged alike."""
    return checksum_findings(stream, catalog)


def looped(frames: DataFrame, laps: int) -> DataFrame:
    """A capture played `laps` times over: lap n is shifted by n times (last - first time) and numbered on."""
    span = frames.agg((F.max("timestamp_ns") - F.min("timestamp_ns")).alias("_span"), (F.max("idx") + 1).alias("_rows"))
    every = frames.crossJoin(F.broadcast(span)).withColumn("_lap", F.explode(F.sequence(F.lit(0), F.lit(laps - 1))))  # one row
    moved = {"timestamp_ns": F.col("timestamp_ns") + F.col("_lap") * F.col("_span"), "idx": F.col("idx") + F.col("_lap") * F.col("_rows")}
    return every.withColumns(moved).select(*frames.columns)


_VERDICT = "idx long, bus_id string, id long, extended boolean, finding string"


def verify_counters(stream: DataFrame, catalog: Catalog) -> DataFrame:
    """Counter findings of a stream, one state (the last counter) per (bus, id, extended)."""
    raw, step, modulo = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for bus, m in configured(catalog):
        if m.counter:
            test = (F.col("bus_id") == bus) & (F.col("id") == m.id) & (F.col("extended") == m.extended)
            raw = F.when(test, raw_value(m.signal(m.counter.signal))).otherwise(raw)
            step = F.when(test, F.lit(m.counter.increment).cast("long")).otherwise(step)
            modulo = F.when(test, F.lit(rollover(m) + 1).cast("long")).otherwise(modulo)
    rows = stream.filter((F.col("direction") == "Rx") & F.col("kind").isin("classic", "fd"))
    rows = rows.select("idx", *STREAM_KEY, raw.alias("counter"), step.alias("step"), modulo.alias("modulo")).filter("step is not null")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        frames = pd.concat(list(batches)).sort_values("idx") if batches else pd.DataFrame()
        for r in frames.itertuples(index=False):
            if pd.isna(r.counter):
                out.append((r.idx, *key, "truncated"))
                continue
            if last is not None and (last + int(r.step)) % int(r.modulo) != int(r.counter):
                out.append((r.idx, *key, "counter_skip"))
            last = int(r.counter)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["idx", *STREAM_KEY, "finding"])

    return rows.groupBy(*STREAM_KEY).applyInPandasWithState(run, _VERDICT, "counter long", "append", GroupStateTimeout.NoTimeout)


def clock_samples(exchanges: DataFrame) -> DataFrame:
    """Offset and round-trip delay (never negative) of exchanges (n, t0, t1, t2, t3): sent, received there, answered, back."""
    t0, t1, t2, t3 = (F.col(f"t{i}") for i in range(4))
    return exchanges.withColumns({"offset": F.floor(((t1 - t0) + (t2 - t3)) / 2).cast("long"), "delay": F.greatest((t3 - t0) - (t2 - t1), F.lit(0))})


def best_clock_sample(samples: DataFrame, *key: str) -> DataFrame:
    """The sample with the least delay, the first of equals."""
    return samples.groupBy(*key).agg(F.min(F.struct("delay", "n", "offset")).alias("b")).select(*key, "b.*")


SLEW_NS_PER_S, STEP_NS = 5_000_000, 1_000_000_000


def slewed(target: int, current: int | None, elapsed_ns: int) -> int:
    """The next offset: at most SLEW_NS_PER_S of elapsed time towards the target, or a step if it is over STEP_NS away."""
    if current is None or abs(target - current) > STEP_NS:
        return target
    most = SLEW_NS_PER_S * max(0, elapsed_ns) // 1_000_000_000
    return current + max(-most, min(most, target - current))


def correct_clock(frames: DataFrame, *session: str) -> DataFrame:
    """Frames (session, idx, timestamp_ns, target_ns) with corrected_ns: the offset slews by frame time and corrected times
    never fall. Sequential per session; sorted partitions stream through it."""
    out_schema = T.StructType([*frames.schema.fields, T.StructField("corrected_ns", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: Any = None
        offset = last = before = None
        for pdf in batches:
            corrected = []
            for own, t, target in zip(pdf[list(session)].itertuples(index=False), pdf["timestamp_ns"], pdf["target_ns"], strict=True):
                if tuple(own) != key:
                    key, offset, last, before = tuple(own), None, None, None
                offset = slewed(int(target), offset, 0 if before is None else int(t) - before)
                before = int(t)
                last = before + offset if last is None else max(last, before + offset)
                corrected.append(last)
            yield pdf.assign(corrected_ns=corrected)

    return frames.repartition(*session).sortWithinPartitions(*session, "idx").mapInPandas(run, out_schema)


def clock_flips(status: DataFrame, warn_ns: int = 100_000_000) -> DataFrame:
    """Of rows (session, t, offset_ns): the first of each session and those where the warning state flips."""
    warned = F.abs("offset_ns") >= warn_ns
    w = Window.partitionBy("session").orderBy("t")
    return status.withColumn("warned", warned).withColumn("_b", F.lag("warned").over(w)).filter(F.col("_b").isNull() | (F.col("_b") != F.col("warned"))).drop("_b")


def rate_limited(messages: DataFrame, burst: int, window_ns: int = 1_000_000_000) -> DataFrame:
    """Log messages (source, template, t, ...) with `shown`: those with fewer than burst calls of the same source and
    template in the window before; suppressed calls count too, and the first suppressed of a spell is marked.

    Time is cut into stretches as long as the window, so a window ends in its message's stretch and starts in the one before.
    Each message is told in its own stretch and, bare, in the next, where it counts until its place in it is reached: running
    counts by (source, template, stretch), linear in the messages."""
    key, rest = ["source", "template"], [c for c in messages.columns if c not in ("source", "template")]
    # floor(t / window_ns) in whole numbers
    stretch = F.expr(f"t div {window_ns}L - if(t % {window_ns}L < 0, 1, 0)")
    place = F.pmod("t", F.lit(window_ns).cast("long"))
    whole = F.struct(*rest)
    bare = F.when(F.lit(False), whole)
    both = F.array(F.struct(F.lit(0).alias("_later"), whole.alias("_message")), F.struct(F.lit(1).alias("_later"), bare.alias("_message")))
    told = messages.select(*key, stretch.alias("_stretch"), place.alias("_place"), F.inline(both))
    told = told.filter("_later = 0 or _stretch is not null").withColumn("_stretch", F.col("_stretch") + F.col("_later"))
    here = Window.partitionBy(*key, "_stretch").orderBy("_place")
    passed = here.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    recent = F.sum("_later").over(every) + F.sum(F.lit(1) - 2 * F.col("_later")).over(passed) - 1
    out = told.withColumn("shown", recent < burst).filter("_later = 0").select(*key, "_message.*", "shown").select(*messages.columns, "shown")
    w = Window.partitionBy(*key).orderBy("t")
    return out.withColumn("first_suppressed", ~F.col("shown") & F.coalesce(F.lag("shown").over(w), F.lit(True)))


def drop_oldest(frames: DataFrame, keep_rows: int) -> DataFrame:
    """The newest keep_rows rows by idx; indices stay as they are."""
    top = frames.agg(F.max("idx").alias("_top"))
    return frames.join(F.broadcast(top), F.col("idx") > F.col("_top") - keep_rows).drop("_top")


def trim_series(series: DataFrame, below: float) -> DataFrame:
    """Series points at or after a time; file-backed series stay whole."""
    return series.filter((F.col("t") >= below) | F.coalesce(F.col("file_backed"), F.lit(False)))


def note_upserts(notes: DataFrame) -> DataFrame:
    """Notes (id, ord, timestamp_ns, ...) with the first of each id, by time."""
    first: Column = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    return notes.withColumn("_rn", first).filter("_rn = 1").drop("_rn").orderBy("timestamp_ns", "id")
