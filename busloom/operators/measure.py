"""Diagnostics over captures: receive gaps, slopes, percentiles, retention, wire time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import held, last_before, same, small
from .series import numbered


#: cells of a histogram pass, and values of a range that are few enough to be ranked in one window
CELLS, LEFT = 1024, 4096


def order_statistics(samples: DataFrame, ranks: Callable[[Column], list[Column]], *key: str) -> DataFrame:
    """(key, n, at: array of values): of the non-null v of each key in order, those at the positions ranks(n), from 0.

    Exact, and nothing is sorted by key: each pass counts the values of the range that holds a position in CELLS cells (a
    partial aggregate) and keeps the cell that holds it, with its own least and greatest value as the next range, until
    all values of a range are equal or at most LEFT are left, which are ranked. Infinite and not-a-number values are
    cells of their own; the latter come last.
    """
    v = F.col("v").cast("double")
    rows = held(samples.select(*key, v.alias("v")).filter("v is not null"))
    finite = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    total = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    places = F.posexplode(F.transform(F.array(*[r.cast("long") for r in ranks(F.col("n"))]), lambda r: F.least(F.greatest(r, F.lit(0)), F.col("n") - 1))).alias("q", "rank")
    # a row a key and position; a small table is made anew in each pass, so that plans stay short
    state = small(total.select(*key, "n", "lo", "hi", places).withColumns({"below": F.lit(0).cast("long"), "inside": F.col("n"), "first": F.lit(True), "value": F.lit(None).cast("double")}))
    while True:
        unsure = state.filter("value is null")
        if unsure.isEmpty():
            break
        of, on = same(rows, unsure, key)
        there = F.col("first") | F.col("v").between(F.col("lo"), F.col("hi"))
        cells = rows.join(of, [*on, there])
        group = [*[f"_of_{k}" for k in key], "q"]
        if unsure.filter(F.col("inside") > LEFT).isEmpty():
            place = Window.partitionBy(*group).orderBy("v")  # at most LEFT
            done = cells.withColumn("_at", F.row_number().over(place) - 1 + F.col("below")).filter("_at = rank")
            found = done.select(*group, "n", "rank", F.col("v").alias("value"))
        else:
            share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
            cell = F.when(F.isnan("v"), CELLS + 1).when(F.col("v") == float("inf"), CELLS).when(F.col("v") == float("-inf"), -1)
            cell = cell.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(F.floor(share * CELLS), F.lit(CELLS - 1)))
            counts = cells.groupBy(*group, "n", "rank", "below", cell.alias("cell")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            before = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # CELLS + 3 rows at most
            counts = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0)))
            found = counts.filter("below <= rank and rank < below + c")
            found = found.select(*group, "n", "rank", "lo", "hi", "below", F.col("c").alias("inside"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("value"))
        found = found.withColumnsRenamed({f"_of_{k}": k for k in key}).withColumn("first", F.lit(False))
        state = small(state.filter("value is not null").unionByName(found, allowMissingColumns=True))
    at = F.transform(F.array_sort(F.collect_list(F.struct("q", "value"))), lambda c: c["value"])  # one a rank
    return state.groupBy(*key, "n").agg(at.alias("at"))


def rx_gap_stats(frames: DataFrame, min_gaps: int = 50, median_range_ns: tuple[int, int] = (1_000_000, 2_000_000_000)) -> DataFrame:
    """Per (bus, id), addressing modes together: receive gaps in arrival order (never negative), their lower-middle
    median and 95th percentile by position, and the share of gaps below half the median.

    Streams with fewer gaps, or a median outside the range, are left out. A frame's predecessor may be carried over from an
    earlier range of frames, and positions come from counts, so no stream is one task's.
    """
    key = ("bus_id", "id")
    rows = frames.filter("direction = 'Rx'").select(*key, "idx", "timestamp_ns")
    rows = last_before(rows, F.col("timestamp_ns"), "_before", key, ("idx",))
    gap = F.greatest(F.col("timestamp_ns") - F.col("_before"), F.lit(0))
    gaps = held(rows.filter("_before is not null").select(*key, gap.alias("gap")))
    found = order_statistics(gaps.withColumnRenamed("gap", "v"), lambda n: [F.floor(n / 2), F.floor(n * 0.95)], *key).filter(F.col("n") >= min_gaps)
    found = found.select(*key, F.col("n").alias("gaps"), F.col("at")[0].cast("long").alias("median_ns"), F.col("at")[1].cast("long").alias("p95_ns"))
    found = found.filter(F.col("median_ns").between(*median_range_ns))
    of, on = same(gaps, small(found), key)
    short = gaps.join(of, on).groupBy(*[f"_of_{k}" for k in key], "gaps", "median_ns", "p95_ns").agg(F.count_if(F.col("gap") < F.floor(F.col("median_ns") / 2)).alias("short"))
    g = short.withColumnsRenamed({f"_of_{k}": k for k in key})
    return g.withColumns({"ratio": F.col("p95_ns") / F.col("median_ns"), "short_share": F.col("short") / F.col("gaps")})


def worst_gaps(stats: DataFrame) -> DataFrame:
    """One row: the worst ratio and the worst share of short gaps, and whose they are."""
    key = F.struct("bus_id", "id")
    return stats.agg(F.max("ratio").alias("ratio"), F.max_by(key, "ratio").alias("ratio_of"), F.max("short_share").alias("short_share"), F.max_by(key, "short_share").alias("short_of"))


def slope_per_minute(samples: DataFrame, *key: str) -> DataFrame:
    """Least-squares slope of v over t (milliseconds), per minute; 0 for fewer than two samples or one time only."""
    return samples.groupBy(*key).agg((F.coalesce(F.regr_slope("v", "t"), F.lit(0.0)) * 60_000).alias("slope"))


def summary(samples: DataFrame, *key: str) -> DataFrame:
    """mean, max, interpolated 95th percentile and median of v; 0 where there are none. Percentiles by exact selection."""
    zero = F.lit(0.0)
    rows = held(samples)
    shares = (0.95, 0.5)
    found = order_statistics(rows, lambda n: [f((n - 1) * s) for s in shares for f in (F.floor, F.ceil)], *key)

    def between(k: int, share: float) -> Column:
        place = (F.col("n") - 1) * share
        low, high = F.col("at")[2 * k], F.col("at")[2 * k + 1]
        return F.when(low == high, low).otherwise(low * (F.ceil(place) - place) + high * (place - F.floor(place)))

    found = found.select(*key, between(0, 0.95).alias("p95"), between(1, 0.5).alias("median"))
    whole = rows.groupBy(*key).agg(F.coalesce(F.avg("v"), zero).alias("mean"), F.coalesce(F.max("v"), zero).alias("max"))
    of, on = same(whole, small(found), key)
    return whole.join(of, on, "left").select(*key, "mean", "max", F.coalesce("p95", zero).alias("p95"), F.coalesce("median", zero).alias("median"))


def retention(samples: DataFrame, *key: str) -> DataFrame:
    """Mean of the second half of the samples over the mean of the first (the middle one counts to the second)."""
    ranked = numbered(samples.select(*key, "t", "v", F.lit(0).alias("idx")), *key).withColumns({"_rn": F.col("rn"), "_half": F.floor(F.col("n") / 2)})
    first = F.avg(F.when(F.col("_rn") < F.col("_half"), F.col("v")))
    second = F.avg(F.when(F.col("_rn") >= F.col("_half"), F.col("v")))
    return ranked.groupBy(*key).agg(F.try_divide(second, first).alias("retention"))


def smoothed(samples: DataFrame, alpha: float = 0.3, *key: str) -> DataFrame:
    """Exponential moving average in order of t; a raw 0 snaps to 0. Each group streams through in order, one number of
    state, as every value depends on the one before."""
    schema = T.StructType([*(samples.schema[k] for k in key), T.StructField("t", T.LongType()), T.StructField("v", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last = None, None
        for pdf in batches:
            out = []
            for own, v in zip(pdf[list(key)].itertuples(index=False, name=None), pdf["v"], strict=True):
                if own != group:
                    group, last = own, None
                last = 0.0 if v == 0 else v if last is None else last + alpha * (v - last)
                out.append(last)
            yield pdf.assign(v=out)

    rows = samples.select(*key, F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"))
    return rows.repartition(*(key or [F.lit(0)])).sortWithinPartitions(*key, "t").mapInPandas(run, schema)


def wire_bits() -> tuple[Column, Column]:
    """(bits at the nominal rate, bits at the data rate) of a frame on the wire, without stuffing: 47 or 67 header bits and 8
    a byte; FD frames have 25 more, which with the payload go at the data rate if the rate switches; error frames 13."""
    header = F.when(F.col("extended"), 67).otherwise(47)
    payload = F.coalesce(F.length("data"), F.lit(0)) * 8
    fd, fast = F.col("kind") == "fd", F.coalesce(F.col("brs"), F.lit(False))
    tail = payload + 25
    nominal = F.when(F.col("kind") == "error", 13).when(fd & fast, header).when(fd, header + tail).otherwise(header + payload)
    return nominal, F.when(fd & fast, tail).otherwise(0)


def frame_duration_ns(nominal_bps: int, data_bps: int) -> Column:
    slow, fast = wire_bits()
    return (F.floor(slow.cast("long") * 1_000_000_000 / nominal_bps) + F.floor(fast.cast("long") * 1_000_000_000 / data_bps)).cast("long")


def schedule_rate(schedule: DataFrame) -> DataFrame:
    """Frames a second of rows (period_ms)."""
    return schedule.agg(F.sum(F.lit(1000.0) / F.col("period_ms")).alias("rate_hz"))
