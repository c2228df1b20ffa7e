"""Reports of measured runs, and the gate that judges them against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import last_before, same, small
from .measure import order_statistics


def checkpoints(samples: DataFrame, *key: str) -> DataFrame:
    """(key, elapsed_s, buffer, fps): frames a second between each sample (elapsed_s, count, buffer) and the one before it;
    samples at one time give none. The sample before may be carried over from an earlier range."""
    rows = last_before(samples, F.struct("elapsed_s", "count"), "_before", key, ("elapsed_s", "count"))
    span = F.col("elapsed_s") - F.col("_before.elapsed_s")
    return rows.filter(span > 0).select(*key, "elapsed_s", "buffer", ((F.col("count") - F.col("_before.count")) / span).alias("fps"))


def run_report(samples: DataFrame, *key: str) -> DataFrame:
    """Per run (key): frames, elapsed_s, fps, fps_first_half, fps_second_half, retention and the slowest checkpoint.

    The halves meet at the first sample that has half of the frames; where they have no span, both are the whole run's
    rate. Retention is the second half's rate by the first's, 0 where that is 0.
    """
    order = F.struct("elapsed_s", "count")
    whole = samples.groupBy(*key).agg(F.max_by(F.struct("elapsed_s", "count"), order).alias("_last"), F.min_by(F.struct("elapsed_s", "count"), order).alias("_first"))
    of, on = same(samples, small(whole), key, "_run_")
    reached = F.col("count") >= F.floor(F.col("_last.count") / 2)
    mid = samples.join(of, on).groupBy(*[F.col(f"_run_{k}").alias(k) for k in key], "_last", "_first").agg(F.min_by(F.struct("elapsed_s", "count"), F.when(reached, order)).alias("_mid"))
    mid = mid.withColumn("_mid", F.coalesce("_mid", "_first"))
    n, t, half_n, half_t = (F.col(c) for c in ("_last.count", "_last.elapsed_s", "_mid.count", "_mid.elapsed_s"))
    fps = F.when(t > 0, n / t).otherwise(F.lit(0.0))
    split = (half_t > 0) & (t > half_t)
    out = mid.select(
        *key, n.alias("frames"), t.alias("elapsed_s"), fps.alias("fps"), F.when(split, half_n / half_t).otherwise(fps).alias("fps_first_half"), F.when(split, (n - half_n) / (t - half_t)).otherwise(fps).alias("fps_second_half")
    )
    out = out.withColumn("retention", F.when(F.col("fps_first_half") > 0, F.col("fps_second_half") / F.col("fps_first_half")).otherwise(F.lit(0.0)))
    slowest = checkpoints(samples, *key).groupBy(*key).agg(F.min("fps").alias("slowest_fps"))
    of, on = same(out, small(slowest), key)
    return out.join(of, on, "left").select(*out.columns, "slowest_fps")


def gate(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Verdicts (metric, run, baseline, current, limit, pass) of runs (metric, run, value).

    baseline (metric, value, factor, floor, family): a value passes up to value * factor + floor. Every run is judged, so
    the worst decides; of the family `drift` the median of several runs is (run is null then), as a slope over a short
    window is noisier than a maximum. Metrics whose baseline is absent or not positive are not judged.
    """
    known = small(baseline.filter("value > 0").select(F.col("metric").alias("_metric"), F.col("value").alias("baseline"), (F.col("value") * F.col("factor") + F.col("floor")).alias("limit"), "family"))
    rows = runs.filter("value is not null").join(known, runs["metric"] == known["_metric"]).select("metric", "run", F.col("value").alias("current"), "baseline", "limit", "family")
    drift = rows.filter("family = 'drift'")
    middle = order_statistics(drift.select("metric", "baseline", "limit", F.col("current").alias("v")), lambda n: [F.floor((n - 1) / 2), F.floor(n / 2)], "metric", "baseline", "limit")
    middle = middle.filter("n > 1").select("metric", F.lit(None).cast(rows.schema["run"].dataType).alias("run"), ((F.col("at")[0] + F.col("at")[1]) / 2).alias("current"), "baseline", "limit")
    many = small(drift.groupBy("metric").agg(F.count("*").alias("_n")).filter("_n > 1").select("metric"))
    each = rows.join(many, "metric", "left_anti").select("metric", "run", "current", "baseline", "limit")
    return each.unionByName(middle).select("metric", "run", "baseline", "current", "limit", (F.col("current") <= F.col("limit")).alias("pass"))
