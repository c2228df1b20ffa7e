"""Retention of captures, timelines, and pages of what is left."""

from pyspark.sql import functions as F

from busloom import model
from busloom.operators import report
from busloom.plans import filter_index, retention
from busloom.queries import sample_catalog


def test_retention(spark, tmp_path):
    frames = model.load_frames(spark, "/root/testdata/sf0.001").persist()
    n = frames.count()
    path = str(tmp_path / "capture")
    frames.withColumn("block", F.floor(F.col("idx") / 100)).write.partitionBy("block").parquet(path)
    sizes = retention.block_sizes(spark, path)
    whole = sum(s for _, s in sizes)
    assert len(sizes) == n // 100 and retention.retain(spark, path, whole) == 0 == retention.low_water(spark, path)
    notes = spark.createDataFrame([("b", 5, "late"), ("a", 1, "early")], "id string, timestamp_ns long, label string")
    assert [r.id for r in retention.timeline(notes, frames, 0).collect()] == ["a", "b"]
    # half of the bytes are derived: of an excess of four blocks the capture sheds two
    mark = retention.retain(spark, path, 2 * whole - sum(s for _, s in sizes[:4]) + 8, derived_bytes=whole)
    assert mark == 200 == retention.low_water(spark, path) and [b for b, _ in retention.block_sizes(spark, path)] == [b for b, _ in sizes[2:]]
    left = spark.read.parquet(path)
    assert left.agg(F.min("idx"), F.max("idx"), F.count("*")).first() == (200, n - 1, n - 200)
    events = retention.timeline(notes, left, mark).collect()
    assert [r.kind for r in events] == ["note", "note", "truncation"] and events[-1].timestamp_ns == frames.filter("idx = 200").first().timestamp_ns and not events[-1].editable
    assert retention.retain(spark, path, 0) == n - 100 and len(retention.block_sizes(spark, path)) == 1, "the newest block stays"
    frames.unpersist()


def test_pages_of_an_index(spark, tmp_path, monkeypatch):
    """Pages near the start, near the end and in the middle, with and without a low-water mark."""
    monkeypatch.setattr(filter_index, "NEAR", 60)
    frames = model.load_frames(spark, "/root/testdata/sf0.001").persist()
    index = filter_index.FilterIndex(spark, str(tmp_path), sample_catalog(), {"bus": "pt"})
    for first in (0, 300):
        every = [r.idx for r in frames.filter("bus_id = 'pt'").filter(F.col("idx") >= first).orderBy("idx").collect()]
        for offset, limit, end in ((0, 5, False), (200, 7, False), (len(every) - 3, 10, False), (0, 4, True), (10**6, 5, False)):
            page, count, start = index.page(frames, offset, limit, end, first)
            want = every[max(0, len(every) - limit) :] if end else every[offset : offset + limit]
            assert (count, [r.idx for r in page.orderBy("idx").collect()]) == (len(every), want)
    frames.unpersist()
    model.free()


def test_run_report(spark):
    rows = [("a", 1.0, 100, 50), ("a", 2.0, 200, 60), ("a", 4.0, 300, 70), ("b", 0.0, 0, 0), ("c", 2.0, 10, 1)]
    samples = spark.createDataFrame(rows, "run string, elapsed_s double, count long, buffer long").repartition(3)
    got = {r.run: r for r in report.run_report(samples, "run").collect()}
    a = got["a"]
    assert (a.frames, a.elapsed_s, a.fps, a.fps_first_half, a.fps_second_half, a.retention, a.slowest_fps) == (300, 4.0, 75.0, 100.0, 50.0, 0.5, 50.0)
    assert (got["b"].fps, got["b"].retention, got["b"].slowest_fps) == (0.0, 0.0, None) and (got["c"].fps, got["c"].retention) == (5.0, 1.0)
    assert sorted((r.elapsed_s, r.buffer, r.fps) for r in report.checkpoints(samples, "run").filter("run = 'a'").collect()) == [(2.0, 60, 100.0), (4.0, 70, 50.0)]
    runs = spark.createDataFrame([("lag", "1", 9.0), ("lag", "2", 21.0), ("heap", "1", 1.0), ("heap", "2", 50.0), ("heap", "3", 2.0), ("new", "1", 7.0), ("lone", "1", 3.0)], "metric string, run string, value double")
    base = spark.createDataFrame([("lag", 10.0, 1.5, 5.0, "worst"), ("heap", 1.0, 2.0, 0.5, "drift"), ("new", 0.0, 2.0, 0.5, "worst"), ("lone", 1.0, 2.0, 0.5, "drift")], "metric string, value double, factor double, floor double, family string")
    got = {(r.metric, r.run): (r.current, r.limit, r["pass"]) for r in report.gate(runs, base).collect()}
    assert got == {("lag", "1"): (9.0, 20.0, True), ("lag", "2"): (21.0, 20.0, False), ("heap", None): (2.0, 2.5, True), ("lone", "1"): (3.0, 2.5, False)}
    model.free()
