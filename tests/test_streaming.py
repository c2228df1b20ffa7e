"""Streaming results equal batch results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from busloom.model import load_frames
from busloom.operators import encode, trace, verify
from busloom.plans import predicate
from busloom.plans.catalog import Catalog
from busloom.plans.filter_index import FilterIndex
from busloom.plans.session import Session
from busloom.queries import sample_catalog
from busloom.sources.dbc import CrcConfig, Database, Message, Signal
from busloom.streaming import live

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("frames"))
    frames = load_frames(spark, DATA).persist()
    for i in range(4):  # one file after the other: frames arrive in order
        frames.filter(F.floor(F.col("idx") / 250) == i).coalesce(1).sortWithinPartitions("idx").write.mode("append").parquet(path)
    return path


def _stream(spark, source):
    return spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 2).parquet(source)


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_latest(spark, source):
    _run(live.latest(_stream(spark, source), "bus_id"), "latest_out", "complete")
    want = {r.bus_id: r.i for r in spark.read.parquet(source).groupBy("bus_id").agg(F.max("idx").alias("i")).collect()}
    assert {r.bus_id: r.frame.idx for r in spark.table("latest_out").collect()} == want


def test_counters(spark, source):
    _run(live.verify_counters(_stream(spark, source), sample_catalog()), "counter_out", "append")
    batch = sorted((r.idx, r.finding) for r in verify.violations(spark.read.parquet(source), sample_catalog()).collect())
    assert batch and sorted((r.idx, r.finding) for r in spark.table("counter_out").collect()) == batch


def test_latest_per_mux(spark, source):
    _run(live.latest_per_mux(_stream(spark, source), sample_catalog()), "mux_out", "complete")
    key = ("bus_id", "id", "extended", "selector")
    want = sorted((*[r[k] for k in key], r.idx, r["count"]) for r in trace.latest_per_mux(spark.read.parquet(source), sample_catalog()).collect())
    assert want and sorted((*[r[k] for k in key], r.frame.idx, r["count"]) for r in spark.table("mux_out").collect()) == want


def test_rates_and_laps(spark, source):
    _run(live.rates(_stream(spark, source), "bus_id", window="1 day"), "rates_out", "complete")
    got = spark.table("rates_out").agg(F.sum("count"), F.min("first_ns"), F.max("last_ns")).first()
    frames = spark.read.parquet(source)
    assert tuple(got) == tuple(frames.agg(F.count("*"), F.min("timestamp_ns"), F.max("timestamp_ns")).first())
    laps = live.looped(frames, 3)
    n, first, last = frames.agg(F.count("*"), F.min("timestamp_ns"), F.max("timestamp_ns")).first()
    assert laps.agg(F.count_distinct("idx"), F.min("timestamp_ns"), F.max("timestamp_ns")).first()[:] == (3 * n, first, last + 2 * (last - first))


def _key_rates(rows):
    return {(r.bus_id, r.id, r.extended): (r["count"], r.last_idx, r.rate) for r in rows}


def test_key_rates(spark, source):
    """After all batches, each key's last row equals the batch operator's, times, counts and ties included."""
    key = ("bus_id", "id", "extended")
    q = live.key_rates(_stream(spark, source), *key).writeStream.format("memory").queryName("key_rates_out").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    newest = spark.table("key_rates_out").groupBy(*key).agg(F.max_by(F.struct("count", "last_idx", "rate"), "count").alias("r")).select(*key, "r.*")
    want = _key_rates(trace.key_rates(spark.read.parquet(source), *key).collect())
    got = _key_rates(newest.collect())
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_key_rates_out_of_order(spark, tmp_path):
    """After each batch the stream equals the batch operator over the frames so far, late, tied and lone frames included."""
    second = 1_000_000_000
    steps = [
        [("a", 0, 5 * second), ("a", 1, 5 * second), ("b", 2, 7 * second)],
        [("a", 3, 4 * second), ("b", 4, 7 * second - 400), ("c", 5, 1)],  # late frames
        [("a", 6, 5 * second + 9), ("a", 7, 3 * second), ("b", 8, 9 * second), (None, 9, 2), (None, 10, 2 + second // 4)],
        [("a", 11, 20 * second), ("c", 12, 1), ("b", 13, 9 * second - 1), ("a", 14, 19 * second)],
    ]
    schema, path = "bus_id string, idx long, timestamp_ns long", str(tmp_path / "in")
    q, done = None, []
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        done += rows
        if q is None:
            q = live.key_rates(spark.readStream.schema(schema).parquet(path), "bus_id").writeStream.format("memory").queryName("late_out").outputMode("update").start()
        q.processAllAvailable()
        newest = {}
        for r in spark.table("late_out").collect():
            if r["count"] >= newest.get(r.bus_id, (0,))[0]:
                newest[r.bus_id] = (r["count"], r.last_idx, r.rate)
        want = {r.bus_id: (r["count"], r.last_idx, r.rate) for r in trace.key_rates(spark.createDataFrame(done, schema), "bus_id").collect()}
        assert newest.keys() == want.keys() and all(newest[k] == pytest.approx(want[k], rel=1e-12) for k in want), i
    q.stop()


def test_checksums(spark):
    crc = CrcConfig("Sum", "CRC-8/SAE-J1850", 0, 56)
    message = Message(5, False, "M", 8, "E", (Signal("Sum", 56, 8, True, False, 1.0, 0.0, 0.0, 0.0, ""),), crc=crc)
    catalog = Catalog().add(Database("d", (message,)), ["a"])
    rows = [(i, "a", 5, False, "Rx", "classic", bytes([i] * 7 + [0])) for i in range(20)]
    frames = encode.apply_calc(spark.createDataFrame(rows, "idx long, bus_id string, id long, extended boolean, direction string, kind string, data binary"), message, "bus_id")
    bad = frames.withColumn("data", F.when(F.col("idx") == 3, F.lit(bytes(8))).when(F.col("idx") == 4, F.lit(b"\1")).otherwise(F.col("data")))
    assert [(r.idx, r.finding) for r in verify.checksum_findings(bad, catalog).orderBy("idx").collect()] == [(3, "crc_mismatch"), (4, "truncated")]
    assert verify.checksum_findings(frames, catalog).count() == 0 and verify.checksum_findings(frames, Catalog()).count() == 0
    assert {r.idx for r in live.verify_checksums(bad, catalog).collect()} == {3, 4}


def test_filter_index(spark, source, tmp_path):
    """Extended after each append, the index equals the filter over everything; pages equal those of a recount."""
    every, catalog, tree = spark.read.parquet(source), sample_catalog(), {"all": [{"bus": "pt"}, {"signal_equals": {"name": "Mode", "value": 1}}]}
    index = FilterIndex(spark, str(tmp_path), catalog, tree)
    for rows in (0, 300, 300, 301, 1000):
        some = every.filter(F.col("idx") < rows)
        want = sorted(r.idx for r in predicate.filter_frames(some, tree, catalog).collect())
        assert sorted(r.idx for r in index.matches(some).collect()) == want
    for from_end in (False, True):
        (a, n, first), (b, m, place) = index.page(every, 5, 10, from_end), trace.filtered_page(every, tree, catalog, 5, 10, from_end)
        assert (n, first, [r.idx for r in a.collect()]) == (m, place, [r.idx for r in b.collect()])
    other = FilterIndex(spark, str(tmp_path), catalog, tree, Session().started(0))
    assert other.folder != index.folder and other.page(every.limit(0), 0, 5)[1] == 0


def test_clock(spark):
    rows = [("s", i, i * 100_000_000, 0 if i < 3 else 2_000_000) for i in range(10)]
    out = live.correct_clock(spark.createDataFrame(rows, "session string, idx long, timestamp_ns long, target_ns long"), "session").orderBy("idx").collect()
    assert [r.corrected_ns - r.timestamp_ns for r in out] == [0, 0, 0, 500_000, 1_000_000, 1_500_000, 2_000_000, 2_000_000, 2_000_000, 2_000_000]
    assert live.slewed(2_000_000_000, 0, 1) == 2_000_000_000
    e = spark.createDataFrame([("s", 1, 0, 10, 12, 20), ("s", 2, 0, 6, 7, 9), ("s", 3, 0, 6, 7, 9)], "k string, n long, t0 long, t1 long, t2 long, t3 long")
    best = live.best_clock_sample(live.clock_samples(e), "k").first()
    assert (best.n, best.delay, best.offset) == (2, 8, 2)


def test_log_limits(spark):
    rows = [("a", "t", i * 10) for i in range(5)] + [("a", "t", 2_000_000_000)]
    out = live.rate_limited(spark.createDataFrame(rows, "source string, template string, t long"), 2).orderBy("t").collect()
    assert [r.shown for r in out] == [True, True, False, False, False, True] and [r.first_suppressed for r in out].count(True) == 1


@pytest.mark.parametrize(("window", "burst"), [(10, 3), (7, 1), (1, 2), (1000, 40), (10, 0)])
def test_log_limits_brute(spark, window, burst):
    """Every message against a count by hand, with shared, negative and missing times; no frame slides with its row."""
    rng = random.Random(window)
    rows = [(rng.choice("ab"), rng.choice(["t", "u", None]), i, None if rng.random() < 0.05 else rng.randrange(-60, 140)) for i in range(400)]
    df = spark.createDataFrame(rows, "source string, template string, idx long, t long").repartition(3)
    out = live.rate_limited(df, burst, window)
    assert out.columns == ["source", "template", "idx", "t", "shown", "first_suppressed"]

    def recent(source, template, t):
        own = [x for s, m, _, x in rows if (s, m) == (source, template)]
        return sum(x is None if t is None else x is not None and t - window < x <= t for x in own) - 1

    want = {i: recent(s, m, t) < burst for s, m, i, t in rows}
    assert {r.idx: r.shown for r in out.collect()} == want and len(set(want.values())) == 1 + (burst > 0)
    plan = out.select("idx", "shown")._jdf.queryExecution().executedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\(\w+, ([^,]+),", plan)
    assert frames and all(start == "unboundedpreceding$()" for start in frames)
