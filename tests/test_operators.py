"""Operators on small fixtures."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from busloom import model
from busloom.operators import decode, encode, measure, series, trace, verify
from busloom.plans import predicate
from busloom.plans.catalog import Catalog
from busloom.sources.dbc import parse_dbc

from .test_schema import TEXT, _s

FIELDS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in model.FRAME_SCHEMA)


def frame(idx, data=b"", id=256, extended=False, bus="x", kind="classic", direction="Rx", ts=None, channel=0):
    return (idx, idx * 1_000_000_000 if ts is None else ts, channel, bus, id, extended, direction, kind, bytearray(data), None, None, None)


@pytest.fixture(scope="module")
def catalog():
    return Catalog().add(parse_dbc(TEXT, "main"), ["x", "y"])


def test_decode(spark, catalog):
    wide = bytearray(16)
    wide[0:1] = b"\x00"
    wide[1:3] = struct.pack("<h", -5)
    wide[8:12] = struct.pack("<f", 47.5)
    rows = [frame(0, b"\x10\x27\x01\0\x05\0\0\0"), frame(1, b"\x10"), frame(2, bytes(wide), 512, True, kind="fd"), frame(3, b"\0" * 8, 999), frame(4, b"\x10\x27" + b"\0" * 6, bus="z"), frame(5, b"\x01\x12\x34\0\0\0\0\0\0\0\xc0\x7f", 512, True)]
    out = {r.idx: r for r in decode.decode_frames(spark.createDataFrame(rows, FIELDS), catalog).collect()}
    named = lambda i: {s.name: s for s in out[i].signals}
    assert named(0)["Fast"].value == pytest.approx(100.0) and named(0)["Gear"].label == "R"
    assert out[1].message == "Speed" and out[1].signals == []
    assert named(2)["A"].value == pytest.approx(-40.5) and named(2)["A"].raw_signed == -5 and named(2)["Flow"].value == 47.5 and "B" not in named(2)
    assert out[3].message is None and out[3].signals is None and out[4].message is None
    assert named(5)["B"].raw_unsigned == 0x1234 and math.isnan(named(5)["Flow"].value)


def test_floats(spark):
    for size, fmt in ((32, "<f"), (64, "<d")):
        values = [0.0, -0.0, 1.5, -2.25, 1e-310 if size == 64 else 1e-40, 3e300 if size == 64 else 3e38, float("inf"), float("-inf")]
        s = _s(size=size, kind="f32" if size == 32 else "f64")
        rows = [frame(i, struct.pack(fmt, v)) for i, v in enumerate(values)]
        got = [r.v for r in spark.createDataFrame(rows, FIELDS).orderBy("idx").select(decode.physical(s, decode.raw_value(s)).alias("v")).collect()]
        assert got == [struct.unpack(fmt, struct.pack(fmt, v))[0] for v in values]


def test_wide_integers(spark):
    s = _s(size=64)
    rows = [frame(0, b"\xff" * 8), frame(1, b"\x01" + b"\0" * 7)]
    got = [r.v for r in spark.createDataFrame(rows, FIELDS).orderBy("idx").select(decode.physical(s, decode.raw_value(s)).alias("v")).collect()]
    assert got == [float((1 << 64) - 1), 1.0]


def test_exact_scaling(spark):
    s = _s(factor=0.1, offset=-0.3)
    got = spark.createDataFrame([frame(0, b"\x03")], FIELDS).select(decode.physical(s, decode.raw_value(s), True).alias("v")).first().v
    assert got == math.fma(3.0, 0.1, -0.3)


def test_encode_and_calc(spark, catalog):
    message = catalog.loaded[0].database.messages[0]
    rows = spark.createDataFrame([frame(i, bytes(8)) for i in range(40)], FIELDS)
    out = encode.encode_frames(rows, message, {"Fast": F.col("idx") * 1.0, "None": F.lit(1.0)})
    assert {tuple(r.skipped) for r in out.collect()} == {("None",)}
    sent = encode.apply_calc(out.select(*rows.columns), message, "bus_id")
    back = decode.decode_series(sent, catalog, [("x", 256, False, n) for n in ("Fast", "Alive")])
    got = {(r.idx, r.signal): r.value for r in back.collect()}
    assert [got[i, "Fast"] for i in range(40)] == pytest.approx(list(range(40))) and [got[i, "Alive"] for i in range(40)] == [3 * (i + 1) % 14 for i in range(40)]
    assert verify.violations(sent, catalog).count() == 0
    broken = sent.withColumn("data", F.when(F.col("idx") == 7, F.overlay("data", F.lit(b"\xff"), F.lit(3))).when(F.col("idx") == 9, F.lit(b"\0")).otherwise(F.col("data"))).filter("idx <> 20")
    assert [(r.idx, r.finding) for r in verify.violations(broken, catalog).collect()] == [(7, "crc_mismatch"), (9, "truncated"), (10, "counter_skip"), (21, "counter_skip")]
    (last,) = verify.validity(broken, catalog).collect()
    assert last.valid and last.finding is None


def test_predicates(spark, catalog):
    rows = spark.createDataFrame([frame(0, b"\x10\x27" + b"\0" * 6), frame(1, bytes(8), bus=None), frame(2, bytes(16), 512, True), frame(3, bytes(8), 512)], FIELDS)
    ids = lambda t: sorted(r.idx for r in predicate.filter_frames(rows, t, catalog).collect())
    assert ids({"signal_equals": {"name": "Fast", "value": 100.0}}) == [0]
    assert ids({"id_range": [512, 512]}) == [2, 3] and ids({"name_regex": "^W"}) == [2] and ids({"name_regex": "("}) == []
    assert ids({"bus": "x"}) == [0, 2, 3] and ids({"nope": 1}) == [] and ids({"all": []}) == [0, 1, 2, 3] and ids({"any": []}) == []
    assert ids({"any": [{"nope": 1}, {"all": [{"bus": "x"}, {"id_list": [256]}]}]}) == [0]
    assert predicate.candidates({"all": [{"id_list": [256]}, {"bus": "x"}]}, catalog).keys == {(256, False), (256, True)}
    sink = predicate.sink_predicate(["f"], {"f": {"predicate": {"id_list": [256]}, "sources": ["x", "f"]}})
    assert ids(sink) == [0] and ids(predicate.sink_predicate([], {})) == []


def test_index_and_pages(spark, catalog):
    rows = spark.createDataFrame([frame(i, bytes(8), ts=1000 + 10 * i) for i in range(50)], FIELDS)
    times = spark.createDataFrame([("a", 0), ("b", 1015), ("c", 1490), ("d", 9999)], "event string, ns long")
    assert {r.event: r.idx for r in trace.index_at(rows, times).collect()} == {"a": 0, "b": 2, "c": 49, "d": 50}
    page, count, start = trace.filtered_page(rows, {"bus": "x"}, catalog, 0, 5, from_end=True)
    assert (count, start, [r.idx for r in page.collect()]) == (50, 45, [45, 46, 47, 48, 49])
    numbered = model.with_dense_index(rows.drop("idx"), "timestamp_ns")
    assert sorted((r.idx, r.timestamp_ns) for r in numbered.collect()) == [(i, 1000 + 10 * i) for i in range(50)]
    disordered = rows.withColumn("timestamp_ns", F.when(F.col("idx") == 3, 5000).otherwise(F.col("timestamp_ns")))
    assert trace.time_window(disordered, 0, 1200, prefix_stop=True).count() == 3 and trace.time_window(disordered, 0, 1200).count() == 20


def _points(spark, values, times=None):
    return spark.createDataFrame([("k", i, float(i if times is None else times[i]), v) for i, v in enumerate(values)], "k string, idx long, t double, value double")


def test_nan_series(spark):
    nan = float("nan")
    got = [r.idx for r in series.reduce_runs(_points(spark, [1.0, 1.0, nan, nan, 2.0, 2.0]), "k").orderBy("idx").collect()]
    assert got == [0, 2, 3, 4, 5]
    (e,) = series.extents(_points(spark, [nan, 3.0, -1.0]), "k").collect()
    assert (e.lo, e.hi) == (-1.0, 3.0)
    got = [r.idx for r in series.decimate_min_max(_points(spark, [5.0, nan, 1.0, 9.0] * 5), 5, "k").orderBy("idx").collect()]
    assert got == [i for i in range(20) if i % 4 in (2, 3) or i == 0]
    assert series.decimate_min_max(_points(spark, [1.0] * 7), 7, "k").count() == 7


def test_decimation_matches_loop(spark):
    values = [float((i * 37) % 23) for i in range(101)]
    want = {0, 100}
    size = math.ceil(101 / 10)
    for a in range(0, 101, size):
        part = list(range(a, min(101, a + size)))
        want |= {min(part, key=lambda i: (values[i], i)), min(part, key=lambda i: (-values[i], i))}
    assert sorted(want) == [r.idx for r in series.decimate_min_max(_points(spark, values), 10, "k").orderBy("idx").collect()]


def test_spans_and_serve(spark):
    s = _points(spark, [1.0] * 30, [float(i) for i in range(15)] + [60.0 + i for i in range(15)])
    assert [(r.from_t, r.to_t) for r in series.extrapolated_spans(s, s, -5.0, 100.0, "k").orderBy("from_t").collect()] == [(-5.0, 0.0), (14.0, 60.0), (74.0, 100.0)]
    long = _points(spark, [float(i % 50) for i in range(1000)])
    levels = series.pyramid(long, "k")
    assert [lv.count() for lv in levels[:2]] == [1000, 250] and levels[-1].count() < 8
    served = series.serve(levels, 0.0, 1000.0, 20, "k")
    assert served.count() <= 60 and served.agg(F.max("t")).first()[0] == 999.0
    assert series.serve(levels, 0.0, 1000.0, 0, "k", categorical=True).count() == 1000


def test_values_at(spark):
    s = _points(spark, [1.0, 2.0, 3.0], [0.0, 1.0, 1.0])
    times = spark.createDataFrame([(-1.0,), (0.5,), (1.0,)], "x double")
    assert {r.x: r.value for r in series.value_at(s, times, "k").collect()} == {-1.0: None, 0.5: 1.0, 1.0: 3.0}
    (m,) = series.measurements(s, 1.0, 0.0, "k").collect()
    assert (m.value_a, m.value_b, m.delta, m.dt, m.frequency, m.points) == (3.0, 1.0, -2.0, 1.0, 1.0, 3)
    (n,) = series.nearest(_points(spark, [1.0, 2.0], [0.0, 2.0]), 1.0, "k").collect()
    assert n.value == 2.0


def test_measures(spark):
    samples = spark.createDataFrame([("a", i, float(2 * i)) for i in range(10)] + [("b", 0, 1.0)], "k string, t long, v double")
    assert {r.k: r.slope for r in measure.slope_per_minute(samples, "k").collect()} == {"a": pytest.approx(120_000.0), "b": 0.0}
    assert {r.t: r.v for r in measure.smoothed(samples.filter("k = 'a'"), 0.5, "k").collect()}[2] == pytest.approx(2.5)
    (r,) = measure.retention(samples.filter("k = 'a'"), "k").collect()
    assert r.retention == pytest.approx(14 / 4)


def test_arbitration(spark):
    rows = [("x", "s1", 300, False, 0, 100, 0), ("x", "s2", 200, False, 10, 100, 1), ("x", "s3", 100, False, 20, 100, 2), ("x", "s1", 50, False, 1000, 100, 3)]
    requests = spark.createDataFrame(rows, "bus_id string, sender string, id long, extended boolean, enqueued_ns long, duration_ns long, ord long")
    sent = encode.arbitrate(requests)
    assert [(r.id, r.start_ns) for r in sent.orderBy("start_ns").collect()] == [(300, 0), (100, 100), (200, 200), (50, 1000)]
    members = spark.createDataFrame([("x", "s1"), ("x", "s2")], "bus_id string, participant string")
    assert encode.fan_out(sent, members).filter("acknowledged").count() == 5


def test_route_batches(spark):
    rows = [("b", 3, b"3"), ("a", 5, b"5"), ("b", 1, b"1"), ("c", 2, b"2"), ("a", 4, b"4")]
    out = encode.batches_by_route(spark.createDataFrame(rows, "destination string, ord long, data binary")).orderBy("batch", "place").collect()
    assert [(r.destination, r.batch, r.place, bytes(r.data)) for r in out] == [("b", 0, 0, b"1"), ("b", 0, 1, b"3"), ("c", 1, 0, b"2"), ("a", 2, 0, b"4"), ("a", 2, 1, b"5")]


def test_schedule(spark):
    entries = spark.createDataFrame([("a", 10), ("b", 25), ("c", 0)], "entry string, period_ms int")
    out = encode.schedule(entries, 0, 1_000_000_000)
    assert {r.entry: r["count"] for r in out.groupBy("entry").count().collect()} == {"a": 100, "b": 40}


def test_rest_of_bus(catalog):
    doc = encode.RestOfBus({"fill_bit": 1, "disabled_messages": ["Wide"], "buses": {"x": {"ecus": {"ECU1": {"messages": {"Speed": {"period_ms": 20, "signals": {"Fast": 1.0, "Gear": "R", "Alive": "0x1F", "Nope": 1}}}}}}}})
    payload, warnings = doc.payload("x", catalog.loaded[0].database.messages[0])
    assert payload[:2] == b"\x64\0" and payload[2] & 7 == 1 and payload[4] & 15 == 15 and len(warnings) == 2
    assert [e[2] for e in doc.entries(catalog)] == ["Speed"] and [r["message"] for r in doc.view(catalog)] == ["Wide", "Speed", "Wide", "Speed"]


def test_sections(spark):
    rows = spark.createDataFrame([("i1", "x/e/m/a", 1), ("i2", "x/e/m/b", 2), ("i3", "y/e/m/c", 3)], "identity string, path string, ordinal int")
    out = trace.arrange_sections(rows, trace.Sections(["S", "T"], {"i3": "T", "i1": "gone"}, {"S": ["/b$", "("]}, {"T"})).collect()
    assert [(r.section, r.is_header, r.identity) for r in out] == [("", True, None), ("", False, "i1"), ("S", True, None), ("S", False, "i2"), ("T", True, None)]
    assert [r.section_count for r in out if r.is_header] == [1, 1, 1]
