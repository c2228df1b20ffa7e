"""File-backed signals, sessions and selections."""

import pytest
from pyspark.sql import functions as F

from busloom.operators.trace import Sections
from busloom.plans import filebacked as fb
from busloom.plans.catalog import Catalog
from busloom.plans.session import Selection, Session, channel_for_save, key_generation, log_sources, scoped_catalog

SAMPLES = "file string, group int, group_name string, name string, unit string, record_no long, timestamp_ns long, value double"


@pytest.fixture(scope="module")
def samples(spark):
    rows = [("f", 1, "Engine", n, "V", i, 1_000_000_000 * i, float(i % 3)) for n in ("u", "code") for i in range(10)] + [("f", 2, None, "lone", None, 0, 9_000_000_000, 4.5)]
    return spark.createDataFrame(rows, SAMPLES)


def test_fill(samples):
    first = fb.fill(samples, "/a.mf4", 2_000_000_000, 5_000_000_000)
    got = {(r.group, r.signal): (r["count"], r.time, r.value, r.rate) for r in fb.entries(first).collect()}
    assert got == {(1, "u"): (4, 5.0, 2.0, 1.0), (1, "code"): (4, 5.0, 2.0, 1.0)}
    again = fb.refilled(first, fb.fill(samples.filter("name = 'u' or name = 'lone'"), "/b.mf4"))
    assert [(r.source_path, r.group, r.label, r.signal) for r in fb.content(again).collect()] == [("/a.mf4", 1, "Engine", "code"), ("/b.mf4", 1, "Engine", "u"), ("/b.mf4", 2, "group 2", "lone")]


def test_select(spark, samples):
    series = fb.fill(samples, "/a.mf4")
    tables = spark.createDataFrame([("f", 1, "code", 0, "off"), ("f", 1, "code", 2, "on"), ("f", 2, "lone", 4, "four")], "file string, group int, name string, raw long, label string")
    rows = {r.signal: (r.is_enum, r.label, r.value, r["count"]) for r in fb.select(series, tables, [(1, "code")], ["^//group 2/"]).collect()}
    assert rows == {"code": (True, None, 0.0, 10), "lone": (False, None, 4.5, 1)} or rows == {"code": (True, "off", 0.0, 10), "lone": (False, None, 4.5, 1)}
    assert rows["code"][1] == "off" and fb.select(series, tables, patterns=["."]).count() == 3
    assert fb.select(series, tables, patterns=["."], buses=["a"]).count() == 0
    with pytest.raises(Exception, match="unterminated|missing"):
        fb.select(series, tables, patterns=["("])
    decoded = spark.createDataFrame([("a", 5, False, "s", 1.0)], "bus_id string, id long, extended boolean, signal string, value double")
    page = fb.signal_page(decoded, fb.select(series, tables, patterns=["u$"])).collect()
    assert sorted((r.bus_id or "", r.signal, r.file_backed) for r in page) == [("", "u", True), ("a", "s", False)]
    assert fb.fingerprint("/a", 1, "u") == fb.fingerprint("/a", 1, "u") != fb.fingerprint("/b", 1, "u")


def test_adopted_databases(spark):
    text = b'VERSION ""\nBO_ 5 Speed: 8 ECU\n SG_ V : 0|8@1+ (1,0) [0|0] "" X\n'
    rows = [("c.mf4", "x.DBC", "text/plain", text), ("c.mf4", "y", "application/x-dbc", b"nothing"), ("c.mf4", "z.txt", "text/plain", text), ("c.mf4", "e.dbc", "", b"")]
    given = spark.createDataFrame(rows, "file string, name string, mime string, content binary")
    catalog = Catalog()
    for _ in range(2):
        got = fb.adopt_databases(catalog, given, ["a"])
        assert [(r["identity"], r["messages"], r["error"] is None) for r in got] == [("c.mf4#x.DBC", 1, True), ("c.mf4#y", 0, False)]
    assert len(catalog.loaded) == 1 and catalog.find("a", 5, False).name == "Speed"


def test_sessions(spark):
    s = Session().started(100)
    assert s.lowered(200) == s and s.lowered(50).start_ns == 50 and s.started(7).number == 2 and s.path("/r/") == "/r/session=1"
    frames = spark.createDataFrame([(30, "b", 7, 1, False), (90, "x", 7, 1, False), (95, None, 7, 1, False)], "timestamp_ns long, bus_id string, channel int, id long, extended boolean")
    assert s.anchored(frames).start_ns == 30 and s.anchored(frames.limit(0)) == s and key_generation(frames) == 3
    assert [r[0] for r in frames.select(channel_for_save(["a", "b"])).collect()] == [1, 7, 7] and [r[0] for r in frames.select(channel_for_save([])).collect()] == [7, 7, 7]
    wide = Selection(patterns=("p",)).with_section_patterns(Sections(["S"], patterns={"S": ["q", "p"], "gone": ["r"]}))
    assert wide.patterns == ("p", "q")
    assert scoped_catalog(frames, ["b"]).count() == 1 and scoped_catalog(frames, None).count() == 3
    logs = spark.createDataFrame([("b",), ("a",), ("b",)], "source string")
    assert [r.source for r in log_sources(logs).collect()] == ["a", "b"] and F is not None
