from pyspark.sql import functions as F

from busloom.functions import presentation as p
from busloom.model import free, load_frames
from busloom.plans.cache import SeriesCache, import_capture
from busloom.queries import sample_catalog
from busloom.sources import blf

from .test_sources import _frames


def test_texts(spark):
    rows = [(5_871_000_000, "5.8710"), (65_000_000_000, "1:05.0000"), (7_203_500_000_000, "2:00:03.5000"), (-59_999_960_000, "-1:00.0000"), (90_061_000_000_000, "1:01:01:01.0000")]
    df = spark.createDataFrame(rows, "ns long, want string")
    assert all(r.got == r.want for r in df.select("want", p.elapsed_text(F.col("ns")).alias("got")).collect())
    (r,) = spark.createDataFrame([(0x1A, True, bytearray(b"\x01\xab"))], "i long, e boolean, d binary").select(p.id_text(F.col("i"), F.col("e")).alias("i"), p.bytes_text(F.col("d")).alias("d")).collect()
    assert (r.i, r.d) == ("0x0000001A", "01 AB")
    assert p.stable_hash("") == 0x811C9DC5 and p.stable_hash("a") == 0xE40C292C


def test_axes():
    assert p.axis_range((5.0, 5.0)) == (4.5, 5.5) and p.axis_range((0.0, 0.0)) == (-1.0, 1.0)
    assert p.axis_range((2.0, 300.0), log=True) == (1.0, 1000.0) and p.axis_range((-2.0, -1.0), log=True) is None
    assert p.decade_ticks(1, 1000) == [1, 10, 100, 1000] and p.follow_window(5, 10) == (0, 10) and p.centered_window(1, 10) == (0, 10)
    assert p.generated_id(["(", "x", r"v(\d+)"], "cell_v12") == 12 and p.generated_id([r"(\w+)"], "a") is None


def test_colors(spark):
    values = spark.createDataFrame([(1, "b", 5, False, "s", 2.0), (2, "b", 5, False, "s", 9.0)], "row int, bus_id string, id int, extended boolean, signal string, value double")
    rules = spark.createDataFrame([(0, 0, "c", 5, False, "s", 0.0, 5.0, "red"), (1, 0, None, 5, False, "s", 2.0, 2.0, "blue")], "map_order int, rule_order int, bus_id string, id int, extended boolean, signal string, min double, max double, color string")
    assert {r.row: r.color for r in p.value_colors(values, rules).collect()} == {1: "blue", 2: None}


def test_import_and_cache(spark, tmp_path):
    frames = spark.createDataFrame([tuple(f[k] for k in f) for f in _frames()], "idx long, timestamp_ns long, channel int, id long, extended boolean, direction string, kind string, data binary, brs boolean, esi boolean, dlc int")
    blf.save_blf(frames, str(tmp_path / "log"))
    bus = spark.createDataFrame([(0, "a", 0), (1, "b", 1)], "channel int, bus_id string, ord int")
    stored = import_capture(blf.read_blf(spark, str(tmp_path / "log")), bus, str(tmp_path / "store"))
    assert [r.id for r in stored.orderBy("idx").collect()] == [f["id"] for f in _frames() if f["channel"] < 2]
    cache = SeriesCache(spark, str(tmp_path / "cache"), sample_catalog())
    key = ("pt", 257, False, "Value")
    first = [x.count() for x in cache.levels(load_frames(spark, "/root/testdata/sf0.001"), key)]
    assert first[0] > 0 and [x.count() for x in cache.levels(load_frames(spark, "/root/testdata/sf0.001").limit(0), key)] == first


def test_cache_grows(spark, tmp_path):
    """A cache extended frame by frame equals one built at once; captures don't share tables; late frames rebuild."""
    every = load_frames(spark, "/root/testdata/sf0.01").filter("bus_id = 'pt' and id = 257 and not extended")
    frames = spark.createDataFrame(every.collect(), every.schema).persist()
    key = ("pt", 257, False, "Value")
    top = frames.agg({"idx": "max"}).first()[0]

    def points(levels):
        return [sorted((r.idx, r.value) for r in x.select("idx", "value").collect()) for x in levels]

    whole = points(SeriesCache(spark, str(tmp_path), sample_catalog(), "whole").levels(frames, key))
    cache = SeriesCache(spark, str(tmp_path), sample_catalog(), "parts")
    for share in (0.2, 0.5, 1.0):
        got = points(cache.levels(frames.filter(frames.idx <= int(top * share)), key))
    assert len(whole) > 2 and got == whole
    parts = spark.read.parquet(cache.path(key))
    assert sorted(r.rn for r in parts.select("rn").collect()) == list(range(len(whole[0])))
    assert cache.evict(0, [key]) == 0 and cache.exists(cache.path(key)), "what is in use stays"
    other = ("pt", 257, False, "K")
    cache.levels(frames, other)
    assert cache.evict(1 << 40, [key]) == 0 and cache.evict(0, [key]) > 0
    assert not cache.exists(cache.path(other)) and points(cache.levels(frames, key)) == whole
    late = SeriesCache(spark, str(tmp_path), sample_catalog(), "late")
    moved = frames.withColumn("timestamp_ns", (F.lit(2 * 10**18) - frames.timestamp_ns))
    late.levels(moved.filter(frames.idx <= top // 2), key)
    assert points(late.levels(moved, key)) == points(SeriesCache(spark, str(tmp_path), sample_catalog(), "moved").levels(moved, key))
    free()


def test_more_texts(spark):
    row = spark.range(1).select(
        p.bytes_text(F.lit(b"\x0a\xff")), p.rate_text(F.lit(0.0)), p.rate_text(F.lit(9.96)), p.rate_text(F.lit(100.4)), p.has_wall_clock(F.lit(1.7e9)), p.has_wall_clock(F.lit(5.0)), p.has_wall_clock(F.lit(None)),
        *[p.float_text(F.lit(v).cast("double")) for v in (0.0, 1.5, 123456.789, 0.00012345678, 0.00001, 1e6, -2.5e-7, float("nan"), 99.0)],
        p.signal_color(F.lit(""), F.lit(None), F.lit("s")), p.signal_color(F.lit("p"), F.lit("g"), F.lit("s")),
    ).first()
    assert list(row) == ["0A FF", "", "10.0", "100", True, False, False, "0", "1.5", "123457", "0.000123457", "1.00000e-5", "1.00000e+6", "-2.50000e-7", "\u2014", "99", "s", "p"]
