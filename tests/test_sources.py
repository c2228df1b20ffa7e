"""Log files: round trips."""

import random

import pytest
from pyspark.sql import functions as F

from busloom import model
from busloom.sources import blf

START = 1_709_294_400_123_456_789


def _frames():
    row = lambda i, **k: {"idx": i, "timestamp_ns": START + i * 1000, "channel": i % 3, "id": 256 + i, "extended": i % 2 == 1, "direction": "Rx" if i % 3 else "Tx", "kind": "classic", "data": bytes(range(i % 9)), "brs": None, "esi": None, "dlc": i % 9} | k
    out = [row(i) for i in range(20)]
    out += [row(20, kind="fd", data=bytes(range(48)), brs=True, esi=False, dlc=14), row(21, kind="remote", data=b"", dlc=4), row(22, kind="error", data=b"", dlc=None)]
    return out


def test_round_trip():
    frames = _frames()
    content, clamped, _ = blf.build(frames, [{"timestamp_ns": START + 5000, "group": "g", "label": "né", "description": "id-1", "color": 0xFF}])
    back = list(blf.parse(content, "f"))
    keys = ("timestamp_ns", "channel", "id", "extended", "direction", "kind", "data", "brs", "esi", "dlc")
    assert [tuple(r[2:]) for r in back] == [tuple(f[k] for k in keys) for f in frames] and clamped == 0
    ((_, _, at, *text),) = list(blf.parse(content, "f", markers=True))
    assert at == START + 5000 and text == ["g", "né", "id-1", 0xFF]


def test_clamp_and_damage():
    content, clamped, worst = blf.build(_frames(), start_ns=START + 10_000_000)
    assert clamped == 23 and worst > 0 and len(list(blf.parse(content, "f"))) == 23
    with pytest.raises(blf.BlfError):
        list(blf.parse(b"no file" * 50, "f"))


def test_many_containers():
    frames = [dict(_frames()[8], timestamp_ns=START + i, id=i % 2000) for i in range(30_000)]
    content, _, _ = blf.build(frames)
    assert [r[4] for r in blf.parse(content, "f")] == [f["id"] for f in frames]


def test_spark_formats(spark, tmp_path):
    frames = spark.createDataFrame([tuple(f[k] for k in f) for f in _frames()], "idx long, timestamp_ns long, channel int, id long, extended boolean, direction string, kind string, data binary, brs boolean, esi boolean, dlc int")
    blf.save_blf(frames, str(tmp_path / "out"))
    blf.register(spark)
    assert spark.read.format("blf").load(str(tmp_path / "out")).count() == 23
    read = blf.read_blf(spark, str(tmp_path / "out"))
    assert [r.id for r in read.orderBy("object_no").collect()] == [f["id"] for f in _frames()]
    (c,) = blf.blf_census(spark, str(tmp_path / "out")).collect()
    assert (c.channels, c.frames, c.markers, c.first_ns) == ([0, 1, 2], 23, 0, START)
    bus = spark.createDataFrame([(0, "a", 0), (1, "b", 1), (0, "z", 2)], "channel int, bus_id string, ord int")
    routed = model.route(read, bus)
    assert {r.bus_id for r in routed.collect()} == {"a", "b"} and model.guard(routed, START + 3000).agg(F.min("timestamp_ns")).first()[0] == START + 3000


def test_parallel_save(spark, tmp_path):
    """Containers packed by several tasks make one file, whose head tells what it holds."""
    rows = [dict(_frames()[8], idx=i, timestamp_ns=START + 1000 * i, id=i % 2000) for i in range(20_000)]
    frames = spark.createDataFrame([tuple(r[k] for k in _frames()[0]) for r in rows], "idx long, timestamp_ns long, channel int, id long, extended boolean, direction string, kind string, data binary, brs boolean, esi boolean, dlc int")
    blf.save_blf(frames.repartition(5), str(tmp_path / "out"))
    (name,) = [f for f in (tmp_path / "out").iterdir() if f.suffix == ".blf"]
    content = name.read_bytes()
    got = list(blf.parse(content, "f"))
    assert [r[4] for r in got] == [r["id"] for r in rows] and [f.name for f in tmp_path.iterdir()] == ["out"]
    size, whole, objects = blf.FILE_HEADER.unpack_from(content)[10:13]
    assert (size, objects) == (len(content), 20_000) and whole > size


def test_other_objects(spark, tmp_path):
    out = blf._Out(START // 1_000_000 * 1_000_000, [], bytearray())
    out.add(blf.T_STATISTIC, START, blf.STATISTIC.pack(1, 250, 1, 2, 3, 4, 5, 6) + bytes(4))
    out.add(blf.T_TEXT, START + 1, blf.TEXT.pack(7, 0, 3) + b"abc")
    out.add(blf.T_COMMENT, START + 2, blf.COMMENT.pack(86, 2) + b"hi")
    out.add(blf.T_LOST_BEGIN, START + 3, blf.LOST_BEGIN.pack(9))
    out.add(blf.T_LOST_END, START + 4, blf.LOST_END.pack(9, 11, 12))
    out.add(*(lambda o: (o[0], START + 5, o[1]))(blf.object_of(_frames()[3])))
    content = out.close(START + 5)
    (tmp_path / "a.blf").write_bytes(content)
    rows = blf.read_blf(spark, str(tmp_path / "a.blf"), extras=True).orderBy("object_no").collect()
    assert [(r.kind, r.text) for r in rows] == [("statistic", None), ("text", "abc"), ("comment", "hi"), ("lost_begin", None), ("lost_end", None)]
    assert rows[0].numbers["bus_load"] == 250 and rows[4].numbers == {"queue": 9, "first_lost_ns": 11, "events": 12}
    assert len(list(blf.parse(content, "f"))) == 1


def _as_rows(df):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def _log(path, n, start=START):
    """A log whose objects straddle containers; payloads and texts hold false signatures, one text fills many containers."""
    rng = random.Random(n)
    out = blf._Out(start // 1_000_000 * 1_000_000, [], bytearray())
    for i in range(n):
        if i % 40 == 7:
            text = b"LOBJ" + bytes([rng.choice(b"LOBJ\x20\x01")]) * rng.randrange(9)
            out.add(blf.T_TEXT, start + i, blf.TEXT.pack(7, 0, len(text)) + text)
        elif i % 50 == 9:
            out.add(blf.T_MARKER, start + i, blf.marker_body("g", "LOBJ", f"id-{i}", i))
        elif i == n // 2:
            # an inner log that chains by itself, larger than a container and stored as it is
            inner = b"".join(blf.OBJECT.pack(b"LOBJ", 32, 1, 48, blf.T_CAN) + blf.OBJECT_V1.pack(2, 0, 0, k) + rng.randbytes(16) for k in range(9000))
            out.add(blf.T_TEXT, start + i, blf.TEXT.pack(1, 0, len(inner)) + inner)
        else:
            data = b"LOBJ\x10\x00\x01\x00" if i % 3 == 0 else rng.randbytes(8)
            out.add(*(lambda o, i=i: (o[0], start + i, o[1]))(blf.object_of(dict(_frames()[8], id=i % 2000, data=data))))
    content = out.close(start + n)
    path.write_bytes(content)
    return content


def test_ranges_of_one_file(spark, tmp_path):
    """One file read by many tasks gives the rows of one walk, wherever ranges are cut and whatever the payloads hold."""
    want, extras, marks = [], [], []
    for name, n in (("a.blf", 9000), ("b.blf", 2500)):
        content = _log(tmp_path / name, n)
        want += blf.parse(content, f"file:{tmp_path / name}")
        marks += blf.parse(content, f"file:{tmp_path / name}", markers=True)
        extras += blf.parse_extras(content, f"file:{tmp_path / name}")
    for size in (7_001, 40_000, 1 << 20):
        got = blf.read_blf(spark, str(tmp_path), range_bytes=size)
        assert got.rdd.getNumPartitions() > 1 or size == 1 << 20
        assert _as_rows(got) == want
    assert _as_rows(blf.read_blf(spark, str(tmp_path), markers=True, range_bytes=30_000)) == marks
    got = blf.read_blf(spark, str(tmp_path), extras=True, range_bytes=30_000).orderBy("file", "object_no").collect()
    assert [(r.object_no, r.kind, r.text) for r in got] == [(r[1], r[3], r[5]) for r in extras]
    blf.register(spark)
    plain = blf.read_blf(spark, str(tmp_path)).drop("file").exceptAll(spark.read.format("blf").option("range_bytes", "20000").load(str(tmp_path)).drop("file"))
    assert plain.isEmpty()
    split = spark.read.format("blf").option("range_bytes", "20000").load(str(tmp_path / "a.blf"))
    assert split.rdd.getNumPartitions() > 5


def test_stitched_guesses(spark, tmp_path):
    """Wrong guesses, even ones that chain, don't change what is read."""
    _log(tmp_path / "a.blf", 3000)
    ranges, _ = blf.file_ranges(spark, str(tmp_path / "a.blf"), 9_000)
    reports = next(blf._probed(iter(ranges.toArrow().combine_chunks().to_batches()))).to_pandas()
    right = blf._stitched(reports)
    wrong = reports.assign(at=reports["at"] + 16, skip=3, objects=5, tail=1)
    assert blf._stitched(wrong).equals(right) and len(right) > 3


def test_plain_guesses(spark, tmp_path):
    """On ordinary logs the probes guess right, so no range is walked again."""
    rng = random.Random(3)
    frames = [dict(_frames()[8], timestamp_ns=START + i, data=rng.randbytes(8)) for i in range(12_000)]
    (tmp_path / "a.blf").write_bytes(blf.build(frames)[0])
    ranges, _ = blf.file_ranges(spark, str(tmp_path / "a.blf"), 40_000)
    reports = next(blf._probed(iter(ranges.toArrow().combine_chunks().to_batches()))).to_pandas()
    both = reports.merge(blf._stitched(reports), on="part", suffixes=("", "_right")).query("part > 0")
    assert len(both) >= 3 and (both["at"] == both["at_right"]).all() and (both["skip"] == both["skip_right"]).all()


def test_beyond_a_cell(spark, tmp_path):
    """A file of over 2 GiB, which no binary cell holds (its head leaves a hole before the first container)."""
    content = bytearray(_log(tmp_path / "b.blf", 300))
    first = (1 << 31) + 12_345_680
    content[4:8] = first.to_bytes(4, "little")
    with (tmp_path / "big.blf").open("wb") as f:
        f.write(content[: blf.FILE_HEADER_SIZE])
        f.seek(first)
        f.write(content[blf.FILE_HEADER_SIZE :])
    got = blf.read_blf(spark, str(tmp_path / "big.blf"))
    want = blf.read_blf(spark, str(tmp_path / "b.blf"))
    assert got.drop("file").exceptAll(want.drop("file")).isEmpty() and got.count() == want.count() > 250
