"""MDF files: round trips, and the shapes that our writer does not make."""

import struct
import zlib

import numpy as np
import pytest

from busloom.sources import mdf4

from .test_sources import START, _frames


def _order(rows):
    return sorted(rows, key=lambda r: (r[2], r[0], r[1]))


def test_round_trip():
    frames = _frames()
    signals = [{"name": "Torque", "unit": "Nm", "points": [(START + i * 10**7, i * 1.5) for i in range(5)]}]
    content = mdf4.build(frames, signals, [{"timestamp_ns": START + 5, "label": "here", "comment": "c"}], [("a.dbc", b"VERSION")])
    f = mdf4.File(content)
    want = sorted(frames, key=lambda r: (r["timestamp_ns"], ("error", "remote").index(r["kind"]) if r["kind"] in ("error", "remote") else -1))
    got = _order(f.frame_rows())
    assert [r[2] for r in got] == [w["timestamp_ns"] for w in want]
    assert [r[3:11] for r in got] == [tuple(w[k] for k in ("channel", "id", "extended", "direction", "kind", "data", "brs", "esi")) for w in want]
    assert [r[6] for r in f.signal_rows()] == [0.0, 1.5, 3.0, 4.5, 6.0] and [r[5] for r in f.signal_rows()][1] == START + 10**7
    assert list(f.event_rows()) == [(START + 5, "here", "c")] and list(f.attachment_rows()) == [("a.dbc", "application/octet-stream", b"VERSION")]
    assert [r[2:5] for r in f.group_rows()] == [("data", 2, 21), ("error", 2, 1), ("remote", 2, 1), ("signal", 2, 5)]


def test_compressed_and_listed():
    content = bytearray(mdf4.build(_frames()))
    at = content.index(b"##DT")
    size = struct.unpack_from("<Q", content, at + 8)[0]
    data = bytes(content[at + 24 : at + size])
    step = len(data) // 21
    b = mdf4._Blocks()
    b.out = content
    parts = []
    for piece, method in ((data[: 10 * step], 0), (data[10 * step :], 1)):
        plain = piece
        if method:
            rows = len(piece) // step
            plain = bytes(piece[r * step + c] for c in range(step) for r in range(rows))
        packed = zlib.compress(plain)
        parts.append(b.add(b"##DZ", [], mdf4.DZ.pack(b"DT", method, step if method else 0, len(piece), len(packed)) + packed))
    dl = b.add(b"##DL", [0, *parts], struct.pack("<B3xIQQ", 0, 2, 0, 10 * step))
    hl = b.add(b"##HL", [dl], struct.pack("<HB5x", 0, 0))
    dg = content.index(b"##DG")
    b.link(dg, 2, hl)
    assert len(list(mdf4.File(bytes(b.out)).frame_rows())) == 23


def test_unfinalized_and_damaged():
    content = bytearray(mdf4.build(_frames()[:20]))
    content[:8] = b"UnFinMF "
    assert len(list(mdf4.File(bytes(content)).frame_rows())) == 20
    with pytest.raises(mdf4.MdfError):
        mdf4.File(b"x" * 100)


def _unsorted(path, n, unknown_at=None):
    """An unsorted file: classic and FD frames under record ids in two data blocks, values of variable length between."""
    frames = [dict(_frames()[8], idx=i, timestamp_ns=START + i * 1000, id=i % 500, data=bytes([i % 256, i // 256 % 256] * 4)) for i in range(n)]
    content = bytearray(mdf4.build(frames[:1]))
    b = mdf4._Blocks()
    b.out = content
    cg = content.index(b"##CG")
    size = mdf4.CG.unpack_from(content, cg + 24 + 48)[4]
    mdf4.CG.pack_into(content, cg + 24 + 48, 7, 0, 6, ord("."), size, 0)
    other = b.add(b"##CG", [0] * 6, mdf4.CG.pack(9, 0, 1, 0, 4, 0))
    b.link(cg, 0, other)

    def record(f):
        return b"\x07" + struct.pack("<dBIBB", (f["timestamp_ns"] - START) / 1e9, f["channel"] + 1, f["id"], 8, 8) + f["data"] + b"\x09" + struct.pack("<L", f["idx"] % 7) + bytes(f["idx"] % 7)

    parts = [b"".join(map(record, frames[: n // 3])), b"".join(map(record, frames[n // 3 :]))]
    if unknown_at is not None:
        parts[0] = b"".join(map(record, frames[:unknown_at])) + b"\x55" * 40
        frames = frames[:unknown_at] + frames[n // 3 :]
    blocks = [b.add(b"##DT", [], parts[0])]
    packed = zlib.compress(parts[1])
    blocks.append(b.add(b"##DZ", [], mdf4.DZ.pack(b"DT", 0, 0, len(parts[1]), len(packed)) + packed))
    dl = b.add(b"##DL", [0, *blocks], struct.pack("<B3xIQQ", 0, 2, 0, len(parts[0])))
    dg = content.index(b"##DG")
    b.link(dg, 2, dl)
    b.out[dg + 24 + 32] = 1  # size of the record ids
    path.write_bytes(bytes(b.out))
    return frames


def test_ranges_of_one_file(spark, tmp_path):
    """Sorted, deflated and unsorted files read by many tasks give the rows of one walk."""
    frames = [dict(_frames()[i % 23], timestamp_ns=START + i * 1000, id=i) for i in range(4000)]
    signals = [{"name": "S", "unit": "V", "points": [(START + i, i / 8) for i in range(3000)]}]
    (tmp_path / "a.mf4").write_bytes(mdf4.build(frames, signals))
    path = str(tmp_path / "a.mf4")
    for size in (3_000, 100_000):
        got = mdf4.read_mdf(spark, path, range_bytes=size)
        rows = sorted(tuple(r)[1:] for r in got.collect())
        assert rows == sorted(mdf4.File(path).frame_rows()) and len(rows) == 4000
    assert got.rdd.getNumPartitions() > 1
    rows = mdf4.read_mdf(spark, path, "signals", range_bytes=5_000).collect()
    assert sorted(r.value for r in rows) == [i / 8 for i in range(3000)] and {(r.unit, r.name) for r in rows} == {("V", "S")}
    frames = _unsorted(tmp_path / "u.mf4", 3000)
    for size in (2_000, 1 << 20):
        rows = mdf4.read_mdf(spark, str(tmp_path / "u.mf4"), range_bytes=size).orderBy("record_no").collect()
        assert [r.record_no for r in rows] == list(range(3000))
        assert [(r.timestamp_ns, r.id, bytes(r.data)) for r in rows] == [(f["timestamp_ns"], f["id"], f["data"]) for f in frames]
    census = {r.group: r.records for r in mdf4.read_mdf(spark, str(tmp_path / "u.mf4"), "groups", range_bytes=2_000).collect()}
    assert census == {0: 3000, 1: 0, 2: 0}
    assert len(list(mdf4.File(str(tmp_path / "u.mf4")).frame_rows())) == 3000


def test_unknown_record_id(spark, tmp_path):
    """An id that no group has ends its data block; the next block is read."""
    frames = _unsorted(tmp_path / "u.mf4", 900, unknown_at=100)
    rows = mdf4.read_mdf(spark, str(tmp_path / "u.mf4"), range_bytes=1_000).orderBy("record_no").collect()
    assert [r.id for r in rows] == [f["id"] for f in frames] and len(rows) == 700


def test_fields():
    """Bit fields of every order, sign and width against whole-number arithmetic."""
    rng = np.random.default_rng(2)
    records = rng.integers(0, 256, (40, 20), dtype=np.uint8)
    for _ in range(300):
        kind = int(rng.integers(0, 4))
        bit, bits, byte = int(rng.integers(0, 8)), int(rng.integers(1, 65)), int(rng.integers(0, 12))
        c = mdf4.Channel("c", 0, kind, bit, byte, bits, "", None, None)
        got = mdf4.raw(records, c)
        size = (bit + bits + 7) // 8
        if byte + size > 20:
            assert got is None
            continue
        for r, v in zip(records, got, strict=True):
            whole = int.from_bytes(r[byte : byte + size].tobytes(), "little" if kind in (0, 2) else "big") >> bit & (1 << bits) - 1
            assert int(v) == (whole - (1 << bits) if kind > 1 and whole >> (bits - 1) else whole)


def _merged(groups):
    """A merge that takes the group whose next time is earliest, ties to the first group."""
    heads, out = [0] * len(groups), []
    while True:
        ready = [(g[heads[i]], i) for i, g in enumerate(groups) if heads[i] < len(g)]
        if not ready:
            return out
        _, i = min(ready)
        out.append((i, heads[i]))
        heads[i] += 1


def test_emission_order(spark):
    """Groups whose times fall back come out as a merge by next frames gives them."""
    rng = np.random.default_rng(4)
    groups = [sorted(rng.integers(0, 50, 80).tolist(), reverse=True), np.sort(rng.integers(0, 50, 90)).tolist(), rng.integers(0, 50, 200).tolist(), [7]]
    rows = [("f", g, n, t) for g, times in enumerate(groups) for n, t in enumerate(times)]
    frames = spark.createDataFrame(rows, "file string, group int, record_no long, timestamp_ns long").repartition(5)
    got = [(r["group"], r.record_no) for r in mdf4.emission_order(frames).collect()]
    assert got == _merged(groups)


def test_spark(spark, tmp_path):
    path = tmp_path / "a.mf4"
    path.write_bytes(mdf4.build(_frames(), [{"name": "S", "points": [(START, 1.0)]}]))
    assert mdf4.read_mdf(spark, str(path)).count() == 23
    (c,) = mdf4.mdf_census(spark, str(path)).collect()
    assert (c.channels, c.frames, c.signal_groups, c.samples) == ([0, 1, 2], 23, 1, 1)


def test_parallel_save(spark, tmp_path):
    """Blocks written by several tasks make one file that reads as what one build of all frames gives."""
    frames = [dict(_frames()[i % 23], idx=i, timestamp_ns=START + i * 1000, id=i % 2000) for i in range(3000)]
    schema = "idx long, timestamp_ns long, channel int, id long, extended boolean, direction string, kind string, data binary, brs boolean, esi boolean, dlc int"
    df = spark.createDataFrame([tuple(f[k] for k in f) for f in frames], schema).repartition(5)
    more = {"signals": [{"name": "S", "points": [(START + 9, 1.5)]}], "events": [{"timestamp_ns": START + 5, "label": "x"}], "attachments": [("a.dbc", b"VERSION")]}
    mdf4.save_mdf(df, str(tmp_path / "out"), **more)
    (name,) = (tmp_path / "out").iterdir()
    got, want = mdf4.File(str(name)), mdf4.File(mdf4.build(frames, **more))
    assert list(got.frame_rows()) == list(want.frame_rows()) and list(got.signal_rows()) == list(want.signal_rows())
    assert list(got.event_rows()) == list(want.event_rows()) and list(got.attachment_rows()) == list(want.attachment_rows()) and list(got.group_rows()) == list(want.group_rows())
    assert [f.name for f in tmp_path.iterdir()] == ["out"] and name.read_bytes().count(b"##DL") == 3
    assert mdf4.read_mdf(spark, str(tmp_path / "out"), range_bytes=9_000).count() == 3000
    mdf4.save_mdf(df.limit(0), str(tmp_path / "none"))
    assert mdf4.read_mdf(spark, str(tmp_path / "none")).count() == 0
