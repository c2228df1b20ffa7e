"""Batched payload work against the scalar forms."""

import random

import numpy as np
import pyarrow as pa
import pytest

from busloom.functions import crc, payloads
from busloom.functions.bits import runs
from busloom.operators import encode

from .test_schema import _s


def test_matrix_round_trip():
    rng = random.Random(1)
    given = [None, b"", *(rng.randbytes(rng.randrange(65)) for _ in range(50)), None]
    for array in (pa.array(given, pa.binary()), pa.array([b"x" * 9, *given], pa.binary())[1:], pa.array(given, pa.large_binary()), pa.array([], pa.binary())):
        rows, length = payloads.matrix(array, 3)
        assert payloads.binary(rows, length).to_pylist() == [x or b"" for x in array.to_pylist()]
    assert payloads.matrix(pa.array([None, None], pa.binary()), 0)[0].shape == (2, 0)


@pytest.mark.parametrize("name", sorted(crc.named()))
def test_checksums(name):
    rng = random.Random(2)
    p, check = crc.named()[name]
    rows = np.frombuffer(rng.randbytes(20 * 11), np.uint8).reshape(20, 11)
    assert [int(x) for x in crc.crc_rows(rows, p, b"\xa3\x00")] == [crc.crc(b"\xa3\x00" + r.tobytes(), p) for r in rows]
    assert int(crc.crc_rows(np.frombuffer(b"123456789", np.uint8)[None], p)[0]) == check


def test_packing():
    rng = random.Random(3)
    for _ in range(200):
        signal = _s(start=rng.randrange(64), size=rng.randint(1, 64), little=rng.random() < 0.5, signed=rng.random() < 0.5, factor=rng.choice([1.0, 0.1, -2.0, 0.0]), offset=rng.choice([0.0, -40.0, 0.5]))
        values = [0.0, -1.0, 0.5, -0.5, 2.5, 1e3, -1e3, 1e30, -1e30, float("nan"), float("inf"), float("-inf"), 2.0**63, -(2.0**63), 2.0**64, rng.uniform(-9e18, 9e18), rng.uniform(-100, 100)]
        raw = encode.raw_rows(signal, np.array(values))
        assert [int(x) for x in raw] == [encode.physical_to_raw(signal, v)[0] for v in values], signal
        data = [rng.randbytes(rng.randrange(17)) for _ in values]
        rows, length = payloads.matrix(pa.array(data), 2)
        where = np.array([rng.random() < 0.8 for _ in values])
        done = payloads.put(rows, length, runs(signal.start, signal.size, signal.little), raw, where)
        for k, d in enumerate(data):
            buffer = bytearray(d)
            assert bool(done[k]) == bool(where[k] and encode.put_bits(buffer, signal, int(raw[k])))
            assert rows[k, : length[k]].tobytes() == bytes(buffer)


def test_float_fields():
    for size in (32, 64):
        signal = _s(size=size, kind="f32" if size == 32 else "f64", factor=2.0, offset=1.0)
        values = [0.0, -1.5, 1e300, -1e300, float("inf"), 1e-40, float("nan")]
        assert [int(x) for x in encode.raw_rows(signal, np.array(values))] == [encode.physical_to_raw(signal, v)[0] for v in values]
