"""Bit fields of payloads as Column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positions(start: int, size: int, little: bool) -> list[int] | None:
    """Absolute bit numbers (byte * 8 + bit, bit 0 least significant) from the field's least significant bit up.

    Little-endian fields rise from start. Big-endian fields start at their most significant bit and fall within a byte,
    then go on at bit 7 of the next byte. None for sizes outside 1..64.
    """
    if not 1 <= size <= 64:
        return None
    if little:
        return [start + i for i in range(size)]
    out, at = [], start
    for _ in range(size):
        out.append(at)
        at = at - 1 if at % 8 else at + 15
    return out[::-1]


def runs(start: int, size: int, little: bool) -> list[tuple[int, int, int, int]] | None:
    """(byte, lowest bit, width, position in the value) of each byte's part of the field."""
    bits = positions(start, size, little)
    if bits is None:
        return None
    out: list[list[int]] = []
    for value_bit, b in enumerate(bits):
        if out and out[-1][0] == b // 8 and out[-1][1] + out[-1][2] == b % 8:
            out[-1][2] += 1
        else:
            out.append([b // 8, b % 8, 1, value_bit])
    return [tuple(r) for r in out]


def word(data: Column, k: int) -> Column:
    """Bytes 4k..4k+3 as an unsigned big-endian number; bytes past the end count as 0."""
    part = F.rpad(F.hex(F.substring(data, 4 * k + 1, 4)), 8, "0")
    return F.conv(part, 16, 10).cast("long")


def words_of(data: Column, fields: list[tuple[int, int, bool]]) -> Column:
    """The payload's length in bytes, then all words that fields (start, size, little) reach into."""
    count = max((byte // 4 + 1 for f in fields for byte, *_ in runs(*f) or ()), default=0)
    return F.array(F.length(data).cast("long"), *[word(data, k) for k in range(count)])


def raw_bits(data: Column, start: int, size: int, little: bool, words: Column | None = None) -> Column:
    """The field's bits as a LONG (bit pattern); null if the payload lacks one of its bytes or the size is unusable.
    With `words` (a column of words_of) the payload itself is not read."""
    parts = runs(start, size, little)
    if parts is None:
        return F.lit(None).cast("long")
    needed = sorted({byte // 4 for byte, *_ in parts})
    word_at = {k: word(data, k) if words is None else F.get(words, k + 1) for k in needed}
    value = None
    for byte, low, width, at in parts:
        shift = 8 * (3 - byte % 4) + low
        bits = F.shiftright(word_at[byte // 4], shift).bitwiseAND(F.lit((1 << width) - 1))
        bits = F.shiftleft(bits, at) if at else bits
        value = bits if value is None else value.bitwiseOR(bits)
    last = max(byte for byte, *_ in parts)
    return F.when((F.length(data) if words is None else F.get(words, 0)) > last, value)


def sign_extend(value: Column, size: int) -> Column:
    return value if size >= 64 else F.shiftright(F.shiftleft(value, 64 - size), 64 - size)


def unsigned(value: Column, size: int) -> Column:
    """The bit pattern as a double; 64-bit patterns above the largest LONG through decimals."""
    if size < 64:
        return value.cast("double")
    wide = value.cast("decimal(20,0)")
    return F.when(value >= 0, wide).otherwise(wide + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("double")


def ieee(value: Column, size: int) -> Column:
    """The bit pattern of an IEEE 754 single (size 32) or double (size 64) as a double, by arithmetic."""
    fraction_bits, exponent_bits = (23, 8) if size == 32 else (52, 11)
    bias = (1 << (exponent_bits - 1)) - 1
    fraction = value.bitwiseAND(F.lit((1 << fraction_bits) - 1)).cast("double")
    exponent = F.shiftrightunsigned(value, fraction_bits).bitwiseAND(F.lit((1 << exponent_bits) - 1))
    sign = F.when(F.shiftrightunsigned(value, size - 1).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    unit = float(1 << fraction_bits)
    # powers of two in two factors, so that neither overflows nor underflows
    scale = F.when(exponent == 0, 1 - bias).otherwise(exponent - bias)
    half = F.floor(scale / 2)
    mantissa = fraction / unit + F.when(exponent == 0, 0.0).otherwise(1.0)
    normal = mantissa * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), scale - half)
    top = (1 << exponent_bits) - 1
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == top, special).otherwise(normal)
