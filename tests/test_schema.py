"""DBC parsing, catalogues and checksums (driver side)."""

import pytest

from busloom.functions.bits import positions
from busloom.functions.crc import CrcParams, crc, named
from busloom.operators.encode import get_bits, limits, physical_to_raw, put_bits
from busloom.operators.verify import ConfigError, resolve
from busloom.plans.catalog import Catalog, signal_identity, signal_path
from busloom.sources.dbc import CrcConfig, DbcError, Signal, crc_config, counter_config, parse_dbc

TEXT = """VERSION "t"
BO_ 256 Speed: 8 ECU1
 SG_ Fast : 0|16@1+ (0.01,0) [0|655.35] "km/h" GW
 SG_ Gear : 16|3@1+ (1,0) [0|7] "" GW
 SG_ Alive : 32|4@1+ (1,0) [0|15] "" GW
 SG_ Sum : 56|8@1+ (1,0) [0|255] "" GW

BO_ 2147484160 Wide: 16 Vector__XXX
 SG_ Sel M : 0|4@1+ (1,0) [0|3] "" GW
 SG_ A m0 : 8|16@1- (0.1,-40) [0|0] "degC" GW
 SG_ B m1 : 15|16@0+ (1,0) [0|0] "" GW
 SG_ Flow : 64|32@1+ (1,0) [0|0] "l/min" GW

CM_ BO_ 256 "say ""BO_"" here";
BA_DEF_ BO_ "GenMsgSendType" ENUM "Cyclic","OnEvent";
BA_ "GenMsgCycleTime" BO_ 256 0;
BA_ "GenMsgSendType" BO_ 256 1;
BA_ "AcmeCounter" SG_ 256 Alive "increment=3;rollover=13";
BA_ "AcmeCrc" SG_ 256 Sum "alg=CRC-8/BLUETOOTH;range=8:48;prefix=0C71";
BA_ "AcmeDisplay" SG_ 256 Sum "radix=hex";
BA_ "AcmeDisplay" SG_ 256 Fast "radix=hex";
VAL_ 256 Gear 0 "P" 1 "R";
SIG_VALTYPE_ 2147484160 Flow : 1;
"""


def test_parse():
    d = parse_dbc(TEXT.replace('""BO_""', "BO_"), "t")
    speed, wide = d.messages
    assert (speed.id, speed.extended, speed.cycle_ms, speed.send_type, speed.fd) == (256, False, 0, "OnEvent", False)
    assert (wide.id, wide.extended, wide.fd, wide.brs, wide.transmitter) == (512, True, True, True, "")
    assert speed.counter == counter_config("Alive", "rollover=13;increment=3")
    assert speed.crc == CrcConfig("Sum", "CRC-8/BLUETOOTH", 8, 48, b"\x0c\x71")
    assert speed.signal("Sum").hex and not speed.signal("Fast").hex and len(d.warnings) == 1
    assert speed.signal("Gear").is_enum and wide.multiplexor.name == "Sel" and wide.signal("Flow").is_float
    assert speed.signal("Fast").decimals == 2 and wide.signal("Flow").decimals is None


def test_bad_texts():
    with pytest.raises(DbcError):
        parse_dbc("hello")
    for text in ("alg=CRC-8/SAE-J1850", "width=8;range=0:8", "alg=X;poly=1;range=0:8", "what=1"):
        with pytest.raises(ValueError):
            crc_config("s", text)
    with pytest.raises(ValueError):
        counter_config("s", "increment=1;increment=2")


def test_catalog_order():
    d = parse_dbc(TEXT, "a")
    other = parse_dbc(TEXT.replace("Speed", "Other"), "b")
    c = Catalog().add(d, ["x", "y"]).add(other, ["y"])
    assert c.find("y", 256, False).name == "Speed" and c.find(None, 256, False) is None and c.find("x", 256, True) is None
    assert [x["bus_id"] for x in c.collisions()] == ["y", "y"]
    assert c.fingerprint("x", 256, False, "Fast") != c.fingerprint("y", 256, False, "Fast")
    assert signal_path("b", None, "m", "s") == "b//m/s" and signal_identity(None, 5, True, "n") == "*|x:5:n"


def test_named_checksums():
    assert len(named()) == 112
    assert [n for n, (p, check) in named().items() if crc(b"123456789", p) != check] == []
    assert crc(b"", CrcParams(8, 0x1D, 0xFF, xorout=0xFF)) == 0
    with pytest.raises(ValueError):
        CrcParams(65, 1)


def test_bit_positions():
    assert positions(0, 16, True) == list(range(16))
    assert positions(7, 16, False) == [8, 9, 10, 11, 12, 13, 14, 15, 0, 1, 2, 3, 4, 5, 6, 7]
    assert positions(0, 65, True) is None and positions(0, 0, True) is None


def _s(**k):
    return Signal(**({"name": "s", "start": 0, "size": 8, "little": True, "signed": False, "factor": 1.0, "offset": 0.0, "minimum": 0, "maximum": 0, "unit": ""} | k))


def test_encode_rounding():
    assert physical_to_raw(_s(), 2.5) == (3, False)
    assert physical_to_raw(_s(signed=True), -2.5) == (253, False)
    assert physical_to_raw(_s(), 300) == (255, True)
    assert physical_to_raw(_s(), float("nan")) == (255, True) and physical_to_raw(_s(signed=True), float("-inf")) == (127, True)
    assert limits(_s(signed=True, size=4)) == (-8, 7)


@pytest.mark.parametrize("start,size,little", [(0, 8, True), (3, 13, True), (7, 16, False), (12, 11, False), (0, 64, True), (7, 64, False)])
def test_put_get(start, size, little):
    s = _s(start=start, size=size, little=little)
    for raw in (0, 1, (1 << size) - 1, 0x5A5A5A5A5A5A5A5A & (1 << size) - 1):
        for fill in (0, 255):
            b = bytearray([fill]) * 8
            assert put_bits(b, s, raw) and get_bits(b, s) == raw
    assert not put_bits(bytearray(1), _s(start=8), 1)


def test_resolve_errors():
    m = parse_dbc(TEXT).messages[0]
    for crc_ in (CrcConfig("Sum", "CRC-16/ARC", 0, 56), CrcConfig("Sum", "CRC-8/SAE-J1850", 0, 64), CrcConfig("Sum", "CRC-8/SAE-J1850", 4, 8), CrcConfig("Sum", "nope", 0, 8)):
        with pytest.raises(ConfigError):
            resolve(m, None, crc_)
