"""DBC schema files: message and signal definitions on the driver.

Only what decoding, encoding and catalogues need is kept. Statements of other kinds are skipped. Calculated fields and
display hints are read from string attributes whose names end in Counter, Crc or Display behind a capitalised vendor
prefix; malformed values are warnings and the file still loads.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from ..functions.crc import CrcParams

EXTENDED_BIT = 1 << 31


@dataclass(frozen=True)
class CounterConfig:
    signal: str
    increment: int = 1
    rollover: int | None = None


@dataclass(frozen=True)
class CrcConfig:
    signal: str
    algorithm: str | CrcParams
    first_bit: int
    bits: int
    prefix: bytes = b""


@dataclass(frozen=True)
class Signal:
    name: str
    start: int
    size: int
    little: bool
    signed: bool
    factor: float
    offset: float
    minimum: float
    maximum: float
    unit: str
    #: None (plain), "M" (multiplexor) or the selector value it is sent under
    mux: str | int | None = None
    #: int, f32 or f64
    kind: str = "int"
    values: tuple[tuple[int, str], ...] = ()
    comment: str = ""
    start_value: float | None = None
    attributes: tuple[tuple[str, str], ...] = ()
    hex: bool = False

    @property
    def is_float(self) -> bool:
        """Float kinds count only at their own width."""
        return (self.kind, self.size) in (("f32", 32), ("f64", 64))

    @property
    def is_enum(self) -> bool:
        return len(self.values) >= 2

    @property
    def is_raw_field(self) -> bool:
        """An unscaled integer without unit or value table."""
        return not self.is_float and self.factor == 1 and self.offset == 0 and not self.unit and not self.is_enum

    @property
    def decimals(self) -> int | None:
        """Smallest d in 0..9 with factor and offset times 10^d integral (to 1e-12 relative), else None."""
        if self.is_float:
            return None
        for d in range(10):
            if all(abs(x * 10**d - round(x * 10**d)) <= 1e-12 * max(1.0, abs(x * 10**d)) for x in (self.factor, self.offset)):
                return d
        return None


@dataclass(frozen=True)
class Message:
    id: int
    extended: bool
    name: str
    length: int
    transmitter: str
    signals: tuple[Signal, ...] = ()
    fd: bool = False
    brs: bool = False
    cycle_ms: int | None = None
    send_type: str | None = None
    comment: str = ""
    attributes: tuple[tuple[str, str], ...] = ()
    counter: CounterConfig | None = None
    crc: CrcConfig | None = None

    @property
    def multiplexor(self) -> Signal | None:
        return next((s for s in self.signals if s.mux == "M"), None)

    def signal(self, name: str) -> Signal | None:
        return next((s for s in self.signals if s.name == name), None)


@dataclass(frozen=True)
class Database:
    name: str
    messages: tuple[Message, ...]
    warnings: tuple[str, ...] = field(default=())

    def find(self, can_id: int, extended: bool) -> Message | None:
        return next((m for m in self.messages if m.id == can_id and m.extended == extended), None)


class DbcError(ValueError):
    """A text that is no DBC file."""


_NUM = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_MESSAGE = re.compile(r"BO_\s+(\d+)\s+(\w+)\s*:\s*(\d+)\s+(\w+)")
_SIGNAL = re.compile(
    rf"SG_\s+(\w+)\s*(M|m\d+M?)?\s*:\s*(\d+)\|(\d+)@([01])([+-])\s*\(({_NUM}),({_NUM})\)\s*\[({_NUM})\|({_NUM})\]\s*\"([^\"]*)\""
)
_TEXT = r'"((?:[^"\\]|\\.)*)"'
_COMMENT = re.compile(rf"CM_\s+(BO_|SG_)\s+(\d+)\s+(?:(\w+)\s+)?{_TEXT}\s*;", re.S)
_VALUES = re.compile(rf"^\s*VAL_\s+(\d+)\s+(\w+)\s+((?:-?\d+\s+{_TEXT}\s*)*);", re.M)
_PAIR = re.compile(rf"(-?\d+)\s+{_TEXT}")
_FLOAT = re.compile(r"^\s*SIG_VALTYPE_\s+(\d+)\s+(\w+)\s*:?\s*([0-3])\s*;", re.M)
_ENUM = re.compile(r'^\s*BA_DEF_\s+BO_\s+"GenMsgSendType"\s+ENUM\s+([^;]*);', re.M)
_ATTRIBUTE = re.compile(rf'^\s*BA_\s+"(\w+)"\s+(BO_|SG_)\s+(\d+)\s+(?:([A-Za-z_]\w*)\s+)?({_NUM}|{_TEXT})\s*;', re.M)
_VENDOR = re.compile(r"[A-Z][a-z]+(Counter|Crc|Display)")


def pairs(text: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        key, eq, value = (x.strip() for x in part.partition("="))
        if not eq:
            raise ValueError(f'expected key=value, got "{part}"')
        if key in dict(out):
            raise ValueError(f'duplicate key "{key}"')
        out.append((key, value))
    return out


def _number(text: str) -> int:
    value = int(text, 16) if text.lower().startswith("0x") else int(text)
    if value < 0:
        raise ValueError(f"negative number {text}")
    return value


def _flag(text: str) -> bool:
    known = {"0": False, "1": True, "false": False, "true": True}
    if text.lower() not in known:
        raise ValueError(f'"{text}" is no flag')
    return known[text.lower()]


def counter_config(signal: str, text: str) -> CounterConfig:
    """`increment=1;rollover=15`; both keys may be left out."""
    given = dict(pairs(text))
    if extra := set(given) - {"increment", "rollover"}:
        raise ValueError(f"unknown counter key {sorted(extra)}")
    rollover = given.get("rollover")
    return CounterConfig(signal, _number(given.get("increment", "1")), None if rollover is None else _number(rollover))


def crc_config(signal: str, text: str) -> CrcConfig:
    """A named algorithm (`alg=`) or raw parameters, with a bit range and an optional hex prefix."""
    given = dict(pairs(text))
    raw = {"width", "poly", "init", "refin", "refout", "xorout"}
    if extra := set(given) - raw - {"alg", "range", "prefix"}:
        raise ValueError(f"unknown checksum key {sorted(extra)}")
    if "alg" in given and raw & set(given):
        raise ValueError("a named algorithm excludes raw parameters")
    if "alg" in given:
        algorithm: str | CrcParams = given["alg"]
    elif {"width", "poly"} <= set(given):
        n = {k: _number(given.get(k, "0")) for k in ("width", "poly", "init", "xorout")}
        algorithm = CrcParams(n["width"], n["poly"], n["init"], _flag(given.get("refin", "0")), _flag(given.get("refout", "0")), n["xorout"])
    else:
        raise ValueError("raw parameters need width and poly")
    if "range" not in given:
        raise ValueError("a bit range start:length is required")
    first, _, bits = given["range"].partition(":")
    prefix = "".join(given.get("prefix", "").replace("0x", "").split())
    return CrcConfig(signal, algorithm, _number(first), _number(bits), bytes.fromhex(prefix))


def _unquote(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def _integer(value: str | None) -> int | None:
    try:
        return int(float(value)) if value is not None and not value.startswith('"') else None
    except ValueError:
        return None


def parse_dbc(text: str, name: str = "") -> Database:
    if "BO_" not in text and "VERSION" not in text:
        raise DbcError("neither a version nor a message")
    comments = {(m[1], m[2], m[3]): _unquote(m[4]) for m in _COMMENT.finditer(text)}
    body = _COMMENT.sub("", text)
    values = {(m[1], m[2]): tuple((int(a), _unquote(b)) for a, b in _PAIR.findall(m[3])) for m in _VALUES.finditer(body)}
    floats = {(m[1], m[2]): {"1": "f32", "2": "f64"}.get(m[3], "int") for m in _FLOAT.finditer(body)}
    labels = [_unquote(x) for x in re.findall(_TEXT, m[1])] if (m := _ENUM.search(body)) else None
    attributes: dict[tuple[str, str | None], dict[str, str]] = {}
    for m in _ATTRIBUTE.finditer(body):
        attributes.setdefault((m[3], m[4] if m[2] == "SG_" else None), {}).setdefault(m[1], m[5])
    plain = lambda v: _unquote(v[1:-1]) if v.startswith('"') else v
    messages: list[Message] = []
    warnings: list[str] = []
    seen: set[int] = set()
    for block in re.split(r"^(?=[ \t]*BO_[ \t])", body, flags=re.M)[1:]:
        head = _MESSAGE.match(block.lstrip())
        if not head:
            raise DbcError(f"bad message line: {block.strip().splitlines()[0][:80]}")
        key = head[1]
        if int(key) in seen:
            continue
        seen.add(int(key))
        signals = []
        for line in block.splitlines():
            if not line.strip().startswith("SG_ "):
                continue
            g = _SIGNAL.match(line.strip())
            if not g:
                raise DbcError(f"bad signal line: {line.strip()[:80]}")
            mux = None if not g[2] else "M" if g[2] == "M" else int(g[2].strip("mM"))
            own = attributes.get((key, g[1]), {})
            start_value = own.get("GenSigStartValue")
            signals.append(
                Signal(
                    name=g[1], start=int(g[3]), size=int(g[4]), little=g[5] == "1", signed=g[6] == "-",
                    factor=float(g[7]), offset=float(g[8]), minimum=float(g[9]), maximum=float(g[10]), unit=g[11],
                    mux=mux, kind=floats.get((key, g[1]), "int"), values=values.get((key, g[1]), ()),
                    comment=comments.get(("SG_", key, g[1]), ""),
                    start_value=None if start_value is None or start_value.startswith('"') else float(start_value),
                    attributes=tuple(sorted((k, plain(v)) for k, v in own.items())),
                )
            )
        own = attributes.get((key, None), {})
        frame_format, brs = _integer(own.get("VFrameFormat")), _integer(own.get("GenMsgCANFDBRS"))
        fd = frame_format in (14, 15) if frame_format is not None else int(head[3]) > 8
        send = own.get("GenMsgSendType")
        at = _integer(send)
        if send is not None:
            send = plain(send) if send.startswith('"') or labels is None or at is None or not 0 <= at < len(labels) else labels[at]
        cycle = _integer(own.get("GenMsgCycleTime"))
        message = Message(
            id=int(key) & ~EXTENDED_BIT, extended=bool(int(key) & EXTENDED_BIT), name=head[2], length=int(head[3]),
            transmitter="" if head[4] == "Vector__XXX" else head[4], signals=tuple(signals), fd=fd,
            brs=fd and (brs is None or brs != 0), cycle_ms=cycle if cycle is None or cycle >= 0 else None, send_type=send,
            comment=comments.get(("BO_", key, None), ""), attributes=tuple(sorted((k, plain(v)) for k, v in own.items())),
        )
        messages.append(_with_hints(message, warnings))
    return Database(name, tuple(messages), tuple(warnings))


def _with_hints(message: Message, warnings: list[str]) -> Message:
    counter, checksum, signals = None, None, []
    for s in message.signals:
        shown = False
        for name, value in s.attributes:
            hint = _VENDOR.fullmatch(name)
            if not hint or not value:
                continue
            at = f"{message.name}.{s.name}"
            try:
                if hint[1] == "Counter":
                    found = counter_config(s.name, value)
                    if counter is None:
                        counter = found
                    else:
                        warnings.append(f"{at}: second counter ignored")
                elif hint[1] == "Crc":
                    found = crc_config(s.name, value)
                    if checksum is None:
                        checksum = found
                    else:
                        warnings.append(f"{at}: second checksum ignored")
                else:
                    given = dict(pairs(value))
                    if set(given) - {"radix"} or given.get("radix", "dec") not in ("hex", "dec"):
                        raise ValueError(f"bad display hint {value}")
                    if given.get("radix") == "hex":
                        shown = s.is_raw_field
                        if not shown:
                            warnings.append(f"{at}: hexadecimal display ignored, as it is no raw integer field")
            except ValueError as e:
                warnings.append(f"{at}: {e}")
        signals.append(replace(s, hex=shown) if shown else s)
    return replace(message, signals=tuple(signals), counter=counter, crc=checksum)
