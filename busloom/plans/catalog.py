"""Databases in load order with their buses: catalogues, first-match winners, collisions, fingerprints.

A catalogue lives on the driver (it is schema, not data); its tables become small DataFrames for joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.dbc import Database, Message, Signal


@dataclass(frozen=True)
class Loaded:
    database: Database
    #: a database decodes frames of these buses only
    buses: tuple[str, ...] = ()


@dataclass
class Catalog:
    loaded: list[Loaded] = field(default_factory=list)

    def add(self, database: Database, buses: Iterable[str]) -> Catalog:
        """A database of the same name is replaced in place."""
        entry = Loaded(database, tuple(buses))
        for i, known in enumerate(self.loaded):
            if known.database.name == database.name:
                self.loaded[i] = entry
                return self
        self.loaded.append(entry)
        return self

    def applicable(self, bus: str | None) -> list[Database]:
        return [x.database for x in self.loaded if bus is not None and bus in x.buses]

    def buses(self) -> list[str]:
        return sorted({b for x in self.loaded for b in x.buses})

    def winners(self) -> Iterator[tuple[str, Message, int]]:
        """(bus, message, load order): per (bus, id, extended) the first database that knows the id."""
        for bus in self.buses():
            seen: set[tuple[int, bool]] = set()
            for order, x in enumerate(self.loaded):
                if bus not in x.buses:
                    continue
                for m in x.database.messages:
                    if (m.id, m.extended) not in seen:
                        seen.add((m.id, m.extended))
                        yield bus, m, order

    def find(self, bus: str | None, can_id: int, extended: bool) -> Message | None:
        return next((m for d in self.applicable(bus) if (m := d.find(can_id, extended))), None)

    def chain(self, bus: str, can_id: int, extended: bool, name: str) -> list[tuple[Message, Signal]]:
        """The databases' definitions of a signal in load order: the first that yields a value for a frame counts."""
        out = []
        for d in self.applicable(bus):
            m = d.find(can_id, extended)
            if m and (s := m.signal(name)):
                out.append((m, s))
        return out

    def descriptors(self) -> list[dict]:
        """The signals of every bus: sorted and unique by (bus, id, extended, signal), the first database wins."""
        rows: dict[tuple, dict] = {}
        for bus in self.buses():
            for d in self.applicable(bus):
                for m in d.messages:
                    for s in m.signals:
                        key = (bus, m.id, m.extended, s.name)
                        rows.setdefault(key, {"bus_id": bus, "id": m.id, "extended": m.extended, "signal": s.name, "message": m.name, "ecu": m.transmitter, "unit": s.unit, "is_enum": s.is_enum, "path": signal_path(bus, m.transmitter, m.name, s.name), "database": d.name})
        return [rows[k] for k in sorted(rows)]

    def collisions(self) -> list[dict]:
        """Per bus, later definitions of an id that an earlier database owns."""
        out = []
        for bus in self.buses():
            owner: dict[tuple[int, bool], tuple[str, str]] = {}
            for d in self.applicable(bus):
                for m in d.messages:
                    key = (m.id, m.extended)
                    if key in owner:
                        out.append({"bus_id": bus, "id": m.id, "extended": m.extended, "winner": owner[key][0], "winner_message": owner[key][1], "loser": d.name, "loser_message": m.name})
                    else:
                        owner[key] = (d.name, m.name)
        return out

    def value_table(self, bus: str, can_id: int, extended: bool, name: str) -> list[tuple[int, str]] | None:
        """By raw value, of the first applicable database that has a table for the signal (not always the decoding one)."""
        for d in self.applicable(bus):
            m = d.find(can_id, extended)
            s = m.signal(name) if m else None
            if s and s.values:
                return sorted(s.values)
        return None

    def content(self) -> list[dict]:
        """Messages by id, signals in declaration order."""
        return [
            {"database": x.database.name, "id": m.id, "extended": m.extended, "message": m.name, "ordinal": i, "signal": s.name, "unit": s.unit, "comment": s.comment}
            for x in self.loaded
            for m in sorted(x.database.messages, key=lambda m: (m.id, m.extended))
            for i, s in enumerate(m.signals)
        ]

    def fingerprint(self, bus: str, can_id: int, extended: bool, name: str) -> int:
        """FNV-1a 64 of everything that decoding the signal on the bus depends on; labels and units do not."""
        parts = [f"{bus}|{can_id}|{extended}|{name}"]
        for m, _ in self.chain(bus, can_id, extended, name):
            parts += [repr((s.name, s.start, s.size, s.little, s.signed, s.factor, s.offset, s.kind, s.mux)) for s in m.signals if s.name == name or s.mux == "M"]
        h = 0xCBF29CE484222325
        for b in "\n".join(parts).encode():
            h = ((h ^ b) * 0x100000001B3) & (1 << 64) - 1
        return h


def signal_path(bus: str | None, ecu: str | None, message: str | None, signal: str | None) -> str:
    return "/".join(x or "" for x in (bus, ecu, message, signal))


def signal_identity(bus: str | None, can_id: int | None, extended: bool, name: str, file_backed: bool = False) -> str:
    return f"{bus or '*'}|{'f' if file_backed else 'x' if extended else 's'}:{can_id if can_id is not None else 0}:{name}"


def message_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """The winners as rows (bus_id, id, extended, message, ecu, length, ...), small enough to broadcast."""
    rows = [(bus, m.id, m.extended, m.name, m.transmitter, m.length, m.fd, m.brs, m.cycle_ms, m.send_type, m.comment, order) for bus, m, order in catalog.winners()]
    schema = "bus_id string, id long, extended boolean, message string, ecu string, length int, fd boolean, brs boolean, cycle_ms int, send_type string, comment string, load_order int"
    return spark.createDataFrame(rows, schema)


def signal_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [tuple(d[k] for k in ("bus_id", "id", "extended", "signal", "message", "ecu", "unit", "is_enum", "path", "database")) for d in catalog.descriptors()]
    return spark.createDataFrame(rows, "bus_id string, id long, extended boolean, signal string, message string, ecu string, unit string, is_enum boolean, path string, database string")


def collision_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [tuple(c.values()) for c in catalog.collisions()]
    return spark.createDataFrame(rows, "bus_id string, id long, extended boolean, winner string, winner_message string, loser string, loser_message string")


def value_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [(d["bus_id"], d["id"], d["extended"], d["signal"], raw, label) for d in catalog.descriptors() for raw, label in catalog.value_table(d["bus_id"], d["id"], d["extended"], d["signal"]) or ()]
    return spark.createDataFrame(rows, "bus_id string, id long, extended boolean, signal string, raw long, label string")
