"""Capture sessions: origin, key generation, channels for saving, selections."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FRAME_KEY
from ..operators.trace import Sections


@dataclass(frozen=True)
class Session:
    """One capture session: `number` names its tables, so a new session starts empty."""

    number: int = 0
    start_ns: int | None = None

    def started(self, start_ns: int) -> Session:
        """A new session: the store and what is derived from it belong to the old number."""
        return Session(self.number + 1, start_ns)

    def lowered(self, start_ns: int) -> Session:
        """The origin moved down to start_ns; it is never raised, and frames already stored stay."""
        return self if self.start_ns is not None and self.start_ns <= start_ns else replace(self, start_ns=start_ns)

    def anchored(self, frames: DataFrame) -> Session:
        """The origin lowered to the earliest frame."""
        first = frames.agg(F.min("timestamp_ns")).first()[0]
        return self if first is None else self.lowered(first)

    def path(self, root: str) -> str:
        return f"{root.rstrip('/')}/session={self.number}"


def key_generation(frames: DataFrame) -> int:
    """Changes exactly when the set of (bus, channel, id, extended) keys grows: their number."""
    return frames.select(*FRAME_KEY).distinct().count()


def channel_for_save(buses: list[str]) -> Column:
    """A bus's place in the project's list (255 at most), else the channel on the wire."""
    at = F.array_position(F.array(*[F.lit(b) for b in buses]), F.col("bus_id")) if buses else F.lit(0)
    return F.when(at > 0, F.least(at - 1, F.lit(255))).otherwise(F.col("channel")).cast("int")


@dataclass(frozen=True)
class Selection:
    keys: tuple[tuple, ...] = ()
    patterns: tuple[str, ...] = field(default=())

    def with_section_patterns(self, sections: Sections) -> Selection:
        """The selection widened by the patterns of the sections that exist, each once, in order."""
        every = [*self.patterns, *(p for n in sections.names for p in sections.patterns.get(n, []))]
        return replace(self, patterns=tuple(dict.fromkeys(every)))


def scoped_catalog(signals: DataFrame, buses: list[str] | None) -> DataFrame:
    """Catalogue rows on the wired buses; rows without a bus only if nothing restricts them."""
    return signals if buses is None else signals.filter(F.col("bus_id").isin(buses))


def log_sources(messages: DataFrame) -> DataFrame:
    return messages.select("source").distinct().orderBy("source")
