"""File-backed signals: physical series that a measurement file carries, beside the signals decoded from frames.

A series is known by its source file, channel group and name; it is on no bus. Rows are (source_path, group, group_name,
signal, unit, idx, timestamp_ns, t, value), so the series operators take them with the key (group, signal).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dbc import Database, DbcError, parse_dbc
from .catalog import Catalog, signal_path

IDENTITY = ("group", "signal")


def group_label(group_name: Column, group: Column) -> Column:
    return F.coalesce(group_name, F.concat(F.lit("group "), group.cast("string")))


def fill(samples: DataFrame, source_path: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """The series of a file's samples (read_mdf(what="signals")) within [start, end], both ends included. Signals without
    samples there have no rows, so they are not created."""
    out = samples
    if start_ns is not None:
        out = out.filter(F.col("timestamp_ns") >= start_ns)
    if end_ns is not None:
        out = out.filter(F.col("timestamp_ns") <= end_ns)
    t = (F.col("timestamp_ns") / F.lit(1e9)).alias("t")
    return out.select(F.lit(source_path).alias("source_path"), "group", "group_name", F.col("name").alias("signal"), F.coalesce("unit", F.lit("")).alias("unit"), F.col("record_no").alias("idx"), "timestamp_ns", t, "value")


def refilled(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the series of new: one of the same group and name is replaced whole, whatever its path."""
    gone = new.select(*IDENTITY).distinct()
    return stored.join(gone, list(IDENTITY), "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def entries(series: DataFrame) -> DataFrame:
    """One row a series: count, newest sample, rate over its span (null below two samples or without a span)."""
    span = (F.max("t") - F.min("t")).alias("_span")
    g = series.groupBy("source_path", *IDENTITY).agg(
        F.first("group_name").alias("group_name"),
        F.first("unit").alias("unit"),
        F.count("*").alias("count"),
        F.max_by(F.struct("t", "value"), F.struct("t", "idx")).alias("_latest"),
        span,
    )
    rate = F.when((F.col("count") > 1) & (F.col("_span") > 0), (F.col("count") - 1) / F.col("_span"))
    return g.select("source_path", "group", group_label(F.col("group_name"), F.col("group")).alias("label"), "signal", "unit", "count", F.col("_latest.t").alias("time"), F.col("_latest.value").alias("value"), rate.alias("rate"))


def content(series: DataFrame) -> DataFrame:
    """The tree file, group, signal: files by path, groups by index, signals by name."""
    return entries(series).select("source_path", "group", "label", "signal", "unit").orderBy("source_path", "group", "signal")


def select(series: DataFrame, tables: DataFrame, keys: list[tuple[int, str]] = (), patterns: list[str] = (), buses: list[str] | None = None) -> DataFrame:
    """Snapshot rows of the series chosen by (group, signal) or by any pattern on the path (no bus, no unit, group label,
    signal). A bus scope excludes all, as no bus carries them; a bad pattern is an error. A coded series (two or more
    entries of tables (group, name, raw, label)) has the label of its newest value, if that is one of its codes."""
    for p in patterns:
        re.compile(p)
    rows = entries(series)
    path = F.concat(F.lit("//"), F.col("label"), F.lit("/"), F.col("signal"))
    chosen = F.lit(False)
    for group, name in keys:
        chosen = chosen | ((F.col("group") == group) & (F.col("signal") == name))
    for p in patterns:
        chosen = chosen | path.rlike(p)
    rows = rows.filter(chosen & F.lit(buses is None))
    coded = tables.select("group", F.col("name").alias("signal"), "raw", F.col("label").alias("text")).groupBy("group", "signal").agg(F.count("*").alias("_codes"), F.map_from_entries(F.collect_set(F.struct("raw", "text"))).alias("_table"))
    rows = rows.join(coded, list(IDENTITY), "left")
    code = F.when((F.col("value") == F.floor("value")) & (F.abs("value") < 9.0e15), F.col("value").cast("long"))
    return rows.select(
        F.lit(None).cast("string").alias("bus_id"), F.col("group").cast("long").alias("id"), F.lit(False).alias("extended"), "signal", F.col("label").alias("message"), "unit",
        (F.coalesce("_codes", F.lit(0)) >= 2).alias("is_enum"), path.alias("path"), "time", "value", "count", "rate", F.try_element_at("_table", code).alias("label"), F.lit(True).alias("file_backed"),
    )


def signal_page(decoded: DataFrame, backed: DataFrame) -> DataFrame:
    """Snapshot rows of decoded signals and of file-backed ones in one table; columns of one side alone are null in the other."""
    return decoded.withColumn("file_backed", F.lit(False)).unionByName(backed, allowMissingColumns=True)


def fingerprint(source_path: str, group: int, name: str) -> int:
    """FNV-1a 64 of a series' identity: path, group index and name, nothing else."""
    h = 0xCBF29CE484222325
    for b in f"file\0{source_path}\0{group}\0{name}".encode():
        h = ((h ^ b) * 0x100000001B3) & (1 << 64) - 1
    return h


def adopt_databases(catalog: Catalog, attachments: DataFrame, buses: list[str], mime: str = "application/x-dbc") -> list[dict]:
    """Load the databases that files carry as attachments (file, name, mime, content) into the catalogue.

    A database's identity is `file#attachment`; importing the file again replaces it in place. The result has identity,
    messages, warnings and error of each; a bad one does not stop the others.
    """
    given = attachments.filter(F.length("content") > 0).filter((F.lower("mime") == mime) | F.lower("name").endswith(".dbc"))
    out = []
    for r in given.orderBy("file", "name").collect():  # databases are schema
        identity = f"{r['file']}#{r['name']}"
        try:
            known: Database = parse_dbc(bytes(r["content"]).decode("utf-8", "replace"), identity)
        except DbcError as error:
            out.append({"identity": identity, "messages": 0, "warnings": [], "error": str(error)})
            continue
        catalog.add(known, buses)
        out.append({"identity": identity, "messages": len(known.messages), "warnings": list(known.warnings), "error": None})
    return out


def descriptor_path(label: str, signal: str) -> str:
    return signal_path(None, None, label, signal)
