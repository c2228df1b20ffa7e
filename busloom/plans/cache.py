"""Decoded series and their levels as tables keyed by what their decoding depends on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import settled, with_dense_index
from ..operators import series as series_ops
from ..operators.decode import decode_series
from .catalog import Catalog

Wanted = tuple[str, int, bool, str]


COLUMNS = ("bus_id", "signal", "idx", "t", "value")


class SeriesCache:
    """Series of one capture under root/capture=<name>/fingerprint=<hex>/level=<n>.

    A change of databases changes fingerprints and another capture has another name, so stale tables are never read, and
    returning to an earlier schema finds its tables again. Points are stored with their number in the series (`rn`), so
    what a level still has to fold are the points from the last complete bucket on: at most BRANCH - 1 stored ones and
    those that came since. Only these are read, numbered (by ranges, from the stored count on) and appended. Frames that
    came late in time rebuild the tables. What is stored is read off the tables, so a failed extension is repeated by the
    next call.
    """

    def __init__(self, spark: SparkSession, root: str, catalog: Catalog, capture: str = "0"):
        self.spark, self.root, self.catalog = spark, f"{root.rstrip('/')}/capture={capture}", catalog

    def path(self, wanted: Wanted, level: int = 0) -> str:
        return f"{self.root}/fingerprint={self.catalog.fingerprint(*wanted):016x}/level={level}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def _append(self, points: DataFrame, stored: int, path: str) -> DataFrame:
        """points (COLUMNS and more) appended to the table, numbered in order of time from the stored count on."""
        numbered = with_dense_index(points, "t", "idx", name="rn")
        numbered.withColumn("rn", (F.col("rn") + stored).cast("long")).write.mode("append").parquet(path)
        return self.spark.read.parquet(path)

    def levels(self, frames: DataFrame, wanted: Wanted) -> list[DataFrame]:
        """The series' pyramid with every frame given, decoded and folded only where it is not stored yet."""
        base = self.path(wanted)
        edge = None
        if self.exists(base):
            edge = self.spark.read.parquet(base).agg(F.max("idx").alias("idx"), F.max("t").alias("t"), F.max("rn").alias("rn")).first()
        new = frames if edge is None or edge["idx"] is None else frames.filter(F.col("idx") > edge["idx"])
        raw = decode_series(new, self.catalog, [wanted]).select(*COLUMNS)
        stored = 0 if edge is None or edge["rn"] is None else edge["rn"] + 1
        if stored and not raw.filter(F.col("t") < edge["t"]).isEmpty():
            raw, stored = settled(self.spark.read.parquet(base).select(*COLUMNS).unionByName(raw)), 0
            fs, folder = self._fs(base.rpartition("/")[0])
            fs.delete(folder, True)
        out = [self._append(raw, stored, base)]
        while True:
            level = self._extend(out[-1], self.path(wanted, len(out)))
            if level.isEmpty():
                return out
            out.append(level)

    def _extend(self, below: DataFrame, path: str) -> DataFrame:
        """The level at path, from the complete buckets of the level below; `bucket` numbers them."""
        branch = series_ops.BRANCH
        stored, done = 0, -1
        if self.exists(path):
            last = self.spark.read.parquet(path).agg(F.max("rn").alias("rn"), F.max("bucket").alias("bucket")).first()
            stored, done = (-1 if last["rn"] is None else last["rn"]) + 1, -1 if last["bucket"] is None else last["bucket"]
        top = below.agg(F.max("rn")).first()[0]
        full = ((-1 if top is None else top) + 1) // branch  # complete buckets
        if full <= done + 1 and self.exists(path):
            return self.spark.read.parquet(path)
        rows = below.filter((F.col("rn") >= (done + 1) * branch) & (F.col("rn") < full * branch))
        rows = rows.withColumn("bucket", F.floor(F.col("rn") / branch).cast("long"))
        return self._append(series_ops.fold_buckets(rows, "bus_id", "signal").select(*COLUMNS, "bucket"), stored, path)

    def evict(self, most_bytes: int, keep: list[Wanted]) -> int:
        """Bytes freed: parked series (of other schemas than the catalogue's `keep`) go, those untouched longest first, until
        all tables of the capture take at most `most_bytes`."""
        fs, root = self._fs(self.root)
        if not fs.exists(root):
            return 0
        used = {self.path(w).split("/")[-2] for w in keep}
        folders = [s.getPath() for s in fs.listStatus(root)]
        size = {f.getName(): fs.getContentSummary(f).getLength() for f in folders}
        touched = {f.getName(): max([s.getModificationTime() for s in fs.listStatus(f)] or [0]) for f in folders}
        total, freed = sum(size.values()), 0
        for folder in sorted(folders, key=lambda f: (touched[f.getName()], f.getName())):
            if total - freed <= most_bytes:
                break
            if folder.getName() not in used:
                fs.delete(folder, True)
                freed += size[folder.getName()]
        return freed


def import_capture(frames: DataFrame, mapping: DataFrame, path: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Window, route, guard and number frames of a reader (file, object_no order), write them partitioned by coarse row
    number, and read them back: row-number statistics and partitions prune pages."""
    from ..model import guard, route
    from ..operators.trace import time_window
    from ..sources.mdf4 import with_emission_key

    if "record_no" in frames.columns:  # groups are merged as their next frames fall due
        frames, order = with_emission_key(frames), ["file", "_due", "group", "record_no"]
    else:
        order = [c for c in ("file", "object_no") if c in frames.columns] if "object_no" in frames.columns else [c for c in ("file", "timestamp_ns", "group") if c in frames.columns]
    kept = guard(route(time_window(frames.withColumn("idx", F.lit(0)), start_ns, end_ns), mapping))
    numbered = with_dense_index(kept, *order).drop("_due")
    numbered.withColumn("block", F.floor(F.col("idx") / 50_000_000)).write.mode("overwrite").partitionBy("block").parquet(path)
    return frames.sparkSession.read.parquet(path)


def import_origin(frames: DataFrame, notes: DataFrame, samples: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> int | None:
    """The earliest time of frames, and of notes and samples in range."""
    inside = F.lit(True)
    if start_ns is not None:
        inside = inside & (F.col("timestamp_ns") >= start_ns)
    if end_ns is not None:
        inside = inside & (F.col("timestamp_ns") <= end_ns)
    every = frames.select("timestamp_ns").unionByName(notes.select("timestamp_ns").filter(inside)).unionByName(samples.select("timestamp_ns").filter(inside))
    return every.agg(F.min("timestamp_ns")).first()[0]
