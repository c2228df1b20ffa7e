"""Retention of an imported capture: its oldest blocks go, indices stay, and the low-water mark tells where history starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def block_sizes(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(block, bytes) of a capture's partitions, oldest first."""
    fs, root = _fs(spark, path)
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("block=")]
    return sorted((int(p.getName().partition("=")[2]), fs.getContentSummary(p).getLength()) for p in found)


def low_water(spark: SparkSession, path: str) -> int:
    """The first index that is kept; 0 if nothing was ever evicted."""
    fs, mark = _fs(spark, f"{path.rstrip('/')}/_low_water")
    if not fs.exists(mark):
        return 0
    return max(int(s.getPath().getName()) for s in fs.listStatus(mark))


def retain(spark: SparkSession, path: str, most_bytes: int, derived_bytes: int = 0) -> int:
    """Evict the oldest blocks of a capture so that it and its derived tables come to fit most_bytes; the low-water mark.

    Of the excess the capture sheds its share of all bytes only, as the derived tables shrink to the mark afterwards. The
    newest block always stays. The mark is set before blocks go, so a reader never sees indices below it again, and an
    eviction that was cut off is repeated by the next call.
    """
    sizes = block_sizes(spark, path)
    raw = sum(n for _, n in sizes)
    excess = raw + derived_bytes - most_bytes
    target = excess * raw // (raw + derived_bytes) if excess > 0 else 0
    evicted, freed = [], 0
    for block, size in sizes[:-1]:
        if freed >= target:
            break
        evicted.append(block)
        freed += size
    mark = low_water(spark, path)
    if evicted:
        kept = spark.read.parquet(path).filter(F.col("block") > evicted[-1])
        first = kept.agg(F.min("idx")).first()[0]
        mark = max(mark, first if first is not None else mark)
        fs, at = _fs(spark, f"{path.rstrip('/')}/_low_water/{mark}")
        fs.create(at, True).close()
    fs, _ = _fs(spark, path)
    for block, _size in sizes[:-1]:
        if block in evicted:
            fs.delete(_fs(spark, f"{path.rstrip('/')}/block={block}")[1], True)
    return mark


def retained(frames: DataFrame, first: int) -> DataFrame:
    """Frames, matches or other rows by idx from the low-water mark on; their indices stay as they are."""
    return frames.filter(F.col("idx") >= first) if first > 0 else frames


def timeline(notes: DataFrame, frames: DataFrame, first: int) -> DataFrame:
    """notes (id, timestamp_ns, label) as events by time, and, where history was evicted, one that marks its first frame."""
    events = notes.select("id", "timestamp_ns", "label", F.lit("note").alias("kind"), F.lit(True).alias("editable"))
    if first > 0:
        oldest = retained(frames, first).agg(F.min_by("timestamp_ns", "idx").alias("timestamp_ns")).filter("timestamp_ns is not null")
        cut = oldest.select(F.lit("truncation").alias("id"), "timestamp_ns", F.lit("history starts here").alias("label"), F.lit("truncation").alias("kind"), F.lit(False).alias("editable"))
        events = events.unionByName(cut)
    return events.orderBy("timestamp_ns", "id")
