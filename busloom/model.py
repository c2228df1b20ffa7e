"""The frame model: schema, keys, sessions and dense row numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME_SCHEMA = T.StructType(
    [
        T.StructField("idx", T.LongType()),
        T.StructField("timestamp_ns", T.LongType()),
        T.StructField("channel", T.IntegerType()),
        T.StructField("bus_id", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("extended", T.BooleanType()),
        T.StructField("direction", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("brs", T.BooleanType()),
        T.StructField("esi", T.BooleanType()),
        T.StructField("dlc", T.IntegerType()),
    ]
)
MAX_STANDARD, MAX_EXTENDED = 0x7FF, 0x1FFFFFFF
CLASSIC_BYTES, FD_BYTES = 8, 64
#: (bus, channel, id, extended) keys the by-id view; the signal snapshot drops the channel.
FRAME_KEY = ("bus_id", "channel", "id", "extended")
STREAM_KEY = ("bus_id", "id", "extended")


def invalid_reason() -> Column:
    """Why a frame breaks the model, or null."""
    size = F.coalesce(F.length("data"), F.lit(0))
    return (
        F.when(~F.col("kind").isin("classic", "fd", "remote", "error"), "unknown kind")
        .when(F.col("id").isNull() | (F.col("id") < 0) | (F.col("id") > F.when(F.col("extended"), MAX_EXTENDED).otherwise(MAX_STANDARD)), "id out of range")
        .when(~F.col("direction").isin("Rx", "Tx"), "unknown direction")
        .when((F.col("kind") == "classic") & (size > CLASSIC_BYTES), "classic payload over 8 bytes")
        .when((F.col("kind") == "fd") & (size > FD_BYTES), "FD payload over 64 bytes")
        .when(F.col("kind").isin("remote", "error") & (size > 0), "data on a frame kind without any")
        .when((F.col("dlc") < 0) | (F.col("dlc") > 15), "DLC over 15")
    )


def route(frames: DataFrame, mapping: DataFrame) -> DataFrame:
    """Frames with the bus of the first mapping (channel, bus_id, ord) of their channel; unmapped frames go."""
    first = mapping.groupBy("channel").agg(F.min_by("bus_id", "ord").alias("bus_id"))
    return frames.drop("bus_id").join(first, "channel")


def guard(frames: DataFrame, session_start_ns: int | None = None) -> DataFrame:
    """The session guard: frames before the origin and frames without a bus are not stored."""
    out = frames.filter(F.col("bus_id").isNotNull())
    return out if session_start_ns is None else out.filter(F.col("timestamp_ns") >= session_start_ns)


def guard_counts(frames: DataFrame, session_start_ns: int) -> DataFrame:
    """One row: kept, early, without_bus."""
    bus, early = F.col("bus_id").isNotNull(), F.col("timestamp_ns") < session_start_ns
    return frames.agg(
        F.count_if(bus & ~early).alias("kept"), F.count_if(early).alias("early"), F.count_if(~bus & ~early).alias("without_bus")
    )


#: most rows of a table that is collected to be broadcast
SMALL = 200_000
_held: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """df kept (memory, then disk) because several steps must see the same partitions; free() lets go of all such tables."""
    _held.append(df.persist())
    return _held[-1]


#: folders of applications that name none, by application id, and the tables written there
_own: dict[str, str] = {}
_settled: list[tuple[SparkSession, str]] = []


def settled(df: DataFrame) -> DataFrame:
    """df written once to the folder that spark.checkpoint.dir names and read back: for what several steps read, and where
    plans would grow with every step. A local session that names no folder gets one of its own."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own.get(app)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own[app] = "file://" + tempfile.mkdtemp(prefix="busloom-")
    path = f"{folder.rstrip('/')}/busloom-{app}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _settled.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def free() -> None:
    """Let go of what held() and settled() kept, once the results that read it have been used."""
    while _held:
        _held.pop().unpersist()
    while _settled:
        spark, path = _settled.pop()
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def same(left: DataFrame, right: DataFrame, key: tuple[str, ...] | list[str], prefix: str = "_of_") -> tuple[DataFrame, list[Column]]:
    """(right with its key columns renamed, conditions that join it to left on equal keys, nulls equal)."""
    named = right.withColumnsRenamed({k: f"{prefix}{k}" for k in key})
    return named, [left[k].eqNullSafe(named[f"{prefix}{k}"]) for k in key]


def small(df: DataFrame) -> DataFrame:
    """df computed once and broadcast if it has at most SMALL rows; as it is otherwise, so that the join shuffles."""
    rows = df.limit(SMALL + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= SMALL else df


def ranges(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows dealt by ranges of the order, with the number of their range: each range is one task's share."""
    return held(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def with_dense_index(frames: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Number rows 0, 1, ... in the given order without a global window: range partitions, then offsets from their counts.

    Only one count per partition is gathered. The order must be total, or equal rows may swap.
    """
    dealt = ranges(frames.drop(name), *order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_part").orderBy(*order)
    numbered = dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.row_number().over(inside) - 1 + F.col("_offset"))
    return numbered.drop("_part", "_offset")


def beside(dealt: DataFrame, carried: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """dealt with the columns of carried, which has one row a range and key (null keys are equal)."""
    names = ("_part", *key)
    right = carried.select(*[F.col(c).alias(f"_of_{c}") for c in names], *[c for c in carried.columns if c not in names])
    on = [dealt[c].eqNullSafe(right[f"_of_{c}"]) for c in names]
    return dealt.join(right, on).drop(*[f"_of_{c}" for c in names])


def running_max(rows: DataFrame, value: Column, name: str, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """rows with the greatest value of their key up to them in order: rows are dealt by ranges of (key, order), and each
    range passes one number a key to the later ones."""
    dealt = ranges(rows.withColumn(name, value), *key, *order)
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy("_part", *key).agg(F.max(name).alias("_top")).withColumn("_carried", F.max("_top").over(before)).drop("_top")
    inside = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return beside(dealt, small(carried), key).withColumn(name, F.greatest(F.max(name).over(inside), "_carried")).drop("_part", "_carried")


def last_before(rows: DataFrame, value: Column, name: str, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """rows with the last non-null value of their key before them in order, dealt and carried as in running_max."""
    dealt = ranges(rows.withColumn("_value", value), *key, *order)
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.filter("_value is not null").groupBy("_part", *key).agg(F.max_by("_value", F.struct(*order)).alias("_end"))
    parts = dealt.select("_part", *key).distinct().withColumn("_end", F.lit(None).cast(dealt.schema["_value"].dataType))
    ends = ends.unionByName(parts).groupBy("_part", *key).agg(F.max("_end").alias("_end"))
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    inside = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = F.last("_value", ignorenulls=True).over(inside)
    return beside(dealt, small(ends), key).withColumn(name, F.coalesce(near, "_carried")).drop("_part", "_carried", "_value")


def _byte(value: Column) -> Column:
    return F.lpad(F.hex(value), 2, "0")


def frames_from_events(events: DataFrame) -> DataFrame:
    """Classic 8-byte frames derived from rows (event_id, ts, user_id, event_type, value, props).

    Layout: bytes 0-1 the value in hundredths as 16-bit little-endian; 2 the integer k of props; 3 the multiplexor
    k % 4; 4 a rolling 4-bit counter that skips where k is 0; 5 k again as a multiplexed field; 6-7 the value
    big-endian.
    """
    raw = F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(65536))
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    counter = F.pmod(F.col("event_id") + F.when(k % 8 == 0, 1).otherwise(0), F.lit(16))
    low, high = F.pmod(raw, F.lit(256)), F.floor(raw / 256)
    hexed = F.concat(_byte(low), _byte(high), _byte(F.pmod(k, F.lit(256))), _byte(F.pmod(k, F.lit(4))), _byte(counter), _byte(F.pmod(k, F.lit(256))), _byte(high), _byte(low))
    bus = F.when(F.col("event_type").isin("click", "view"), "pt").when(F.col("event_type") == "purchase", "batt").otherwise("body")
    return events.select(
        F.col("event_id").alias("idx"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"),
        F.when(bus == "pt", 0).when(bus == "batt", 1).otherwise(2).alias("channel"),
        bus.alias("bus_id"),
        (F.lit(256) + F.pmod("user_id", F.lit(16))).cast("long").alias("id"),
        (F.pmod("user_id", F.lit(5)) == 0).alias("extended"),
        F.when(F.col("event_id") % 10 == 0, "Tx").otherwise("Rx").alias("direction"),
        F.lit("classic").alias("kind"),
        F.unhex(hexed).alias("data"),
        F.lit(None).cast("boolean").alias("brs"),
        F.lit(None).cast("boolean").alias("esi"),
        F.lit(8).alias("dlc"),
    )


def load_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
