"""Shared intermediate tables: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: folders of applications that name none, by application id
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the cluster's spark.checkpoint.dir. Where that is unset, a local master (tests, a
    laptop) gets a folder of its own; a cluster must name one, as its machines don't share local folders."""
    app = spark.sparkContext.applicationId
    given = spark.conf.get("spark.checkpoint.dir", None) or _own.get(app)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = _own[app] = "file://" + tempfile.mkdtemp(prefix="busloom-")
    return f"{given.rstrip('/')}/busloom-{app}"


def release(spark: SparkSession) -> None:
    """Delete every table that this application has settled, once no DataFrame reads them any more."""
    drop(spark, [shared_dir(spark)])


_collectors: list[list[str]] = []


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables settled inside, for drop() once nothing reads them any more."""
    paths: list[str] = []
    _collectors.append(paths)
    try:
        yield paths
    finally:
        _collectors.remove(paths)


def drop(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: computed once, lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for paths in _collectors:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def alnum_words(c: Column) -> Column:
    """Array of the words [0-9a-z and non-ASCII]+ of a text; null or wordless texts give an empty array."""
    parts = F.split(ascii_lower(F.coalesce(c, F.lit(""))), ALNUM_GAP)
    return F.array_remove(parts, "")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
