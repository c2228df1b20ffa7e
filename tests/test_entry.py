"""The driver's contract, and registered queries against their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from busloom import model, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: a few of each family; the driver compares all
SOME = ("decode_message", "filter_nested", "filtered_page", "latest_by_id", "by_id_page", "index_at_time", "decimated", "run_reduced", "extrapolated", "merged_series", "counter_violations", "signal_snapshot")


def _plain(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = db.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted((tuple(_plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_merged_series_of_shared_times(spark, tmp_path):
    """Samples of a bus at one time are a row each, and a bus of one sample has no value before it."""
    events = spark.read.parquet(f"{DATA}/events.parquet").filter("event_type in ('click', 'view', 'error')").limit(60).cache()
    copies = events.unionByName(events.withColumn("event_id", events.event_id + 1000)).unionByName(events.limit(7))
    one = events.orderBy("ts").offset(30).limit(1).withColumns({"event_type": F.lit("purchase"), "event_id": F.lit(5000).cast("long")})
    copies.unionByName(one).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    events.unpersist()
    got = entry.queries()["merged_series"](spark, str(tmp_path)).select("t", "bus_id", "value", "genuine").collect()
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = c.execute(f"SELECT t, bus_id, value, genuine FROM ({entry.oracle_sql()['merged_series']})").fetchall()
    assert sorted(map(repr, (tuple(map(_plain, r)) for r in got))) == sorted(map(repr, (tuple(map(_plain, r)) for r in want)))
    assert len(want) == 60 * 3 + 67 and sum(r[1] == "batt" and r[2] is None for r in want) == 30
    model.free()


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_registered():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
