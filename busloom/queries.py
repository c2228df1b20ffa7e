"""Registered queries over the driver's tables, and the SQL that must give the same rows.

Frames are derived from `events` (see model.frames_from_events). The SQL computes the same fields from the integers
arithmetically, so it is independent of the payload and bit code.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import model
from .functions.bits import raw_bits
from .functions.crc import crc_column
from .operators import decode, measure, report, series, trace, verify
from .plans import catalog as cat
from .plans import predicate
from .sources.dbc import CounterConfig, CrcConfig, Database, Message, Signal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BUSES = ("pt", "batt", "body")
MODES = ((0, "idle"), (1, "run"), (2, "hold"), (3, "fault"))


def _signal(name: str, start: int, size: int, **more) -> Signal:
    given = {"little": True, "signed": False, "factor": 1.0, "offset": 0.0, "minimum": 0.0, "maximum": 0.0, "unit": ""} | more
    return Signal(name=name, start=start, size=size, **given)


@cache
def sample_catalog() -> cat.Catalog:
    """One layout on ids 256..271, standard and extended, on all buses; a second database redefines four ids on one bus."""
    signals = (
        _signal("Value", 0, 16, factor=0.01, unit="V"),
        _signal("SignedValue", 0, 16, signed=True, factor=0.01, unit="V"),
        _signal("K", 16, 8),
        _signal("Mode", 24, 8, mux="M", values=MODES),
        _signal("Counter", 32, 4),
        _signal("Even", 40, 8, mux=0, factor=0.5, offset=1.0),
        _signal("Odd", 40, 8, mux=1),
        _signal("BigValue", 55, 16, little=False, factor=0.01, unit="V"),
    )
    rule = CounterConfig("Counter", 1, 15)
    messages = tuple(Message(256 + i, e, f"{'X' if e else 'M'}{256 + i}", 8, f"ECU{i % 4}", signals, counter=rule) for e in (False, True) for i in range(16))
    other = tuple(Message(256 + i, False, f"Alt{i}", 8, "ALT", (_signal("Value", 0, 16, factor=1.0), _signal("Extra", 16, 4, values=MODES))) for i in range(4))
    return cat.Catalog().add(Database("main", messages), BUSES).add(Database("alt", other), ("pt",))


FRAMES = """
e AS (SELECT event_id, ts, user_id, event_type,
  ((CAST(round(value * 100) AS BIGINT) % 65536) + 65536) % 65536 AS raw,
  coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events),
f AS (SELECT event_id AS idx, epoch_us(ts) * 1000 AS timestamp_ns,
  CASE WHEN event_type IN ('click', 'view') THEN 'pt' WHEN event_type = 'purchase' THEN 'batt' ELSE 'body' END AS bus_id,
  CASE WHEN event_type IN ('click', 'view') THEN 0 WHEN event_type = 'purchase' THEN 1 ELSE 2 END AS channel,
  256 + user_id % 16 AS id, user_id % 5 = 0 AS extended,
  CASE WHEN event_id % 10 = 0 THEN 'Tx' ELSE 'Rx' END AS direction,
  raw, CASE WHEN raw >= 32768 THEN raw - 65536 ELSE raw END AS sraw, k, k % 4 AS mode,
  (event_id + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END) % 16 AS counter,
  epoch_us(ts) * 1000 / 1e9 AS t FROM e),
s AS (SELECT bus_id, idx, t, CAST(raw AS DOUBLE) * 0.01 AS value FROM f)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SELECT that follows the common tables f (frames) and s (series)."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {FRAMES.strip()} {sql}"
        return f

    return register


def frames(spark: SparkSession, d: str) -> DataFrame:
    return model.load_frames(spark, d)


def value_series(spark: SparkSession, d: str) -> DataFrame:
    """One series a bus: Value of all its frames."""
    wanted = [(b, m.id, m.extended, "Value") for b, m, _ in sample_catalog().winners()]
    return decode.decode_series(frames(spark, d), sample_catalog(), wanted).select("bus_id", "idx", "t", "value")


@query("SELECT idx, timestamp_ns, channel, bus_id, id, extended, direction FROM f")
def frames_scan(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("idx", "timestamp_ns", "channel", "bus_id", "id", "extended", "direction")


@query("SELECT idx, bus_id, value FROM s")
def decode_series(spark: SparkSession, d: str) -> DataFrame:
    return value_series(spark, d).select("idx", "bus_id", "value")


@query("""
SELECT idx, 'M' AS kind, name, value, label FROM (
 SELECT idx, unnest(['Value', 'SignedValue', 'K', 'Mode', 'Counter', 'BigValue']) AS name,
  unnest([CAST(raw AS DOUBLE) * 0.01, CAST(sraw AS DOUBLE) * 0.01, CAST(k % 256 AS DOUBLE), CAST(mode AS DOUBLE), CAST(counter AS DOUBLE), CAST(raw AS DOUBLE) * 0.01]) AS value,
  unnest([NULL, NULL, NULL, CASE mode WHEN 0 THEN 'idle' WHEN 1 THEN 'run' WHEN 2 THEN 'hold' ELSE 'fault' END, NULL, NULL]) AS label FROM f
 UNION ALL SELECT idx, 'Even', CAST(k % 256 AS DOUBLE) * 0.5 + 1.0, NULL FROM f WHERE mode = 0
 UNION ALL SELECT idx, 'Odd', CAST(k % 256 AS DOUBLE), NULL FROM f WHERE mode = 1)""")
def decode_message(spark: SparkSession, d: str) -> DataFrame:
    out = decode.decode_frames(frames(spark, d), sample_catalog())
    return out.select("idx", F.substring(F.translate("message", "X", "M"), 1, 1).alias("kind"), F.inline("signals")).select("idx", "kind", "name", "value", "label")


def _filtered(tree: object) -> Query:
    return lambda spark, d: predicate.filter_frames(frames(spark, d), tree, sample_catalog()).select("idx")


#: predicate, and its condition on f
PREDICATES: dict[str, tuple[object, str]] = {
    "filter_bus": ({"bus": "batt"}, "bus_id = 'batt'"),
    "filter_id_range": ({"id_range": [258, 261]}, "id BETWEEN 258 AND 261"),
    "filter_id_list": ({"id_list": [256, 270]}, "id IN (256, 270)"),
    "filter_name_regex": ({"name_regex": "^X25[67]$"}, "extended AND id IN (256, 257)"),
    "filter_bad_regex": ({"name_regex": "("}, "false"),
    "filter_signal_equals": ({"signal_equals": {"name": "K", "value": 7}}, "k % 256 = 7"),
    "filter_empty_all": ({"all": []}, "true"),
    "filter_empty_any": ({"any": []}, "false"),
    "filter_unknown_shape": ({"nothing": 1}, "false"),
    "filter_nested": (
        {"any": [{"all": [{"bus": "pt"}, {"id_range": [256, 263]}, {"signal_equals": {"name": "Mode", "value": 2}}]}, {"all": [{"id_list": [271]}, {"name_regex": "M"}]}]},
        "(bus_id = 'pt' AND id BETWEEN 256 AND 263 AND mode = 2) OR (id = 271 AND NOT extended)",
    ),
}
for _name, (_tree, _sql) in PREDICATES.items():
    QUERIES[_name] = _filtered(_tree)
    ORACLES[_name] = f"WITH {FRAMES.strip()} SELECT idx FROM f WHERE {_sql}"


@query("""SELECT idx, message, n_signals, cnt AS matches FROM (
 SELECT idx, CASE WHEN extended THEN 'X' ELSE 'M' END || id AS message, 6 + CASE WHEN mode < 2 THEN 1 ELSE 0 END AS n_signals,
  count(*) OVER () AS cnt, row_number() OVER (ORDER BY idx) AS rn FROM f WHERE bus_id = 'pt' AND id BETWEEN 256 AND 260)
WHERE rn > 20 AND rn <= 70""")
def filtered_page(spark: SparkSession, d: str) -> DataFrame:
    page, count, _ = trace.filtered_page(frames(spark, d), {"all": [{"bus": "pt"}, {"id_range": [256, 260]}]}, sample_catalog(), 20, 50)
    return page.select("idx", "message", F.size("signals").cast("long").alias("n_signals"), F.lit(count).cast("long").alias("matches"))


@query("SELECT idx FROM f WHERE idx >= 100 AND idx < 150 AND k % 256 < 50")
def trace_range(spark: SparkSession, d: str) -> DataFrame:
    page = trace.trace_page(frames(spark, d), sample_catalog(), 100, 150)
    return page.filter(F.exists("signals", lambda s: (s["name"] == "K") & (s["value"] < 50))).select("idx")


@query("SELECT idx FROM f ORDER BY idx DESC LIMIT 25")
def live_tail(spark: SparkSession, d: str) -> DataFrame:
    return trace.live_tail(frames(spark, d), 25).select("idx")


_RATE = """g AS (SELECT {key}, count(*) AS cnt, max(idx) AS last_idx, max(timestamp_ns) AS mx FROM f{where} GROUP BY ALL),
r AS (SELECT {gkey}, g.cnt, g.last_idx, count(*) FILTER (timestamp_ns > mx - 1000000000) AS n,
 min(timestamp_ns) FILTER (timestamp_ns > mx - 1000000000) AS fst, max(timestamp_ns) FILTER (timestamp_ns < mx) AS bef, mx
 FROM f JOIN g USING ({key}){where} GROUP BY ALL),
q AS (SELECT {key}, cnt AS "count", last_idx, CASE WHEN mx > fst THEN (n - 1) / ((mx - fst) / 1e9) WHEN mx > bef THEN 1 / ((mx - bef) / 1e9) ELSE 0 END AS rate FROM r)"""


def _rate_sql(key: str, where: str = "") -> str:
    return ", " + _RATE.format(key=key, gkey=", ".join(f"g.{k.strip()}" for k in key.split(",")), where=where)


@query(_rate_sql("bus_id, channel, id, extended") + """
SELECT q.bus_id, q.channel, q.id, q.extended, last_idx AS idx, "count", round(rate, 6) AS rate, raw FROM q JOIN f ON f.idx = q.last_idx""")
def latest_by_id(spark: SparkSession, d: str) -> DataFrame:
    out = trace.latest_by_key(frames(spark, d))
    value = decode.raw_value(sample_catalog().loaded[0].database.messages[0].signals[0])
    return out.select("bus_id", "channel", "id", "extended", "idx", "count", F.round("rate", 6).alias("rate"), value.alias("raw"))


@query(_rate_sql("bus_id, id, extended, mode") + """
SELECT bus_id, id, extended, mode AS selector, last_idx AS idx, "count", round(rate, 6) AS rate FROM q""")
def latest_per_mux(spark: SparkSession, d: str) -> DataFrame:
    out = trace.latest_per_mux(frames(spark, d), sample_catalog())
    return out.select("bus_id", "id", "extended", "selector", "idx", "count", F.round("rate", 6).alias("rate"))


@query("""SELECT bus_id, channel, id, extended, idx, message, matches FROM (SELECT *, row_number() OVER (ORDER BY idx DESC, bus_id, channel, id, extended) AS place, count(*) OVER () AS matches FROM (
 SELECT *, CASE WHEN extended THEN 'X' ELSE 'M' END || id AS message, row_number() OVER (PARTITION BY bus_id, channel, id, extended ORDER BY idx DESC) AS rn FROM f) WHERE rn = 1 AND mode < 2) WHERE place > 5 AND place <= 15""")
def by_id_page(spark: SparkSession, d: str) -> DataFrame:
    tree = {"any": [{"signal_equals": {"name": "Mode", "value": v}} for v in (0, 1)]}
    page, count = trace.by_id_page(frames(spark, d), sample_catalog(), predicate=tree, sort_key="idx", descending=True, offset=5, limit=10)
    return page.select("bus_id", "channel", "id", "extended", "idx", "message", F.lit(count).cast("long").alias("matches"))


@query("SELECT DISTINCT bus_id, id, extended FROM f")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return trace.distinct_keys(frames(spark, d))


@query("SELECT bus_id, CAST(floor(timestamp_ns / 1000000000) AS BIGINT) AS second, count(*) AS fps FROM f GROUP BY ALL")
def fps_by_bus(spark: SparkSession, d: str) -> DataFrame:
    return trace.fps_by_second(frames(spark, d), "bus_id").withColumn("second", F.col("second").cast("long"))


@query("SELECT direction, count(*) AS fps FROM f WHERE timestamp_ns > (SELECT max(timestamp_ns) - 1000000000 FROM f) GROUP BY ALL")
def fps_by_direction(spark: SparkSession, d: str) -> DataFrame:
    return trace.fps(frames(spark, d), "direction")


@query(""", x AS (SELECT timestamp_ns, min(least_idx) AS least_idx FROM (SELECT timestamp_ns, min(idx) OVER (ORDER BY timestamp_ns DESC) AS least_idx FROM f) GROUP BY ALL),
o AS (SELECT o_orderkey AS event, epoch_us(min(o_orderdate) + INTERVAL 2920 DAY) * 1000 AS ns FROM orders GROUP BY 1)
SELECT event, ns, coalesce(least_idx, (SELECT count(*) FROM f)) AS idx FROM o ASOF LEFT JOIN x ON o.ns <= x.timestamp_ns""")
def index_at_time(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderkey").agg(F.min("o_orderdate").alias("at"))
    times = orders.select(F.col("o_orderkey").alias("event"), (F.unix_micros(F.expr("cast(at as timestamp) + interval 2920 days")) * 1000).alias("ns"))
    return trace.index_at(frames(spark, d), times).select(F.col("event").cast("long").alias("event"), "ns", "idx")


@query("""SELECT count(*) AS "rows", min(idx) AS low_water, arg_min(timestamp_ns, idx) AS first_ns, arg_max(timestamp_ns, idx) AS last_ns, max(timestamp_ns) AS live_edge_ns,
 greatest(arg_max(timestamp_ns, idx) - arg_min(timestamp_ns, idx), 0) / 1e9 AS buffer_seconds FROM f""")
def capture_status(spark: SparkSession, d: str) -> DataFrame:
    return trace.status(frames(spark, d))


@query("SELECT list_sort(list(DISTINCT channel)) || [] AS channels, count(*) AS frames, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns FROM f".replace("list_sort(list(DISTINCT channel)) || []", "array_to_string(list_sort(list(DISTINCT channel)), ',')"))
def capture_census(spark: SparkSession, d: str) -> DataFrame:
    return trace.census(frames(spark, d)).withColumn("channels", F.array_join(F.transform("channels", lambda c: c.cast("string")), ","))


@query("""SELECT count(*) FILTER (timestamp_ns >= o) AS kept, count(*) FILTER (timestamp_ns < o) AS early, 0 AS without_bus FROM f, (SELECT min(timestamp_ns) + 3600000000000 AS o FROM f)""")
def session_guard(spark: SparkSession, d: str) -> DataFrame:
    all_frames = frames(spark, d)
    origin = all_frames.agg(F.min("timestamp_ns")).first()[0] or 0
    return model.guard_counts(all_frames, origin + 3_600_000_000_000)


@query("SELECT bus_id, min(value) AS lo, max(value) AS hi FROM s GROUP BY ALL")
def series_extent(spark: SparkSession, d: str) -> DataFrame:
    return series.extents(value_series(spark, d), "bus_id")


@query("SELECT bus_id, count(*) AS points, arg_max(value, idx) AS latest, round((count(*) - 1) / (max(t) - min(t)), 9) AS rate FROM s GROUP BY ALL")
def series_rate(spark: SparkSession, d: str) -> DataFrame:
    return series.series_rate(value_series(spark, d), "bus_id").withColumn("rate", F.round("rate", 9))


@query(""", r AS (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY t, idx) - 1 AS rn, count(*) OVER (PARTITION BY bus_id) AS n FROM s),
b AS (SELECT *, CASE WHEN n > 100 THEN rn // CAST(ceil(n / 100.0) AS BIGINT) ELSE rn END AS bucket FROM r),
x AS (SELECT *, row_number() OVER (PARTITION BY bus_id, bucket ORDER BY value, rn) AS lo, row_number() OVER (PARTITION BY bus_id, bucket ORDER BY value DESC, rn) AS hi FROM b)
SELECT bus_id, idx, value FROM x WHERE lo = 1 OR hi = 1 OR rn = 0 OR rn = n - 1""")
def decimated(spark: SparkSession, d: str) -> DataFrame:
    return series.decimate_min_max(value_series(spark, d), 100, "bus_id").select("bus_id", "idx", "value")


def mode_series(spark: SparkSession, d: str) -> DataFrame:
    wanted = [(b, m.id, m.extended, "Mode") for b, m, _ in sample_catalog().winners()]
    return decode.decode_series(frames(spark, d), sample_catalog(), wanted).select("bus_id", "idx", "t", "value")


_MODE = ", m AS (SELECT bus_id, idx, t, CAST(mode AS DOUBLE) AS value, lag(mode) OVER w AS before, lead(mode) OVER w AS after FROM f WINDOW w AS (PARTITION BY bus_id ORDER BY t, idx))"


@query(_MODE + " SELECT bus_id, idx, value FROM m WHERE before IS NULL OR before <> value OR after IS NULL")
def run_reduced(spark: SparkSession, d: str) -> DataFrame:
    return series.reduce_runs(mode_series(spark, d), "bus_id").select("bus_id", "idx", "value")


@query(_MODE + """, c AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> value THEN 1 ELSE 0 END) OVER (PARTITION BY bus_id ORDER BY t, idx) AS run FROM m),
g AS (SELECT bus_id, run, min(t) AS t0, max(t) AS own, min(value) AS value FROM c GROUP BY ALL)
SELECT bus_id, t0, coalesce(lead(t0) OVER (PARTITION BY bus_id ORDER BY run), own) AS t_end, value FROM g""")
def enum_segments(spark: SparkSession, d: str) -> DataFrame:
    return series.segments(mode_series(spark, d), "bus_id")


@query(""", r AS (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY t, idx) - 1 AS rn, count(*) OVER (PARTITION BY bus_id) AS n FROM s),
b AS (SELECT *, rn // 8 AS bucket FROM r WHERE (rn // 8 + 1) * 8 <= n),
x AS (SELECT *, row_number() OVER (PARTITION BY bus_id, bucket ORDER BY value, rn) AS lo, row_number() OVER (PARTITION BY bus_id, bucket ORDER BY value DESC, rn) AS hi FROM b)
SELECT bus_id, idx, value FROM x WHERE lo = 1 OR hi = 1""")
def pyramid_level(spark: SparkSession, d: str) -> DataFrame:
    return series.fold(value_series(spark, d), "bus_id").select("bus_id", "idx", "value")


@query(""", w AS (SELECT min(t) + 1000 AS a, min(t) + 5000 AS b FROM s),
x AS (SELECT s.*, a, b, lead(t) OVER p AS bt, count(*) OVER (PARTITION BY bus_id) AS n, max(t) OVER (PARTITION BY bus_id) AS mx, min(t) OVER (PARTITION BY bus_id) AS mn FROM s, w WINDOW p AS (PARTITION BY bus_id ORDER BY t, idx))
SELECT bus_id, t AS from_t, bt AS to_t FROM x WHERE bt - t > 10 / ((n - 1) / (mx - mn))
UNION ALL SELECT DISTINCT bus_id, a - 2000, mn FROM x WHERE mn > a - 2000 UNION ALL SELECT DISTINCT bus_id, mx, a + 1e9 FROM x WHERE mx < a + 1e9""")
def extrapolated(spark: SparkSession, d: str) -> DataFrame:
    s = value_series(spark, d)
    start = (s.agg(F.min("t")).first()[0] or 0.0) + 1000
    return series.extrapolated_spans(s, s, start - 2000, start + 1e9, "bus_id")


@query(""", w AS (SELECT min(t) - 1000 AS a, min(t) + 1000 + 1e9 AS b FROM s), es AS (SELECT bus_id, count(*) AS n, min(t) AS mn, max(t) AS mx FROM s GROUP BY 1),
x AS (SELECT s.bus_id, t, lead(t) OVER (PARTITION BY bus_id ORDER BY t, idx) AS bt, n, mn, mx FROM s JOIN es USING (bus_id)),
sp AS (SELECT bus_id, t AS a, bt AS b FROM x WHERE bt - t > 10 / ((n - 1) / (mx - mn)) UNION ALL SELECT bus_id, w.a, mn FROM es, w WHERE mn > w.a UNION ALL SELECT bus_id, mx, w.b FROM es, w WHERE mx < w.b),
c AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT t FROM s UNION SELECT (a + b) / 2 FROM sp JOIN es USING (bus_id) WHERE a >= mn AND b <= mx)),
g AS (SELECT c.i, c.t, es.bus_id, s.value FROM c CROSS JOIN es LEFT JOIN s ON s.t = c.t AND s.bus_id = es.bus_id),
m AS (SELECT i, bus_id, last_value(value IGNORE NULLS) OVER (PARTITION BY bus_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value, value IS NOT NULL AS genuine FROM g),
p AS (SELECT bus_id, coalesce((SELECT max(i) FROM c WHERE t <= a), 0) AS i0, coalesce((SELECT min(i) FROM c WHERE t >= b), (SELECT max(i) FROM c)) AS i1, mx >= b AS bounded FROM sp JOIN es USING (bus_id)),
q AS (SELECT p.bus_id, i0 + 1 AS lo, CASE WHEN bounded THEN i1 - 1 ELSE i1 END AS hi FROM p JOIN m y ON y.bus_id = p.bus_id AND y.i = i0 AND y.value IS NOT NULL JOIN m z ON z.bus_id = p.bus_id AND z.i = i1 AND z.value IS NOT NULL WHERE i1 > i0)
SELECT m.i, m.bus_id, CASE WHEN NOT EXISTS (SELECT 1 FROM q WHERE q.bus_id = m.bus_id AND m.i BETWEEN lo AND hi) THEN value END AS value, genuine FROM m""")
def split_strokes(spark: SparkSession, d: str) -> DataFrame:
    """The merged series, blanked where a stroke would be extrapolation."""
    s = model.settled(value_series(spark, d))
    start = (s.agg(F.min("t")).first()[0] or 0.0) - 1000
    spans = model.settled(series.extrapolated_spans(s, s, start, start + 2000 + 1e9, "bus_id"))
    return series.split_extrapolated(series.merge_series(s, "bus_id", spans), s, spans, "bus_id")[0].select("i", "bus_id", "value", "genuine")


@query(""", w AS (SELECT min(t) AS a FROM s), q AS (SELECT a + 86400.0 * i AS x FROM w, (SELECT unnest([0, 1, 2, 5, 9]) AS i))
SELECT bus_id, x, (SELECT arg_max(value, idx) FROM s WHERE s.bus_id = b.bus_id AND t <= x) AS value FROM (SELECT DISTINCT bus_id FROM s) b, q""")
def value_at_cursor(spark: SparkSession, d: str) -> DataFrame:
    s = value_series(spark, d)
    start = s.agg(F.min("t")).first()[0] or 0.0
    times = spark.createDataFrame([(start + 86400.0 * i,) for i in (0, 1, 2, 5, 9)], "x double")
    return series.value_at(s, times, "bus_id")


@query(""", w AS (SELECT min(t) AS a FROM s)
SELECT bus_id, count(*) FILTER (t BETWEEN a AND a + 100000) AS points, min(value) FILTER (t BETWEEN a AND a + 100000) AS "min", max(value) FILTER (t BETWEEN a AND a + 100000) AS "max",
 round(avg(value) FILTER (t BETWEEN a AND a + 100000), 6) AS mean FROM s, w GROUP BY ALL""")
def cursor_stats(spark: SparkSession, d: str) -> DataFrame:
    s = value_series(spark, d)
    start = s.agg(F.min("t")).first()[0] or 0.0
    return series.cursor_stats(s, start + 100000, start, "bus_id").withColumn("mean", F.round("mean", 6))


@query(""", u AS (SELECT DISTINCT t FROM s), b AS (SELECT DISTINCT bus_id FROM s),
g AS (SELECT u.t, b.bus_id, s.value FROM u CROSS JOIN b LEFT JOIN s ON s.t = u.t AND s.bus_id = b.bus_id)
SELECT t, bus_id, last_value(value IGNORE NULLS) OVER (PARTITION BY bus_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value, value IS NOT NULL AS genuine FROM g""")
def merged_series(spark: SparkSession, d: str) -> DataFrame:
    s = model.settled(value_series(spark, d))
    return series.merge_series(s, "bus_id", backwards=False).drop("i")


@query(""", w AS (SELECT min(t) + 100000 AS a, min(t) + 200000 AS b FROM s), r AS (SELECT s.*, row_number() OVER (PARTITION BY bus_id ORDER BY t, idx) AS rn,
 count(*) FILTER (t < a) OVER (PARTITION BY bus_id) AS lo, count(*) FILTER (t < b) OVER (PARTITION BY bus_id) AS hi FROM s, w)
SELECT bus_id, idx FROM r WHERE rn > lo - 2 AND rn <= hi + 2""")
def window_slice(spark: SparkSession, d: str) -> DataFrame:
    s = value_series(spark, d)
    start = s.agg(F.min("t")).first()[0] or 0.0
    return series.window_slice(s, start + 100000, start + 200000, "bus_id").select("bus_id", "idx")


@query(""", r AS (SELECT bus_id, id, idx, timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY bus_id, id ORDER BY idx) AS step FROM f WHERE direction = 'Rx'),
g AS (SELECT *, greatest(step, 0) AS gap, row_number() OVER (PARTITION BY bus_id, id ORDER BY greatest(step, 0), idx) - 1 AS rn, count(*) OVER (PARTITION BY bus_id, id) AS n FROM r WHERE step IS NOT NULL),
m AS (SELECT *, max(CASE WHEN rn = n // 2 THEN gap END) OVER (PARTITION BY bus_id, id) AS med, max(CASE WHEN rn = CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT) THEN gap END) OVER (PARTITION BY bus_id, id) AS p95 FROM g)
SELECT bus_id, id, count(*) AS gaps, min(med) AS median_ns, min(p95) AS p95_ns, count(*) FILTER (gap < med // 2) AS short FROM m WHERE n >= 10 GROUP BY ALL HAVING min(med) > 0""")
def rx_gaps(spark: SparkSession, d: str) -> DataFrame:
    return measure.rx_gap_stats(frames(spark, d), 10, (1, 1 << 62)).drop("ratio", "short_share")


_VERIFY = ", v AS (SELECT *, lag(counter) OVER (PARTITION BY bus_id, id, extended ORDER BY idx) AS before FROM f WHERE direction = 'Rx'), x AS (SELECT *, before IS NOT NULL AND (before + 1) % 16 <> counter AS bad FROM v)"


@query(_VERIFY + " SELECT idx, bus_id, id, extended, 'counter_skip' AS finding FROM x WHERE bad")
def counter_violations(spark: SparkSession, d: str) -> DataFrame:
    return verify.violations(frames(spark, d), sample_catalog())


@query(_VERIFY + " SELECT bus_id, id, extended, NOT arg_max(bad, idx) AS valid, CASE WHEN arg_max(bad, idx) THEN 'counter_skip' END AS finding FROM x GROUP BY bus_id, id, extended HAVING bool_or(bad)")
def stream_validity(spark: SparkSession, d: str) -> DataFrame:
    return verify.validity(frames(spark, d), sample_catalog())


@query(""", l AS (SELECT bus_id, id, extended, max(idx) AS idx FROM f GROUP BY ALL), le AS (SELECT bus_id, id, extended, max(idx) AS idx FROM f WHERE mode = 0 GROUP BY ALL),
d AS (SELECT b AS bus_id, 256 + i AS id, e AS extended, n AS signal FROM (SELECT unnest(['pt', 'batt', 'body']) AS b), (SELECT unnest(range(16)) AS i), (SELECT unnest([true, false]) AS e), (SELECT unnest(['Value', 'Even']) AS n))
SELECT d.bus_id, d.id, d.extended, signal, f.idx, CASE WHEN signal = 'Value' THEN CAST(raw AS DOUBLE) * 0.01 ELSE CAST(k % 256 AS DOUBLE) * 0.5 + 1.0 END AS value
FROM d LEFT JOIN l ON signal = 'Value' AND l.bus_id = d.bus_id AND l.id = d.id AND l.extended = d.extended LEFT JOIN le ON signal = 'Even' AND le.bus_id = d.bus_id AND le.id = d.id AND le.extended = d.extended
LEFT JOIN f ON f.idx = coalesce(l.idx, le.idx)""")
def signal_snapshot(spark: SparkSession, d: str) -> DataFrame:
    chosen = cat.signal_table(spark, sample_catalog()).filter("signal in ('Value', 'Even')").select("bus_id", "id", "extended", "signal")
    return trace.signal_snapshot(frames(spark, d), sample_catalog(), chosen).select("bus_id", "id", "extended", "signal", "idx", "value")


@query("SELECT bus_id, CAST(sum(CAST(floor(((CASE WHEN extended THEN 67 ELSE 47 END) + 64) * 1000000000::BIGINT / 500000) AS BIGINT)) AS BIGINT) AS busy_ns FROM f GROUP BY ALL")
def bus_load(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).groupBy("bus_id").agg(F.sum(measure.frame_duration_ns(500_000, 2_000_000)).alias("busy_ns"))


def _traffic(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each (bus, id, extended)."""
    return frames(spark, d).groupBy(*model.STREAM_KEY).agg(F.count("*").alias("frames"))


@query(""", n AS (SELECT bus_id, id, extended, count(*) AS frames FROM f GROUP BY ALL)
SELECT c.*, coalesce(frames, 0) AS frames FROM (SELECT 'pt' AS bus_id, 256 + i AS id, false AS extended, 'main' AS winner, 'alt' AS loser FROM (SELECT unnest(range(4)) AS i)) c LEFT JOIN n USING (bus_id, id, extended)""")
def schema_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Ids that two databases define on one bus, and the frames that are decoded by the first."""
    clashes = cat.collision_table(spark, sample_catalog()).drop("winner_message", "loser_message")
    return clashes.join(_traffic(spark, d), list(model.STREAM_KEY), "left").fillna(0, ["frames"])


@query(""", v AS (SELECT b AS bus_id, 256 + i AS id, e AS extended, 'Mode' AS signal, r AS raw, ['idle', 'run', 'hold', 'fault'][r + 1] AS label
FROM (SELECT unnest(['pt', 'batt', 'body']) AS b), (SELECT unnest(range(16)) AS i), (SELECT unnest([true, false]) AS e), (SELECT unnest(range(4)) AS r)
UNION ALL SELECT 'pt', 256 + i, false, 'Extra', r, ['idle', 'run', 'hold', 'fault'][r + 1] FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS r)),
n AS (SELECT bus_id, id, extended, 'Mode' AS signal, mode AS raw, count(*) AS frames FROM f GROUP BY ALL UNION ALL SELECT bus_id, id, extended, 'Extra', k % 16, count(*) FROM f WHERE bus_id = 'pt' AND id < 260 AND NOT extended GROUP BY ALL)
SELECT v.*, coalesce(frames, 0) AS frames FROM v LEFT JOIN n USING (bus_id, id, extended, signal, raw)""")
def value_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled value of the catalogue, and the frames that carry it."""
    labels = cat.value_table(spark, sample_catalog())
    wanted = sorted({(r.bus_id, r.id, r.extended, r.signal) for r in labels.select("bus_id", "id", "extended", "signal").collect()})
    seen = decode.decode_series(frames(spark, d), sample_catalog(), wanted).groupBy(*model.STREAM_KEY, "signal", F.col("value").cast("long").alias("raw")).agg(F.count("*").alias("frames"))
    return labels.join(seen, [*model.STREAM_KEY, "signal", "raw"], "left").fillna(0, ["frames"])


@query(""", p AS (SELECT bus_id, id, extended, bus_id || '/' || ecu || '/' || m || '/' || sig AS path, CASE WHEN bus_id = 'batt' THEN 'Battery' WHEN sig = 'Counter' THEN 'Counters' ELSE '' END AS section FROM (
 SELECT b AS bus_id, 256 + i AS id, e AS extended, 'ECU' || (i % 4) AS ecu, CASE WHEN e THEN 'X' ELSE 'M' END || (256 + i) AS m, sig FROM (SELECT unnest(['pt', 'batt', 'body']) AS b), (SELECT unnest(range(16)) AS i), (SELECT unnest([true, false]) AS e),
 (SELECT unnest(['Value', 'SignedValue', 'K', 'Mode', 'Counter', 'Even', 'Odd', 'BigValue']) AS sig) UNION ALL SELECT 'pt', 256 + i, false, 'ALT', 'Alt' || i, 'Extra' FROM (SELECT unnest(range(4)) AS i))),
n AS (SELECT bus_id, id, extended, count(*) AS frames FROM f GROUP BY ALL)
SELECT section, count(*) AS signals, min(path) AS first_path, CAST(coalesce(sum(frames), 0) AS BIGINT) AS frames FROM p LEFT JOIN n USING (bus_id, id, extended) GROUP BY section""")
def section_arrangement(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the catalogue's signals, and the frames that carry the signals of each."""
    rows = cat.signal_table(spark, sample_catalog()).join(_traffic(spark, d), list(model.STREAM_KEY), "left")
    ext = F.when(F.col("extended"), "x").otherwise("s")
    rows = rows.select(F.concat_ws("|", "bus_id", F.concat_ws(":", ext, F.col("id").cast("string"), "signal")).alias("identity"), "path", F.col("path").alias("ordinal"), "frames")
    given = trace.Sections(["Battery", "Counters", "Battery"], patterns={"Battery": ["^batt/", "("], "Counters": ["/Counter$"]})
    out = trace.arrange_sections(rows, given)
    return out.filter("not is_header").groupBy("section").agg(F.count("*").alias("signals"), F.min("path").alias("first_path"), F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"))


@query("SELECT idx, CASE channel WHEN 0 THEN 'first' ELSE 'second' END AS bus_id FROM f WHERE channel IN (0, 2)")
def channel_routing(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([(0, "first", 0), (2, "second", 1), (0, "late", 2)], "channel int, bus_id string, ord int")
    return model.route(frames(spark, d), mapping).select("idx", "bus_id")


@query(", w AS (SELECT min(timestamp_ns) + 86400000000000 AS a, min(timestamp_ns) + 172800000000000 AS b FROM f) SELECT idx FROM f, w WHERE timestamp_ns BETWEEN a AND b")
def time_window(spark: SparkSession, d: str) -> DataFrame:
    every = frames(spark, d)
    start = every.agg(F.min("timestamp_ns")).first()[0] or 0
    return trace.time_window(every, start + 86_400_000_000_000, start + 172_800_000_000_000, prefix_stop=True).select("idx")


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """An event for every order, at the row of its key."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select(F.col("o_orderkey").cast("long").alias("anchor"), F.col("o_custkey").cast("long").alias("rank"), F.concat(F.lit("note"), F.col("o_orderkey").cast("string")).alias("event"))


@query(""", n AS (SELECT o_orderkey AS anchor, o_custkey AS rank, 'note' || o_orderkey AS event FROM orders WHERE o_orderkey <= (SELECT count(*) FROM f)),
u AS (SELECT idx AS anchor, 1 AS is_frame, 0 AS rank, idx, NULL AS event FROM f UNION ALL SELECT anchor, 0, rank, NULL, event FROM n)
SELECT anchor, is_frame, idx, event, row_number() OVER (ORDER BY anchor, is_frame, rank, event) AS place FROM u""")
def interleaved_events(spark: SparkSession, d: str) -> DataFrame:
    every = frames(spark, d)
    merged = trace.interleave_events(every, _notes(spark, d), every.count())
    return model.with_dense_index(merged, "anchor", "is_frame", "rank", "event", name="place").select("anchor", "is_frame", "idx", "event", (F.col("place") + 1).alias("place"))


@query(""", x AS (SELECT timestamp_ns, min(least_idx) AS least_idx FROM (SELECT timestamp_ns, min(idx) OVER (ORDER BY timestamp_ns DESC) AS least_idx FROM f) GROUP BY ALL),
m AS (SELECT idx, count(*) FILTER (id BETWEEN 256 AND 260) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f)
SELECT 'note' || f.idx AS event, f.timestamp_ns AS ns, before - 5 AS position FROM f JOIN x USING (timestamp_ns) JOIN m ON m.idx = x.least_idx""")
def filtered_positions(spark: SparkSession, d: str) -> DataFrame:
    every = frames(spark, d)
    times = every.select(F.concat(F.lit("note"), F.col("idx").cast("string")).alias("event"), F.col("timestamp_ns").alias("ns"))
    matches = predicate.filter_frames(every, {"id_range": [256, 260]}, sample_catalog())
    return trace.filtered_position_at(every, matches, times, 5)


@query(""", x AS (SELECT bus_id AS series, CASE bus_id WHEN 'body' THEN '' ELSE 'V' END AS unit, min(value) AS lo, max(value) AS hi FROM s GROUP BY ALL)
SELECT series, unit, lo, hi, min(lo) OVER w AS axis_lo, max(hi) OVER w AS axis_hi FROM x WINDOW w AS (PARTITION BY unit)""")
def unit_axes(spark: SparkSession, d: str) -> DataFrame:
    e = series.extents(value_series(spark, d), "bus_id").select(F.col("bus_id").alias("series"), F.when(F.col("bus_id") == "body", "").otherwise("V").alias("unit"), "lo", "hi")
    return series.unit_ranges(e)


@query(""", w AS (SELECT min(t) + 50000 AS a, min(t) + 900000 AS b FROM s), r AS (SELECT s.*, row_number() OVER (PARTITION BY bus_id ORDER BY t, idx) - 1 AS rn, count(*) OVER (PARTITION BY bus_id) AS n FROM s, w WHERE t BETWEEN a AND b)
SELECT bus_id, idx FROM r WHERE rn % CAST(ceil(n / 40.0) AS BIGINT) = 0 OR rn = n - 1""")
def thinned_markers(spark: SparkSession, d: str) -> DataFrame:
    s = value_series(spark, d)
    start = s.agg(F.min("t")).first()[0] or 0.0
    return series.thin_markers(s, start + 50000, start + 900000, 40, "bus_id").select("bus_id", "idx")


@query(", w AS (SELECT min(t) + 123456.5 AS x FROM s), r AS (SELECT s.*, row_number() OVER (PARTITION BY bus_id ORDER BY abs(t - x), t DESC, idx DESC) AS rn FROM s, w) SELECT bus_id, t, value FROM r WHERE rn = 1")
def nearest_sample(spark: SparkSession, d: str) -> DataFrame:
    s = value_series(spark, d)
    start = s.agg(F.min("t")).first()[0] or 0.0
    return series.nearest(s, start + 123456.5, "bus_id")


@query("SELECT bus_id, round(coalesce(regr_slope(value, (timestamp_ns - o) / 1000000), 0) * 60000, 9) AS slope FROM f JOIN s USING (bus_id, idx), (SELECT min(timestamp_ns) AS o FROM f) GROUP BY ALL")
def gauge_slope(spark: SparkSession, d: str) -> DataFrame:
    every = frames(spark, d)
    start = every.agg(F.min("timestamp_ns")).first()[0] or 0
    samples = every.select("bus_id", "idx", ((F.col("timestamp_ns") - start) / F.lit(1e6)).alias("t")).join(value_series(spark, d).select("idx", F.col("value").alias("v")), "idx")
    return measure.slope_per_minute(samples, "bus_id").withColumn("slope", F.round("slope", 9))


@query("SELECT bus_id, round(avg(value), 6) AS mean, max(value) AS \"max\", round(quantile_cont(value, 0.95), 6) AS p95, round(median(value), 6) AS median FROM s GROUP BY ALL")
def gauge_summary(spark: SparkSession, d: str) -> DataFrame:
    out = measure.summary(value_series(spark, d).select("bus_id", F.col("value").alias("v")), "bus_id")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p95", "median")})


@query(""", r AS (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY t, idx) - 1 AS rn, count(*) OVER (PARTITION BY bus_id) // 2 AS h FROM s)
SELECT bus_id, round(avg(value) FILTER (rn >= h) / avg(value) FILTER (rn < h), 9) AS retention FROM r GROUP BY ALL""")
def half_run_retention(spark: SparkSession, d: str) -> DataFrame:
    return measure.retention(value_series(spark, d).select("bus_id", "t", F.col("value").alias("v")), "bus_id").withColumn("retention", F.round("retention", 9))


@query("SELECT idx, (first_value(counter) OVER w + row_number() OVER w) % 16 AS n FROM f WINDOW w AS (PARTITION BY bus_id, id, extended ORDER BY idx)")
def calculated_counter(spark: SparkSession, d: str) -> DataFrame:
    from .operators import encode

    message = sample_catalog().find("pt", 257, False)
    out = encode.apply_calc(frames(spark, d), message, "bus_id", "id", "extended")
    return out.select("idx", decode.raw_value(message.signal("Counter")).alias("n"))


@query("SELECT idx, CAST(least(floor(raw * 0.01 + 0.5), 255) AS BIGINT) AS k FROM f")
def encoded_signal(spark: SparkSession, d: str) -> DataFrame:
    from .operators import encode

    message = sample_catalog().find("pt", 257, False)
    value = decode.signal_value(message.signal("Value"), message)
    out = encode.encode_frames(frames(spark, d), message, {"K": value})
    return out.select("idx", decode.raw_value(message.signal("K")).alias("k"))


_SAMPLES = """, h AS (SELECT bus_id, floor((t - a) / 43200) * 43200.0 + 43200.0 AS elapsed_s, count(*) AS n FROM f, (SELECT min(t) AS a FROM f) GROUP BY ALL),
q AS (SELECT bus_id, elapsed_s, CAST(sum(n) OVER (PARTITION BY bus_id ORDER BY elapsed_s) AS BIGINT) AS n FROM h)"""


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Frames so far at the end of each half day of each bus: a run's samples (elapsed_s, count, buffer)."""
    every = frames(spark, d)
    start = (every.agg(F.min("timestamp_ns")).first()[0] or 0) / 1e9
    half_days = F.floor((F.col("timestamp_ns") / F.lit(1e9) - F.lit(start)) / 43200)
    counts = every.groupBy("bus_id", (half_days * 43200.0 + 43200.0).alias("elapsed_s")).agg(F.count("*").alias("n"))  # a row a half day
    total = F.sum("n").over(Window.partitionBy("bus_id").orderBy("elapsed_s"))
    return counts.select("bus_id", "elapsed_s", total.alias("count"), F.least(total, F.lit(5000)).alias("buffer"))


@query(_SAMPLES + """, l AS (SELECT bus_id, max(elapsed_s) AS t, max(n) AS frames FROM q GROUP BY 1), m AS (SELECT q.bus_id, min(elapsed_s) AS ht, arg_min(n, elapsed_s) AS hn FROM q JOIN l USING (bus_id) WHERE n >= frames // 2 GROUP BY 1),
k AS (SELECT bus_id, min((n - pn) / (elapsed_s - pt)) AS slow FROM (SELECT *, lag(n) OVER w AS pn, lag(elapsed_s) OVER w AS pt FROM q WINDOW w AS (PARTITION BY bus_id ORDER BY elapsed_s)) GROUP BY 1),
r AS (SELECT bus_id, frames, t AS elapsed_s, frames / t AS fps, CASE WHEN t > ht THEN hn / ht ELSE frames / t END AS a, CASE WHEN t > ht THEN (frames - hn) / (t - ht) ELSE frames / t END AS b, slow FROM l JOIN m USING (bus_id) JOIN k USING (bus_id))
SELECT bus_id, frames, elapsed_s, round(fps, 9) AS fps, round(a, 9) AS fps_first_half, round(b, 9) AS fps_second_half, round(b / a, 9) AS retention, round(slow, 9) AS slowest_fps FROM r""")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    out = report.run_report(_samples(spark, d), "bus_id")
    return out.withColumns({c: F.round(c, 9) for c in ("fps", "fps_first_half", "fps_second_half", "retention", "slowest_fps")})


@query(_SAMPLES + """, x AS (SELECT 'frames' AS metric, bus_id AS run, CAST(max(n) AS DOUBLE) AS value FROM q GROUP BY bus_id UNION ALL SELECT 'half_days', bus_id, CAST(count(*) AS DOUBLE) FROM q GROUP BY bus_id UNION ALL SELECT 'other', bus_id, 1.0 FROM q GROUP BY bus_id),
z AS (SELECT metric, avg(value) AS base, CASE WHEN metric = 'frames' THEN 1.25 ELSE 1.0 END AS factor, CASE WHEN metric = 'frames' THEN 10.0 ELSE 0.5 END AS floor FROM x WHERE metric <> 'other' GROUP BY metric),
g AS (SELECT metric, run, base, value AS current FROM x JOIN z USING (metric) WHERE metric = 'frames' UNION ALL SELECT metric, NULL, min(base), median(value) FROM x JOIN z USING (metric) WHERE metric = 'half_days' GROUP BY metric)
SELECT metric, run, round(base, 6) AS baseline, round(current, 6) AS current, round(base * factor + floor, 6) AS "limit", current <= base * factor + floor AS pass FROM g JOIN (SELECT metric, factor, floor FROM z) USING (metric)""")
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """Each bus as a run, judged against the mean of all; the number of half days as a drift, by its median."""
    of = _samples(spark, d).groupBy("bus_id").agg(F.max("count").cast("double").alias("frames"), F.count("*").cast("double").alias("half_days"), F.lit(1.0).alias("other"))
    runs = model.held(of.unpivot("bus_id", ["frames", "half_days", "other"], "metric", "value").withColumnRenamed("bus_id", "run"))
    first = F.col("metric") == "frames"
    baseline = runs.filter("metric <> 'other'").groupBy("metric").agg(F.avg("value").alias("value"))
    baseline = baseline.select("metric", "value", F.when(first, 1.25).otherwise(1.0).alias("factor"), F.when(first, 10.0).otherwise(0.5).alias("floor"), F.when(first, "worst").otherwise("drift").alias("family"))
    return report.gate(runs, baseline).withColumns({c: F.round(c, 6) for c in ("baseline", "current", "limit")})


_TABLES = """, t8 AS (SELECT list(v ORDER BY i) AS v8 FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c >= 128 THEN xor((c * 2) & 255, 29) ELSE c * 2 END) AS v FROM range(256) AS r(i))),
t16 AS (SELECT list(v ORDER BY i) AS u FROM (SELECT i, list_reduce([i * 256] || range(8), lambda c, k: CASE WHEN c >= 32768 THEN xor((c * 2) & 65535, 4129) ELSE c * 2 END) AS v FROM range(256) AS r(i))),
y AS (SELECT *, [raw % 256, raw // 256, k % 256, mode, counter, k % 256, raw // 256, raw % 256] AS b FROM f)"""


@query(_TABLES + """ SELECT idx, xor(list_reduce([255::BIGINT] || b, lambda c, x: v8[xor(c, x) + 1]), 255) AS crc8,
 list_reduce([65535::BIGINT, 90, 1] || b[2:7], lambda c, x: xor((c * 256) & 65535, u[xor(c >> 8, x) + 1])) AS crc16 FROM y, t8, t16""")
def payload_checksums(spark: SparkSession, d: str) -> DataFrame:
    """CRC-8/SAE-J1850 of whole payloads; CRC-16/IBM-3740 of bytes 1 to 6 behind two bytes of their own."""
    data = F.col("data")
    return frames(spark, d).select("idx", crc_column(data, "CRC-8/SAE-J1850", 0, 8).alias("crc8"), crc_column(data, "CRC-16/IBM-3740", 1, 7, b"\x5a\x01").alias("crc16"))


@query(_TABLES + """, z AS (SELECT idx, b, (first_value(counter) OVER w + row_number() OVER w) % 16 AS n FROM y WINDOW w AS (PARTITION BY bus_id, id, extended ORDER BY idx))
SELECT idx, n, xor(list_reduce([255::BIGINT, 90] || b[1:4] || [n], lambda c, x: v8[xor(c, x) + 1]), 255) AS crc FROM z, t8""")
def calculated_checksum(spark: SparkSession, d: str) -> DataFrame:
    """Counters stepped per stream, then a checksum over the stepped bytes."""
    from .operators import encode

    message = sample_catalog().find("pt", 257, False)
    rule = CrcConfig("Odd", "CRC-8/SAE-J1850", 0, 40, b"\x5a")
    out = encode.apply_calc(frames(spark, d), message, "bus_id", "id", "extended", checksum=rule)
    return out.select("idx", decode.raw_value(message.signal("Counter")).alias("n"), raw_bits(F.col("data"), 40, 8, True).alias("crc"))


@query("SELECT idx FROM f WHERE idx > (SELECT max(idx) FROM f) - 300")
def drop_oldest(spark: SparkSession, d: str) -> DataFrame:
    from .streaming import live

    return live.drop_oldest(frames(spark, d), 300).select("idx")


@query(""", r AS (SELECT idx, bus_id, mode, timestamp_ns, count(*) OVER (PARTITION BY bus_id, mode ORDER BY timestamp_ns RANGE BETWEEN 86399999999999 PRECEDING AND CURRENT ROW) - 1 AS n FROM f)
SELECT idx, n < 20 AS shown FROM r""")
def log_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    from .streaming import live

    mode = decode.mux_selector(sample_catalog().find("pt", 257, False))
    messages = frames(spark, d).select("idx", F.col("bus_id").alias("source"), mode.alias("template"), F.col("timestamp_ns").alias("t"))
    return live.rate_limited(messages, 20, 86_400_000_000_000).select("idx", "shown")


@query("SELECT o_orderkey AS pos, f.idx, bus_id, timestamp_ns FROM orders JOIN f ON f.idx = o_custkey")
def fetched_rows(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("long").alias("idx"))
    return trace.rows_at(frames(spark, d), wanted).select("pos", "idx", "bus_id", "timestamp_ns")


@query(""", w AS (SELECT min(t) + 100000 AS a, min(t) + 400000 AS b FROM s)
SELECT bus_id, count(*) FILTER (t BETWEEN a AND b) AS points, min(value) FILTER (t BETWEEN a AND b) AS "min", max(value) FILTER (t BETWEEN a AND b) AS "max",
 arg_max(value, idx) FILTER (t <= a) AS value_a, arg_max(value, idx) FILTER (t <= b) AS value_b, round(arg_max(value, idx) FILTER (t <= b) - arg_max(value, idx) FILTER (t <= a), 6) AS delta FROM s, w GROUP BY ALL""")
def measurement_set(spark: SparkSession, d: str) -> DataFrame:
    s = value_series(spark, d)
    start = s.agg(F.min("t")).first()[0] or 0.0
    out = series.measurements(s, start + 100000, start + 400000, "bus_id")
    return out.select("bus_id", "points", "min", "max", "value_a", "value_b", F.round("delta", 6).alias("delta"))


@query(", w AS (SELECT min(t) + 100000 AS a FROM s) SELECT bus_id, count(*) FILTER (t >= a AND t < a + 100000) AS points FROM s, w GROUP BY ALL")
def window_points(spark: SparkSession, d: str) -> DataFrame:
    s = value_series(spark, d)
    start = s.agg(F.min("t")).first()[0] or 0.0
    return series.window_count(s, start + 100000, start + 200000, "bus_id")


@query("SELECT min(t) AS t0, max(t) AS t1 FROM s")
def series_span(spark: SparkSession, d: str) -> DataFrame:
    return series.time_span(value_series(spark, d))


@query(_MODE + """, c AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> value THEN 1 ELSE 0 END) OVER (PARTITION BY bus_id ORDER BY t, idx) AS run FROM m),
g AS (SELECT bus_id, run, min(t) AS t0, max(t) AS own, min(value) AS value FROM c GROUP BY ALL),
p AS (SELECT bus_id, value, t0, coalesce(lead(t0) OVER (PARTITION BY bus_id ORDER BY run), own) AS t1 FROM g)
SELECT a.bus_id, greatest(a.t0, b.t0) AS from_t, least(a.t1, b.t1) AS to_t FROM p a JOIN p b ON a.bus_id = 'pt' AND b.bus_id = 'body' AND a.value = 0 AND b.value = 3 AND a.t0 < b.t1 AND b.t0 < a.t1""")
def lane_overlaps(spark: SparkSession, d: str) -> DataFrame:
    runs = series.segments(mode_series(spark, d), "bus_id")
    span = lambda bus, mode: runs.filter((F.col("bus_id") == bus) & (F.col("value") == mode)).select(F.lit("pt").alias("bus_id"), F.col("t0").alias("from_t"), F.col("t_end").alias("to_t"))
    return series.overlaps(span("pt", 0), span("body", 3), "bus_id")


@query(_VERIFY + " SELECT idx, CASE WHEN bad THEN 'counter_skip' END AS finding FROM f LEFT JOIN (SELECT idx, bad FROM x WHERE bad) USING (idx)")
def rows_with_violations(spark: SparkSession, d: str) -> DataFrame:
    every = frames(spark, d)
    return verify.with_violations(every, every, sample_catalog()).select("idx", "finding")


@query("SELECT CAST(sum(1000.0 / (10 + k % 90)) AS DECIMAL(18, 4)) AS rate_hz FROM f")
def schedule_rate(spark: SparkSession, d: str) -> DataFrame:
    k = decode.raw_value(sample_catalog().find("pt", 257, False).signal("K"))
    out = measure.schedule_rate(frames(spark, d).select((F.lit(10) + F.pmod(k, F.lit(90))).alias("period_ms")))
    return out.select(F.col("rate_hz").cast("decimal(18,4)").alias("rate_hz"))


@query("SELECT idx, channel, bus_id FROM (SELECT *, row_number() OVER (PARTITION BY bus_id, id, extended ORDER BY idx DESC) AS rn FROM f WHERE idx >= 1000 AND idx < 6000) WHERE rn = 1")
def latest_in_range(spark: SparkSession, d: str) -> DataFrame:
    return trace.latest_by_key(frames(spark, d), 1000, 6000, "bus_id", "id", "extended").select("idx", "channel", "bus_id")
