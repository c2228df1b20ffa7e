"""As-of values, merges, split strokes, overlaps and order statistics against brute-force versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from busloom import model
from busloom.operators import measure, series

SERIES = "k string, idx long, t double, value double"
SPANS = "k string, from_t double, to_t double"


def some_series(rng, keys=("a", "b", None), n=120):
    rows = [(k, i, float(rng.randrange(200)), None if rng.random() < 0.05 else float("nan") if rng.random() < 0.05 else float(rng.randrange(9))) for k in keys for i in range(n)]
    return rows + [("single", 0, 55.0, 7.0)]


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def held_value(rows, key, x):
    """(value, genuine): the last sample with a value at or before x."""
    before = [(t, i, v) for k, i, t, v in rows if k == key and t <= x and v is not None]
    if not before:
        return None, False
    t, _, v = max(before, key=lambda r: r[:2])
    return plain(v), t == x


@pytest.mark.parametrize("few", [64, 2])
def test_as_of(spark, monkeypatch, few):
    monkeypatch.setattr(series, "FEW", few)
    monkeypatch.setattr(series, "BLOCK", 4)
    rows = some_series(random.Random(few))
    df = spark.createDataFrame(rows, SERIES).repartition(4)
    xs = [-1.0, 0.0, 17.5, 55.0, 55.0, 60.0, 61.0, 150.25, 199.0, 500.0, None]
    times = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {(r.k, r.x): (plain(r.value), r.genuine) for r in series.as_of(df, times, "k").collect()}
    want = {(k, x): held_value(rows, k, x) for k in ("a", "b", None, "single") for x in xs if x is not None}
    assert got == want
    assert series.value_at(df, times.limit(0), "k").count() == 0 and series.value_at(df.limit(0), times, "k").count() == 0
    model.free()


def test_plans_have_no_task_per_key(spark):
    """No window over the bare key, no cross join."""
    rng = random.Random(1)
    df = spark.createDataFrame(some_series(rng), SERIES)
    plan = series.merge_series(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    windows = [line for line in plan.splitlines() if "Window [" in line and "windowspecdefinition" in line]
    assert windows and all("_part" in line for line in windows)
    model.free()


def merged_brute(rows, keys, spans=()):
    xs = {t for _, _, t, _ in rows}
    for k, a, b in spans:
        own = [t for kk, _, t, _ in rows if kk == k]
        if own and a >= min(own) and b <= max(own):
            xs.add((a + b) / 2)
    xs, out = sorted(xs), {}
    for k in keys:
        own = [r for r in rows if r[0] == k]
        for i, x in enumerate(xs):
            v, genuine = held_value(rows, k, x)
            out[k, i] = (x, plain(own[0][3]) if len(own) == 1 else v, genuine)
    return xs, out


def test_merge_and_split(spark, monkeypatch):
    monkeypatch.setattr(series, "FEW", 2)
    monkeypatch.setattr(series, "BLOCK", 5)
    rng = random.Random(3)
    rows = [("a", i, float(t), float(t % 7)) for i, t in enumerate([0, 1, 2, 40, 41, 90])]
    rows += [("b", i, i * 1.5, float(i)) for i in range(60)]
    rows += [("single", 0, 30.0, 5.0)]
    spans = [("a", -5.0, 0.0), ("a", 2.0, 40.0), ("a", 41.0, 90.0), ("a", 90.0, 300.0), ("b", 88.5, 300.0), ("single", -5.0, 30.0), ("single", 30.0, 300.0), ("gone", 0.0, 5.0)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), SERIES).repartition(3)
    sp = spark.createDataFrame(spans, SPANS)
    merged = series.merge_series(df, "k", sp)
    xs, want = merged_brute(rows, ("a", "b", "single"), spans)
    assert {(r.k, r.i): (r.t, plain(r.value), r.genuine) for r in merged.collect()} == want
    split, stretches = series.split_extrapolated(merged, df, sp, "k")
    cells, dashed = {at: v[1] for at, v in want.items()}, []
    for k, a, b in spans:
        own = [t for kk, _, t, _ in rows if kk == k]
        if not own:
            continue
        i0 = max([i for i, x in enumerate(xs) if x <= a], default=0)
        i1 = min([i for i, x in enumerate(xs) if x >= b], default=len(xs) - 1)
        if i1 <= i0 or cells[k, i0] is None or cells[k, i1] is None:
            continue
        for i in range(i0 + 1, i1 if max(own) >= b else i1 + 1):
            cells[k, i] = None
        dashed.append((k, i0, i1))
    assert {(r.k, r.i): plain(r.value) for r in split.collect()} == cells and split.count() == len(cells)
    assert sorted((r.k, r.i0, r.i1) for r in stretches.collect()) == sorted(dashed) and len(dashed) >= 5
    alone = series.merge_series(df.filter("k = 'single'"), "k", None, (0.0, 99.0))
    assert sorted((r.t, r.value, r.genuine) for r in alone.collect()) == [(0.0, 5.0, False), (30.0, 5.0, True), (99.0, 5.0, False)]
    model.free()


def test_overlaps(spark):
    rng = random.Random(5)

    def lane(n):
        return [(rng.choice("xy"), a := rng.uniform(0, 100), a + rng.choice([0.0, 0.5, 3.0, 60.0]) * rng.random()) for _ in range(n)]

    a, b = lane(70), lane(50)
    want = sorted((k, max(a0, b0), min(a1, b1)) for k, a0, a1 in a for kk, b0, b1 in b if k == kk and a0 < b1 and b0 < a1)
    got = series.overlaps(spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS), "k").collect()
    assert sorted((r.k, r.from_t, r.to_t) for r in got) == want and len(want) > 50
    assert series.overlaps(spark.createDataFrame(a, SPANS).limit(0), spark.createDataFrame(b, SPANS), "k").count() == 0


@pytest.mark.parametrize(("cells", "left"), [(1024, 4096), (4, 3), (16, 1)])
def test_order_statistics(spark, monkeypatch, cells, left):
    monkeypatch.setattr(measure, "CELLS", cells)
    monkeypatch.setattr(measure, "LEFT", left)
    rng = random.Random(cells)
    inf = float("inf")
    groups = {"a": [rng.gauss(0, 1) for _ in range(301)], "b": [5.0] * 50, "c": [1.0], None: [1e308, -1e308, 0.0, 2.0, inf, -inf, inf, 3.0], "d": [10.0**-k for k in range(40)], "e": [float("nan"), 1.0, 2.0, float("nan")]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, v double").repartition(3)
    got = {r.k: (r.n, [plain(v) for v in r["at"]]) for r in measure.order_statistics(df, lambda n: [F.floor(n / 2), F.floor(n * 95 / 100), F.lit(0), n - 1], "k").collect()}
    want = {}
    for k, vs in groups.items():
        ordered, n = sorted(vs, key=lambda v: (math.isnan(v), v)), len(vs)
        want[k] = (n, [plain(ordered[i]) for i in (n // 2, n * 95 // 100, 0, n - 1)])
    assert got == want
    model.free()


def test_summary_and_gaps(spark):
    rng = random.Random(8)
    rows = [("a", rng.uniform(-5, 5)) for _ in range(77)] + [("b", 1.0), ("b", 2.0), ("empty", None)]
    got = {r.k: r for r in measure.summary(spark.createDataFrame(rows, "k string, v double"), "k").collect()}
    of = sorted(v for k, v in rows if k == "a")
    assert got["a"].median == of[38] and got["a"].p95 == pytest.approx(of[72] * 0.8 + of[73] * 0.2) and (got["b"].median, got["empty"].p95) == (1.5, 0.0)
    frames = [(i, i * 10 + rng.randrange(7), "x", 1 + i % 2, "Rx" if i % 5 else "Tx") for i in range(400)]
    df = spark.createDataFrame(frames, "idx long, timestamp_ns long, bus_id string, id long, direction string").repartition(4)
    stats = {r.id: r for r in measure.rx_gap_stats(df, 10, (0, 1 << 60)).collect()}
    for own in (1, 2):
        times = [t for _, t, _, i, d in frames if i == own and d == "Rx"]
        gaps = [max(0, b - a) for a, b in zip(times, times[1:], strict=False)]
        ordered, n = sorted(gaps), len(gaps)
        r = stats[own]
        assert (r.gaps, r.median_ns, r.p95_ns, r.short) == (n, ordered[n // 2], ordered[int(n * 0.95)], sum(g < ordered[n // 2] // 2 for g in gaps))
    model.free()
