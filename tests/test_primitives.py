"""Scans, as-of lookups, interval joins, quantiles and rolling frames against plain Python."""

import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from forcemap.operators import adaptive, firsthit, intervals, quantiles, rolling, scans, trends
from forcemap.operators.intervals import Band

T0 = datetime(2024, 1, 1)


def rows(n=400, seed=1, keys=("a", "a", "a", "b")):
    r = random.Random(seed)
    return [(i, r.choice(keys), T0 + timedelta(seconds=r.randrange(0, 5000)), round(r.uniform(1, 100), 2)) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "id long, k string, ts timestamp, x double")


# A tiny threshold makes every chunk hot, so the splitting path is taken too.
@pytest.mark.parametrize("hot", [None, 2_000_000, 5])
@pytest.mark.parametrize("reverse", [False, True])
def test_scan_matches_loop(spark, hot, reverse):
    data = rows()
    df = frame(spark, data).withColumn("y", F.when(F.col("id") % 3 == 0, F.col("x")))
    got = scans.scan(
        df, ["k"], ["ts", "id"], scans.time_chunk("ts", 600), reverse=reverse, hot_rows=hot,
        total=("sum", "x"), top=("max", "x"), low=("min", "x"), prev=("previous", "x"), seen=("last", "y"),
    ).collect()
    by_id = {r.id: r for r in got}
    assert len(by_id) == len(data)
    for k in "ab":
        total, top, low, prev, seen = 0.0, None, None, None, None
        for i, _, _, x in sorted((d for d in data if d[1] == k), key=lambda d: (d[2], d[0]), reverse=reverse):
            total += x
            top = x if top is None else max(top, x)
            low = x if low is None else min(low, x)
            seen = x if i % 3 == 0 else seen
            r = by_id[i]
            assert r.total == pytest.approx(total) and (r.top, r.low, r.prev, r.seen) == (top, low, prev, seen)
            prev = x


def test_hot_chunks_split_without_a_ceiling(spark):
    """One key at one instant, and more than ten thousand hot chunks: no part is above the threshold."""
    one = spark.range(5000).select("id", F.lit("a").alias("k"), F.lit(T0).alias("ts"))
    many = spark.range(12_000 * 7).select("id", F.lit("a").alias("k"), F.timestamp_seconds(F.floor(F.col("id") / 7) * 600).alias("ts"))
    for df, rows, parts in ((one, 5000, 1000), (many, 84_000, 24_000)):
        cut = scans.with_chunks(df, ["k"], ["ts", "id"], scans.time_chunk("ts", 600), 5)
        sizes = cut.groupBy("k", "_chunk", "_part").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
        got = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("rows"), F.count("*").alias("parts"), F.max(F.col("b") - F.col("a")).alias("span")).first()
        assert (got["most"], got["rows"], got["parts"], got["span"]) == (5, rows, parts, 4)
    total = scans.scan(one.withColumn("x", F.lit(1)), ["k"], ["ts", "id"], scans.time_chunk("ts", 600), hot_rows=5, n=("sum", "x"))
    assert total.filter("n <> id + 1").count() == 0 and total.count() == 5000


def test_hot_slots_are_salted_without_a_ceiling(spark):
    right = spark.range(3000).select(F.col("id").alias("rid"), F.lit("a").alias("k"), F.lit(T0).alias("ts"))
    left = spark.createDataFrame([(1, "a", T0, T0)], "id long, k string, a timestamp, b timestamp")
    joined = intervals.interval_join(left, right, ["k"], "a", "b", "ts", 300, hot_rows=5)
    assert joined.count() == 3000
    assert "explode(sequence(0, (coalesce(_salts" in joined._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("hot", [None, 5])
@pytest.mark.parametrize("forward,strict", [(False, False), (False, True), (True, False), (True, True)])
def test_asof(spark, hot, forward, strict):
    left = [(i, random.Random(i).choice("ab"), float(random.Random(i + 7).randrange(0, 60))) for i in range(120)]
    right = [(k, float(p), float(p) * 10) for k in "ab" for p in random.Random(3).sample(range(0, 60), 25)]
    l = spark.createDataFrame(left, "id long, k string, p double")
    r = spark.createDataFrame(right, "k string, q double, v double")
    got = {x.id: x.v for x in scans.asof(l, r, ["k"], "p", "q", ["v"], lambda c: F.floor(F.col(c) / 7), forward, strict, hot).collect()}
    assert len(got) == len(left)
    for i, k, p in left:
        side = [q for kk, q, _ in right if kk == k]
        fits = [q for q in side if (q > p if strict else q >= p)] if forward else [q for q in side if (q < p if strict else q <= p)]
        want = (min(fits) if forward else max(fits)) * 10 if fits else None
        assert got[i] == want


@pytest.mark.parametrize("hot", [2_000_000, 3])
@pytest.mark.parametrize("banded", [False, True])
def test_interval_join(spark, hot, banded):
    left = [(i, k, ts, ts + timedelta(seconds=700), x * 0.9, x * 1.1) for i, k, ts, x in rows(150, 2)]
    right = rows(300, 3)
    l = spark.createDataFrame(left, "id long, k string, a timestamp, b timestamp, lo double, hi double")
    r = frame(spark, right).select(F.col("id").alias("rid"), "k", "ts", "x")
    band = Band("x", "lo", "hi", 0.05) if banded else None
    got = {(x.id, x.rid) for x in intervals.interval_join(l, r, ["k"], "a", "b", "ts", 300, band, hot).collect()}
    want = {
        (i, rid) for i, k, a, b, lo, hi in left for rid, kk, ts, x in right if k == kk and a <= ts <= b and (not banded or lo <= x <= hi)
    }
    assert got == want


def test_range_extremes_and_nearest(spark):
    left = [(i, k, ts, ts + timedelta(seconds=431)) for i, k, ts, _ in rows(120, 4)]
    right = rows(300, 5)
    l = spark.createDataFrame(left, "id long, k string, a timestamp, b timestamp")
    r = frame(spark, right)
    got = {x.id: (x.low, x.high) for x in intervals.range_extremes(l, r, "id", ["k"], "a", "b", "ts", "x", 60, 600).collect()}
    for i, k, a, b in left:
        xs = [x for _, kk, ts, x in right if kk == k and a <= ts <= b]
        assert got.get(i) == ((min(xs), max(xs)) if xs else None)
    near = intervals.nearest(l.select("id", "k", "a"), r.select("k", "ts", "x"), ["id"], ["k"], "a", "ts", 30, ["x"]).collect()
    for row in near:
        close = sorted((abs((ts - row.a).total_seconds()), ts) for _, kk, ts, _ in right if kk == row.k and abs((ts - row.a).total_seconds()) < 30)
        assert row.matched_ts == (close[0][1] if close else None)


@pytest.mark.parametrize("hot", [None, 5])
def test_quantiles(spark, hot):
    data = rows(301, 6)
    df = frame(spark, data)
    lin = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "x", {"q": 0.9, "m": 0.5}, 5.0, hot_rows=hot).collect()}
    idx = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "x", {"q": 0.75}, 5.0, "index", hot_rows=hot).collect()}
    exc = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "x", {"a": 0.25, "b": 0.75}, 5.0, "exclusive", 4, hot_rows=hot).collect()}
    for k in "ab":
        xs = sorted(x for _, kk, _, x in data if kk == k)
        pos = (len(xs) - 1) * 0.9
        assert lin[k].q == pytest.approx(xs[int(pos)] + (xs[int(pos) + 1] - xs[int(pos)]) * (pos - int(pos)))
        assert lin[k].m == pytest.approx(statistics.median(xs))
        assert idx[k].q == xs[int(len(xs) * 0.75)]
        cuts = statistics.quantiles(xs, n=4)
        assert (exc[k].a, exc[k].b) == (pytest.approx(cuts[0]), pytest.approx(cuts[2]))


def test_equal_frequency_boundaries(spark):
    data = rows(200, 8, keys=("a",))
    b = adaptive.equal_frequency(frame(spark, data), ["k"], "x", 5.0, 10).collect()[0]
    xs = [x for *_, x in data]
    assert b.boundaries == pytest.approx([min(xs), *statistics.quantiles(xs, n=5), max(xs)])
    few = adaptive.equal_frequency(frame(spark, data[:15]), ["k"], "x", 5.0, 10).collect()[0]
    assert (few.buckets, len(few.boundaries)) == (1, 2)


@pytest.mark.parametrize("block", [8, 65_536])
def test_rolling_and_ema_blocks(spark, block):
    data = [(i, "a", T0 + timedelta(seconds=i), float(i % 7 + i / 10)) for i in range(60)]
    df = frame(spark, data)
    chunk = scans.time_chunk("ts", 10)
    got = {r.id: r.m for r in rolling.rolling(df, ["k"], ["ts"], chunk, 3, {"m": rolling.mean_of("x")}, None, block).collect()}
    xs = [d[3] for d in data]
    for i in range(60):
        assert got[i] == pytest.approx(statistics.mean(xs[max(0, i - 2) : i + 1]))
    ema = {r.id: r.ema for r in trends.exponential_average(df, ["k"], ["ts"], "x", 0.3, chunk, block).collect()}
    e = xs[0]
    for i, x in enumerate(xs):
        e = x if i == 0 else 0.3 * x + 0.7 * e
        assert ema[i] == pytest.approx(e)


def test_correlation_p_value(spark):
    # Known two-sided p-values of the t distribution: t = 2.228 at 10 degrees of freedom is 5 percent.
    t, n = 2.2281388519649385, 12
    r = (t * t / (t * t + n - 2)) ** 0.5
    df = spark.createDataFrame([(r, n), (0.0, 30), (0.999, 50)], "r double, n long")
    p = [x.p for x in df.select(trends.correlation_p_value("r", "n").alias("p")).collect()]
    assert p[0] == pytest.approx(0.05, abs=1e-9) and p[1] == pytest.approx(1.0) and p[2] < 1e-50


def _hit_rows(n, ticks_per_minute, seed=3):
    """A price walk with many ticks a minute, and levels near its path."""
    r = random.Random(seed)
    price, ticks = 100.0, []
    for i in range(180 * ticks_per_minute):
        price *= math.exp(r.gauss(0, 0.0012 / math.sqrt(ticks_per_minute)))
        ticks.append(("ab"[i % 3 == 0], i, T0 + timedelta(seconds=60 * i / ticks_per_minute), round(price, 3)))
    lefts = []
    for i in range(n):
        level = 100.0 * math.exp(r.gauss(0, 0.01))
        start = T0 + timedelta(seconds=r.choice([0, 60 * r.randrange(150), r.uniform(0, 9000)]))
        lefts.append((i, "ab"[i % 2], start, start + timedelta(minutes=r.choice([0, 5, 60, 200])), level * (1 - r.choice([0.0, 0.0001, 0.0005, 0.004])), level * (1 + r.choice([0.0, 0.0005]))))
    lefts += [(n, "a", T0, T0 - timedelta(minutes=1), 1.0, 1e9), (n + 1, "a", T0, T0 + timedelta(days=1), 0.0, 1e9), (n + 2, "z", T0, T0 + timedelta(days=1), 1.0, 1e9), (n + 3, "a", None, T0, 1.0, 2.0), (n + 4, "a", T0, T0 + timedelta(days=1), ticks[2][3], ticks[2][3])]
    return lefts, ticks


LEFT = "id long, k string, a timestamp, b timestamp, lo double, hi double"
TICK = "k string, n long, ts timestamp, price double"


@pytest.mark.parametrize("steps", [(60,), (600, 60, 1)])
def test_first_hit_equals_a_plain_search(spark, steps):
    lefts, ticks = _hit_rows(150, 12)
    ticks += [("a", -5, ticks[9][2], ticks[9][3]), ("a", -9, T0 + timedelta(minutes=7), None), ("a", -8, None, 100.0), ("a", -7, T0, -1.0)]
    got = firsthit.first_hit(
        spark.createDataFrame(lefts, LEFT), spark.createDataFrame(ticks, TICK), "id", ["k"], "a", "b", "lo", "hi", "ts", "price", payload=["n"], window_seconds=3600, steps=steps
    )
    want = {}
    for i, k, a, b, lo, hi in lefts:
        near = [(ts, n, p) for kk, n, ts, p in ticks if kk == k and a and lo > 0 and p and ts and a <= ts <= b and lo <= p <= hi]
        if near:
            want[i] = min(near)
    rows = got.select("id", F.timestamp_micros("hit.us").alias("ts"), "hit.n", "hit.price").collect()
    assert {r["id"]: (r["ts"].replace(tzinfo=None), r["n"], r["price"]) for r in rows} == want
    assert 30 < len(want) < 150


def test_first_hit_takes_an_exact_rule_and_carried_columns(spark):
    lefts, ticks = _hit_rows(80, 6)
    lefts = [(i, k, a, b, (lo + hi) / 2) for i, k, a, b, lo, hi in lefts if a and lo > 0]
    left = spark.createDataFrame(lefts, "id long, k string, a timestamp, b timestamp, level double").withColumn("lo", F.col("level") * 0.98).withColumn("hi", F.col("level") * 1.02)
    got = firsthit.first_hit(left, spark.createDataFrame(ticks, TICK), "id", ["k"], "a", "b", "lo", "hi", "ts", "price", accepts=lambda p: F.abs(p - F.col("level")) / F.col("level") * 100 <= 0.25, carry=["level"])
    want = {}
    for i, k, a, b, level in lefts:
        near = [ts for kk, _, ts, p in ticks if kk == k and a <= ts <= b and abs(p - level) / level * 100 <= 0.25]
        if near:
            want[i] = min(near)
    assert {r["id"]: r["ts"].replace(tzinfo=None) for r in got.select("id", F.timestamp_micros("hit.us").alias("ts")).collect()} == want


def test_first_hit_joins_no_more_rows_at_a_higher_tick_rate(spark):
    """Four and sixty times the ticks of the same hours: rows joined follow the index, not the ticks."""
    joined = {}
    for rate in (15, 60, 900):
        lefts, ticks = _hit_rows(60, rate)
        frames = []

        def watch(name, rows):
            frames.append((name, rows))  # noqa: B023
            return rows

        firsthit.first_hit(spark.createDataFrame(lefts, LEFT), spark.createDataFrame(ticks, TICK), "id", ["k"], "a", "b", "lo", "hi", "ts", "price", steps=(600, 60, 1), watch=watch).collect()
        joined[rate] = sum(rows.count() for _, rows in frames)
    assert joined[900] < 3 * joined[15] and joined[900] < 2 * joined[60], joined


@pytest.mark.parametrize("length", [1, 2, 7, 24])
def test_rolling_mean_equals_plain_means(spark, length):
    """Over many blocks and stretches; an infinite value leaves no trace once it is out of the frame."""
    r = random.Random(length)
    rows = [(k, T0 + timedelta(seconds=37 * i), float(r.randrange(100)) if i != 20 else float("inf")) for k, n in (("a", 260), ("b", 5), ("c", 1)) for i in range(n)]
    # Rows without a time have no place, and don't count in the first frames.
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("a", None, 2.0), ("b", None, 3.0)], "k string, ts timestamp, x double")
    out = rolling.rolling_mean(df, ["k"], ["ts"], F.floor(F.unix_seconds("ts") / 600), length, "x", "m", block_rows=32)
    want = {}
    for k in "abc":
        mine = [(ts, x) for kk, ts, x in rows if kk == k]
        want |= {(k, ts): sum(x for _, x in mine[max(0, i - length + 1) : i + 1]) / min(i + 1, length) for i, (ts, _) in enumerate(mine)}
    assert {(x.k, x.ts.replace(tzinfo=None)): x.m for x in out.collect()} == want


def test_first_hit_joins_rectangles_and_blocks_once(spark):
    """What a step finds is written, so the plans of its answers and of the next step don't both hold the step's join."""
    lefts, ticks = _hit_rows(40, 12)
    found = firsthit.first_hit(spark.createDataFrame(lefts, LEFT), spark.createDataFrame(ticks, TICK), "id", ["k"], "a", "b", "lo", "hi", "ts", "price")
    assert "_chunk" not in found._jdf.queryExecution().optimizedPlan().toString()
