"""Sequential rules against plain loops: heatmap, breaker, alerts, orders, clustering, solvers."""

import math
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from forcemap.functions.constants import LEVERAGE_SHARES
from forcemap.operators import accounts, bootstrap, cluster, compare, heatmap, models, scorecard, snapshots
from forcemap.streaming import sinks, state

T0 = datetime(2024, 1, 1)


def candles(symbol, n, seed, shrink):
    r = random.Random(seed)
    price, out = 100.0, []
    for i in range(n):
        o = price
        price = max(5.0, price * (1 + r.uniform(-0.02, 0.02)))
        hi, lo = max(o, price) * (1 + r.random() * 0.01), min(o, price) * (1 - r.random() * 0.01)
        delta = r.uniform(0, 1000) if r.random() < 0.7 else -r.uniform(0, shrink)
        out.append((symbol, T0 + timedelta(hours=i), o, hi, lo, price, delta))
    return out


def loop_fold(rows, width):
    """The rule as a plain loop: cross, open, shrink, snapshot."""
    active, cells, counts = [], {}, {}
    for sym, t, o, hi, lo, c, delta in rows:
        crossed = [a for a in active if (lo <= a[1] if a[0] == "long" else hi >= a[1])]
        active = [a for a in active if not (lo <= a[1] if a[0] == "long" else hi >= a[1])]
        created = 0
        if delta > 0:
            side = "short" if c < o else "long"
            for lev, share in LEVERAGE_SHARES.items():
                liq = c * (1 - 1 / lev + 0.004) if side == "long" else c * (1 + 1 / lev - 0.004)
                active.append([side, liq, delta * share])
                created += 1
        elif delta < 0 and active:
            whole = sum(a[2] for a in active)
            if whole > 0:
                keep = 1 - min(-delta / whole, 1.0)
                active = [[s, p, v * keep] for s, p, v in active]
                active = [a for a in active if a[2] >= 0.01]
        counts[(sym, t)] = (created, len(crossed))
        for s, p, v in active:
            cell = cells.setdefault((sym, t, math.floor(p / width) * width), [0.0, 0.0])
            cell[0 if s == "long" else 1] += v
    return cells, counts


@pytest.mark.parametrize("shrink", [1500.0, 20000.0, 200000.0])
def test_heatmap_matches_loop(spark, shrink):
    data = candles("a", 150, 1, shrink) + candles("b", 90, 2, shrink)
    df = spark.createDataFrame(data, "symbol string, open_time timestamp, open double, high double, low double, close double, oi_delta double")
    cells, counts = loop_fold([d for d in data if d[0] == "a"], 5.0)
    more, more_counts = loop_fold([d for d in data if d[0] == "b"], 5.0)
    cells.update(more)
    counts.update(more_counts)
    numbered, segments, factors = heatmap.evolve(df)
    grid = heatmap.snapshots(numbered, segments, factors, 5.0)
    got = {(r.symbol, r.open_time, r.price_bucket): (r.long_density, r.short_density) for r in grid.collect()}
    assert set(got) == set(cells)
    for k, (a, b) in cells.items():
        assert got[k] == (pytest.approx(a, rel=1e-7, abs=1e-6), pytest.approx(b, rel=1e-7, abs=1e-6))
    per = {(r.symbol, r.open_time): (r.created, r.consumed) for r in heatmap.counters(numbered, factors, grid).collect()}
    assert per == counts
    # Stopping half way and resuming from the stored state changes nothing.
    cut = spark.createDataFrame([("a", T0 + timedelta(hours=70)), ("b", T0 + timedelta(hours=40))], "symbol string, last_time timestamp")
    early = df.join(cut, "symbol").filter("open_time <= last_time").drop("last_time")
    n1, s1, f1 = heatmap.evolve(early)
    later, _ = heatmap.resume(df, cut, heatmap.final_state(s1, f1), 5.0)
    both = {(r.symbol, r.open_time, r.price_bucket): r.long_density + r.short_density for r in heatmap.snapshots(n1, s1, f1, 5.0).unionByName(later).collect()}
    assert set(both) == set(cells)
    assert all(both[k] == pytest.approx(sum(v), rel=1e-7, abs=1e-6) for k, v in cells.items())
    # The streaming fold gives the same totals.
    rows = pd.DataFrame([d[1:] for d in data if d[0] == "a"], columns=["open_time", "open", "high", "low", "close", "oi_delta"])
    none = np.array([])
    live, *_ = state.fold_candles(rows, none.astype(bool), none, none, LEVERAGE_SHARES)
    for t, created, consumed, long, short, _ in live:
        assert (created, consumed) == counts[("a", t.to_pydatetime())]
        whole = sum(sum(v) for (s, tt, _), v in cells.items() if s == "a" and tt == t.to_pydatetime())
        assert long + short == pytest.approx(whole, rel=1e-7, abs=1e-6)


def test_long_heatmap_with_restarts_of_the_factor(spark):
    r, price, data = random.Random(3), 100.0, []
    for i in range(5000):
        o = price
        price = min(400.0, max(25.0, price * (1 + r.uniform(-0.02, 0.02))))
        hi, lo = max(o, price) * 1.004, min(o, price) * 0.996
        data.append(["a", T0 + timedelta(hours=i), o, hi, lo, price, r.uniform(0, 1000)])
    # Two of three candles shrink what is open by 15 percent; the volumes come from the loop itself.
    active, out = [], []
    for i, row in enumerate(data):
        _, t, o, hi, lo, c, _ = row
        active = [a for a in active if not (lo <= a[1] if a[0] == "long" else hi >= a[1])]
        if i % 3:
            whole = sum(a[2] for a in active)
            row[6] = -0.15 * whole if whole else -1.0
            active = [[s, p, v * 0.85] for s, p, v in active if v * 0.85 >= 0.01]
        else:
            side = "short" if c < o else "long"
            active += [[side, c * (1 - 1 / lev + 0.004) if side == "long" else c * (1 + 1 / lev - 0.004), row[6] * share] for lev, share in LEVERAGE_SHARES.items()]
        out.append(tuple(row))
    df = spark.createDataFrame(out, "symbol string, open_time timestamp, open double, high double, low double, close double, oi_delta double")
    numbered, segments, factors = heatmap.evolve(df)
    assert segments.agg({"epoch": "max"}).first()[0] >= 5
    cells, _ = loop_fold(out, 5.0)
    got = {(x.symbol, x.open_time, x.price_bucket): (x.long_density, x.short_density) for x in heatmap.snapshots(numbered, segments, factors, 5.0).collect()}
    # A level within rounding of the floor may leave one candle earlier or later.
    assert len(set(got) ^ set(cells)) <= 0.001 * len(cells)
    worst = max(abs(got[k][j] - cells[k][j]) / max(1.0, cells[k][j]) for k in set(got) & set(cells) for j in (0, 1))
    assert worst < 0.011


def test_fold_grows_linearly():
    import time

    def run(n):
        rows = [("a", True, t, -1.0 if t % 3 else 1.0, None, None, None, None) for t in range(n)]
        rows += [("a", False, t, 100.0, t, "long", 50.0, t + 40 if t + 40 < n else None) for t in range(0, n, 3)]
        frame = pd.DataFrame(rows, columns=["symbol", "is_candle", "t", "volume", "level", "side", "liq", "t_cross"])
        start = time.process_time()
        heatmap._fold(frame)
        return time.process_time() - start

    run(500)
    assert run(20_000) < 40 * max(run(2_000), 0.01)


def test_breaker_rule():
    s = state.empty_breaker()
    out = [state.breaker_step(s, float(i * 60), -1.0, 3, -100.0, 10, 300.0) for i in range(9)]
    assert [o[0] for o in out] == [True, True, True, False, False, False, False, True, True]
    assert out[3][1] == "consecutive_losses"
    s = state.empty_breaker()
    out = [state.breaker_step(s, float(i), 1.0, 3, -100.0, 4, 0.0) for i in range(6)]
    assert [o[1] for o in out] == ["", "", "", "", "rate_limit", "rate_limit"]


@pytest.mark.parametrize("seed", range(12))
def test_breaker_by_stretches_equals_one_signal_at_a_time(seed, monkeypatch):
    """Stretches of any window, in batches or alone, against a loop that only counts what the rule speaks of."""
    from forcemap.streaming import breaker

    r = random.Random(seed)
    limits = breaker.Limits(r.choice([2, 4, 99]), r.choice([-12.0, -1e9]), r.choice([1, 3, 8]), r.choice([0.0, 600.0, 5000.0]))
    times = np.cumsum([r.choice([0.0, 30.0, 200.0, 2000.0]) for _ in range(400)])
    results = np.array([r.choice([-1.5, -0.5, 0.0, 1.0]) for _ in range(400)])
    want, passed, total, run, halted = [], [], 0.0, 0, None
    for now, x in zip(times, results, strict=True):
        if halted and limits.cooldown and now - halted[1] >= limits.cooldown:
            halted, run = None, 0
        if not halted:
            met = [("consecutive_losses", run >= limits.losses), ("session_drawdown", total <= limits.drawdown), ("rate_limit", sum(p > now - 3600 for p in passed) >= limits.per_hour)]
            halted = next(((name, now) for name, yes in met if yes), None)
            if not halted:
                passed.append(now)
                total, run = total + x, run + 1 if x < 0 else 0
                met = [("consecutive_losses", run >= limits.losses), ("session_drawdown", total <= limits.drawdown)]
                halted = next(((name, now) for name, yes in met if yes), None)
                want.append("")
                continue
        want.append(halted[0])
    monkeypatch.setattr(breaker, "WINDOW", r.choice([1, 7, 256]))
    for size in (400, 13, 1):
        b, got = breaker.Breaker(), []
        for i in range(0, 400, size):
            got += breaker.pass_signals(b, times[i : i + size], results[i : i + size], limits)
        assert got == want
        assert len(b.recent) <= limits.per_hour


def test_breaker_loops_over_halts_only():
    """A million signals with few halts take few searches."""
    import time

    from forcemap.streaming import breaker

    n = 1_000_000
    times, results = np.arange(n) * 400.0, np.where(np.arange(n) % 50_000 < 5, -1.0, 1.0)
    begun = time.perf_counter()
    reasons = breaker.pass_signals(breaker.Breaker(), times, results, breaker.Limits(4, -1e9, 10, 1800.0))
    assert time.perf_counter() - begun < 3 and reasons.count("consecutive_losses") == 20 * 4


@pytest.mark.parametrize("cap", [3, 50])
def test_alerts_match_loop(spark, cap):
    r = random.Random(5)
    data = sorted(((i, r.choice("xyz"), T0 + timedelta(minutes=r.randrange(0, 4 * 24 * 60))) for i in range(150)), key=lambda d: (d[2], d[0]))
    last, per_day, want = {}, {}, []
    for i, zone, ts in data:
        if zone in last and ts - last[zone] < timedelta(hours=3):
            continue
        if per_day.get(ts.date(), 0) >= cap:
            continue
        last[zone] = ts
        per_day[ts.date()] = per_day.get(ts.date(), 0) + 1
        want.append(i)
    df = spark.createDataFrame(data, "alert_id long, zone string, ts timestamp")
    none = spark.createDataFrame([], "zone string, last_ts timestamp")
    got = sinks.send_alerts(df, none, 3 * 3600, cap).collect()
    assert sorted(x.alert_id for x in got) == sorted(want)


def test_alert_cap_holds_over_any_split_into_batches(spark, tmp_path):
    r = random.Random(6)
    data = sorted(((i, r.choice("xyz"), T0 + timedelta(minutes=r.randrange(0, 3 * 24 * 60))) for i in range(120)), key=lambda d: (d[2], d[0]))
    last, per_day, want = {}, {}, []
    for i, zone, ts in data:
        if zone in last and ts - last[zone] < timedelta(hours=1):
            continue
        if per_day.get(ts.date(), 0) >= 9:
            continue
        last[zone], per_day[ts.date()] = ts, per_day.get(ts.date(), 0) + 1
        want.append(i)
    schema = "alert_id long, zone string, ts timestamp"
    for n, size in enumerate((40, 120)):
        folder = tmp_path / str(n)
        for part in range(0, len(data), size):
            spark.createDataFrame(data[part : part + size], schema).coalesce(1).write.mode("append").parquet(str(folder))
        files = sorted(folder.glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
        for i, f in enumerate(files):
            os.utime(f, (1_700_000_000 + i * 10,) * 2)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        assert sorted(x.alert_id for x in sinks.run_alerts(stream, 3600, 9).collect()) == sorted(want)


def test_resting_orders_match_block_loop(spark):
    r = random.Random(9)
    rows = []
    for seq in range(600):
        kind = r.choice(["status", "book"])
        rows.append(
            (r.randrange(3), r.randrange(4), seq // 3, seq, kind, r.choice(["open", "open", "triggered", "canceled"]) if kind == "status" else None,
             kind == "book" and r.random() < 0.1, "BTC", r.choice(["A", "B"]), r.choice([None, float(seq)]), None, r.choice([None, True, False]) if kind == "status" else None,
             float(seq) * 2 if kind == "book" and r.random() < 0.8 else None)
        )
    names = "account long, oid int, block long, seq long, kind string, status string, removed boolean, coin string, side string, limit_px double, orig_size double, reduce_only boolean, book_size double"
    got = {(x.account, x.oid): (x.side, x.limit_px, x.size) for x in accounts.resting_orders(spark.createDataFrame(rows, names)).collect()}
    live = {}
    for b in sorted({x[2] for x in rows}):
        for key in {(x[0], x[1]) for x in rows if x[2] == b}:
            ev = [x for x in rows if x[2] == b and (x[0], x[1]) == key]
            o = live.get(key, {"meta": False, "px": None, "side": None, "bside": None, "size": None, "bpx": None, "book": False})
            if any((x[4] == "status" and x[5] == "canceled") or (x[4] == "book" and x[6]) for x in ev):
                live.pop(key, None)
                continue
            for x in ev:
                if x[4] == "status":
                    o["px"] = x[9] if x[9] is not None else (o["px"] if o["meta"] else 0.0)
                    o["meta"], o["side"] = True, x[8]
            books = [x for x in ev if x[4] == "book"]
            if books:
                o["book"], o["bside"] = True, books[-1][8]
                known = [x[9] for x in books if x[9] is not None]
                o["bpx"] = known[0] if known else o["bpx"]
                sizes = [x[12] for x in books if x[12] is not None]
                o["size"] = sizes[-1] if sizes else (o["size"] or 0.0)
            live[key] = o
    want = {k: (o["side"] or o["bside"], o["px"] if o["meta"] else o["bpx"], o["size"]) for k, o in live.items() if o["book"]}
    assert got == want


@pytest.mark.parametrize("eps,k", [(0.05, 4), (0.15, 6)])
def test_dbscan_matches_plain(spark, eps, k):
    r = random.Random(11)
    pts = [(i, min(1.0, max(0.0, r.gauss(cx, 0.05))), min(1.0, max(0.0, r.gauss(cy, 0.05)))) for i, (cx, cy) in enumerate([(0.2, 0.2)] * 60 + [(0.7, 0.6)] * 60 + [(r.random(), r.random()) for _ in range(40)])]
    pts += [(1000 + i, 0.9, 0.1) for i in range(8)]  # Copies of one point.
    df = spark.createDataFrame([("s", *p) for p in pts], "g string, id long, x double, y double")
    got = {x.id: (x.is_core, tuple(x.cluster) if x.cluster else None) for x in cluster.dbscan(df, ["g"], F.lit(eps), k).collect()}
    xy = np.array([p[1:] for p in pts])
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)) <= eps
    core = d.sum(1) >= k
    label, n = [-1] * len(pts), 0
    for i in range(len(pts)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], n
            while stack:
                j = stack.pop()
                for m in np.flatnonzero(d[j] & core):
                    if label[m] < 0:
                        label[m] = n
                        stack.append(m)
            n += 1
    assert [got[p[0]][0] for p in pts] == core.tolist()
    pairs = {(label[i], got[pts[i][0]][1]) for i in range(len(pts)) if core[i]}
    assert len(pairs) == n == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    name = dict((b, a) for a, b in pairs)
    for i, p in enumerate(pts):
        near = {label[m] for m in np.flatnonzero(d[i] & core)}
        c = got[p[0]][1]
        assert (c is None and not near) or name[c] in near
    kd = {x.id: x.k_distance for x in cluster.neighbour_distance(df, ["g"], k).collect()}
    dist = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)), axis=1)[:, k - 1]
    assert all(kd[p[0]] == pytest.approx(dist[i]) for i, p in enumerate(pts))


@pytest.mark.parametrize("spread", [1e-6, 3e-11])
def test_neighbours_of_points_closer_than_any_fixed_grid(spark, spread):
    """All points within a millionth, twice: a grid that goes on to any depth finds the right neighbours."""
    r = random.Random(2)
    xy = [(c + spread * r.random(), c + spread * r.random()) for c in (0.25, 0.7) for _ in range(150)] + [(0.9, 0.1), (0.91, 0.12)]
    xy += xy[:3]
    df = spark.createDataFrame([(i, "g", x, y) for i, (x, y) in enumerate(xy)], "id long, g string, x double, y double")
    got = {row.id: row.k_distance for row in cluster.neighbour_distance(df, ["g"], 4).collect()}
    a = np.array(xy)
    want = np.sort(np.sqrt(((a[:, None] - a[None]) ** 2).sum(2)), axis=1)[:, 3]
    assert len(got) == len(xy) and all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-300) for i in range(len(xy)))


@pytest.mark.parametrize("gap,linked", [(0.0999, True), (0.1001, False)])
def test_two_tight_cells_of_very_many_points_are_compared_box_by_box(spark, gap, linked):
    """A hundred thousand points in two cells at nearly eps: few boxes meet, and no points."""
    n, eps = 50_000, 0.1
    ids = spark.range(2 * n).withColumn("k", (F.col("id") < n).cast("int"))
    spread = F.pmod(F.xxhash64("id"), F.lit(10**6)) / 1e6 * 0.002
    high = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**6)) / 1e6 * 0.02
    points = ids.select("id", F.lit("g").alias("g"), F.when(F.col("k") == 1, F.lit(0.2) - spread).otherwise(F.lit(0.2 + gap) + spread).alias("x"), (F.lit(0.5) + high).alias("y"))
    met = []

    def watch(pairs):
        met.append(pairs)
        return pairs

    cores = points.withColumn("eps", F.lit(eps)).withColumn("cx", F.floor(F.col("x") / (eps / math.sqrt(2)))).withColumn("cy", F.floor(F.col("y") / (eps / math.sqrt(2))))
    edges = cluster._dense_edges(cores, ["g"], watch).count()
    xs = points.select("x", "y", "id").collect()
    left = sorted(((r["x"], r["y"]) for r in xs if r["id"] < n), reverse=True)[:400]
    right = sorted((r["x"], r["y"]) for r in xs if r["id"] >= n)[:400]
    assert any(math.hypot(a - c, b - d) <= eps for a, b in left for c, d in right) == linked
    assert (edges > 0) == linked
    assert sum(p.count() for p in met) < n  # of 2,500 million pairs of points


def test_portfolio_price_solves_the_buffer(spark):
    rows = [("u1", 5.0, 100.0, 0.0, None), ("u2", -5.0, 100.0, 2.0, 200.0), ("u3", 5.0, 100.0, 0.0, None), ("u4", 0.001, 100.0, 0.0, None)]
    marked = spark.createDataFrame([(u, "c", s, m) for u, s, m, *_ in rows], "account string, coin string, size double, mark double")
    margin = spark.createDataFrame([("u1", 30.0, 300.0), ("u2", 30.0, 300.0), ("u3", 500.0, 300.0), ("u4", 30.0, 300.0)], "account string, requirement double, liquidation_value double")
    spot = spark.createDataFrame([("u2", "c", 2.0, 0.5, 200.0)], "account string, coin string, spot_total double, ltv double, supply_cap double")
    got = {r.account: r.portfolio_px for r in accounts.portfolio_close_prices(marked, margin, spot).collect()}

    def need(size, p):
        n = abs(size) * p
        rate, cut = next((b, c) for a, b, c in accounts.FLOOR_TIERS if n >= a)
        return max(0.0, n * rate - cut)

    p = got["u1"]
    assert 0.95 * max(0.0, 300 + 5 * (p - 100)) == pytest.approx(30 + need(5, p) - need(5, 100), abs=1e-6)
    assert got["u2"] > 100 and got["u3"] == 100.0  # Already past its buffer: the mark itself.
    assert got["u4"] is None  # No price of so small a leg can use the buffer up.


def test_bootstrap_dominance_statistics(spark):
    r = random.Random(3)
    rows = [("g", e, r.random() < p, r.random() < 0.5, int(r.gauss(m, 10)), 5) for e, p, m in (("a", 0.8, 120), ("b", 0.4, 100)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, expert string, touched boolean, confirmed boolean, mfe_bps long, mae_bps long")
    got = {x.metric: x for x in bootstrap.dominance(df, ["g"], replicates=400).collect()}
    assert got["touch_probability"].p_a_better > 0.99 and got["touch_probability"].significant
    assert got["mfe_p50"].p_a_better > 0.99
    assert (got["mae_p50"].p_a_better, got["mae_p50"].significant) == (0.5, False)
    assert 0.0 < got["confirm_probability"].p_a_better < 1.0
    # One expert's bootstrap mean has the spread of a binomial share.
    counts = bootstrap._values(df, ["g"], "expert")
    reps = [x.m for x in bootstrap.replicate_metrics(counts, ["g"], 1000, 1).filter("metric = 'touch_probability' AND expert = 'a'").collect()]
    share = sum(1 for x in rows if x[1] == "a" and x[2]) / 200
    assert np.mean(reps) == pytest.approx(share, abs=0.01) and np.std(reps) == pytest.approx((share * (1 - share) / 200) ** 0.5, rel=0.2)


def test_peaks_match_greedily(spark):
    shapes = spark.createDataFrame(
        [("s", "p", x, v, 0.0) for x, v in ((-0.5, 1.0), (0.0, 0.8), (0.5, 0.6))] + [("s", "q", x, v, 0.0) for x, v in ((-0.4, 1.0), (0.1, 0.9), (0.9, 0.1))],
        "symbol string, provider string, x double, v double, cum double",
    )
    got = compare.peak_distances(shapes, ["symbol"], 3).collect()[0]
    assert (got.mean_distance, got.max_distance) == (pytest.approx((0.1 + 0.1 + 0.4) / 3), pytest.approx(0.4))


def test_volume_clock_matches_loop(spark):
    r = random.Random(4)
    ticks = [("a", T0 + timedelta(seconds=i * 7), 1.0, None if r.random() < 0.02 else float(r.randrange(0, 50))) for i in range(300)]
    anchors = [(i, "a", T0 + timedelta(seconds=r.randrange(0, 2300))) for i in range(60)]
    t = spark.createDataFrame(ticks, "symbol string, ts timestamp, price double, volume double")
    a = spark.createDataFrame(anchors, "obs_id long, symbol string, touch_ts timestamp")
    got = {x.obs_id: (x.clock_state, x.clock_ts) for x in scorecard.volume_clock(a, t, "obs_id", "touch_ts", 400.0, 600, 900.0).collect()}
    for i, _, at in anchors:
        total, want = 0.0, ("incomplete", None)
        for _, ts, _, v in ticks:
            if ts < at:
                continue
            if v is None:
                want = ("missing", None)
                break
            total += v
            if total >= 400:
                want = ("closed", ts)
                break
        assert got[i] == want


def test_depth_and_ensemble_confidence(spark):
    levels = spark.createDataFrame([("s", "long", 90.0, 10.0), ("s", "short", 111.0, 10.0), ("s", "short", 105.0, 10.0)], "symbol string, side string, price_level double, volume double")
    book = spark.createDataFrame([("s", "bid", 95.0, 1.0), ("s", "bid", 85.0, 9.0), ("s", "ask", 110.0, 2.0), ("s", "ask", 111.0, 1.0)], "symbol string, side string, price double, size double")
    got = {(r.side, r.price_level): r.depth for r in models.book_depth(levels, book, 10.0).collect()}
    assert got == {("long", 90.0): 95.0, ("short", 111.0): 331.0, ("short", 105.0): 0.0}


def test_blocked_snapshot_has_no_levels(spark):
    grid = spark.createDataFrame([("s", T0), ("s", T0 + timedelta(hours=5))], "symbol string, snapshot_ts timestamp")
    prices = spark.createDataFrame([("s", T0 - timedelta(hours=1), 100.0)], "symbol string, ts timestamp, price double")
    interest = spark.createDataFrame([], "symbol string, ts timestamp, oi_value double")
    got = [(r.price_status, r.oi_status, r.status, r.open_interest) for r in snapshots.collect_inputs(grid, prices, interest).orderBy("snapshot_ts").collect()]
    assert got == [("fresh", "fallback", "partial", 500000.0), ("stale", "fallback", "blocked_source_missing", 500000.0)]


def test_signal_matches_once_in_any_batches(spark, tmp_path):
    """One match a signal, the earliest of its window, however the time-ordered rows fall into batches."""
    r = random.Random(4)
    rows = []
    for i in range(300):
        signal = i % 2 == 0
        rows.append((i, signal, f"{'btc' if i % 3 else 'eth'}{'-perp' if signal else ''}", r.choice(["long", "short"]), 100.0 * math.exp(r.uniform(-0.05, 0.05)), T0 + timedelta(minutes=i)))
    want = {}
    for i, signal, sym, side, price, ts in rows:
        if signal:
            near = [e for e in rows if not e[1] and e[2] == sym[:3] and e[3] == side and ts <= e[5] <= ts + timedelta(minutes=30) and abs(price - e[4]) / price * 100 <= 1]
            if near:
                want[i] = min(near, key=lambda e: (e[5], e[0]))[0]
    schema = "id long, is_signal boolean, symbol string, side string, price double, ts timestamp"
    for batches in (1, 6):
        folder = str(tmp_path / f"rows{batches}")
        size = len(rows) // batches
        for b in range(batches):
            spark.createDataFrame(rows[b * size : (b + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        signals = stream.filter("is_signal").withColumnRenamed("id", "signal_id").drop("is_signal")
        events = stream.filter("NOT is_signal").withColumnRenamed("id", "event_id").drop("is_signal")
        got = sinks.run_to_table(state.correlate_stream(signals, events), "matches").collect()
        assert len(got) == len({x.signal_id for x in got})
        assert {x.signal_id: x.event_id for x in got} == want


def test_heatmap_fold_is_linear_in_candles_and_levels():
    """Four times the candles and levels, up to 50,000 candles of a symbol, take about four times as long."""
    import time

    took = []
    for n in (12_500, 50_000):
        r = np.random.default_rng(0)
        delta = np.where(r.random(n) < 0.6, r.random(n) * 1000, -r.random(n) * 900)
        series = pd.DataFrame({"symbol": "s", "is_candle": True, "t": np.arange(1, n + 1), "volume": delta, "level": np.nan, "side": None, "liq": np.nan, "t_cross": np.nan})
        up = np.repeat(np.flatnonzero(delta > 0) + 1, 5)
        levels = pd.DataFrame({"symbol": "s", "is_candle": False, "t": up, "volume": delta[up - 1] / 5, "level": up * 1000 + np.arange(len(up)) % 5, "side": "long", "liq": 50.0})
        cross = up + r.integers(1, 2000, len(up))
        levels["t_cross"] = np.where((r.random(len(up)) < 0.8) & (cross <= n), cross, np.nan)
        rows = pd.concat([series, levels], ignore_index=True)
        begun = time.process_time()
        out = heatmap._fold(rows)
        took.append(time.process_time() - begun)
        assert len(out[out["is_candle"]]) == n and set(out["reason"]) >= {"consumed", "open", "dropped"}
    assert took[1] < 8 * took[0]


def _days(spark, first, n, copies=1):
    rows = [(d * 100 + i, T0 + timedelta(days=d, minutes=i), float(i + c)) for d in range(first, first + n) for i in range(20) for c in range(copies)]
    return spark.createDataFrame(rows, "id long, ts timestamp, x double")


def test_keyed_table_reads_only_the_days_it_touches(spark, tmp_path):
    """Files read per batch stay the same while the table grows; replays read nothing and change nothing."""
    rows = _days(spark, 0, 1)
    table = sinks.KeyedTable(str(tmp_path / "t"), rows.schema, ["id", "ts"], ["x"])
    read = [len(table.add(_days(spark, d, 2, copies=2).repartition(3), d)) for d in range(8)]
    assert read[0] == 0 and set(read[2:]) == {read[2]} and read[2] > 0
    assert table.add(_days(spark, 3, 2), 3) == []
    want = {(d * 100 + i, float(i)) for d in range(9) for i in range(20)}
    assert sorted((r["id"], r["x"]) for r in table.rows(spark).collect()) == sorted(want)


def test_keyed_table_after_a_batch_that_was_stopped(spark, tmp_path):
    """A batch stored in part and without its marker is completed, not doubled."""
    rows = _days(spark, 0, 3)
    table = sinks.KeyedTable(str(tmp_path / "t"), rows.schema, ["id", "ts"], ["x"])
    stopped = sinks.KeyedTable(str(tmp_path / "t"), rows.schema, ["id", "ts"], ["x"])
    part = rows.filter("id % 3 = 0")
    part.withColumn("_folder", stopped.folder).write.mode("append").partitionBy("_folder").parquet(f"{stopped.path}/rows")
    table.add(rows, 0)
    assert table.rows(spark).count() == 60 and table.rows(spark).select("id").distinct().count() == 60
    plain = sinks.KeyedTable(str(tmp_path / "u"), rows.schema, ["id"], ["x"])
    plain.add(rows.union(rows), 0)
    plain.add(rows, 1)
    assert plain.rows(spark).count() == 60 and sinks.KeyedTable(str(tmp_path / "none"), rows.schema, ["id"], ["x"]).rows(spark).count() == 0


def test_live_cells_equal_one_run_for_any_batches(spark, tmp_path):
    """Batches of any size, one repeated and one stopped half-way, give the cells of the whole series."""
    from forcemap.streaming import livemap

    schema = "symbol string, open_time timestamp, open double, high double, low double, close double, oi_delta double"
    rows = candles("a", 60, 1, 3000.0) + candles("b", 45, 2, 300.0)
    whole = {(r.symbol, r.open_time, r.price_bucket): (r.long_density, r.short_density) for r in heatmap.heatmap(spark.createDataFrame(rows, schema), 2.0).collect()}
    for k, cuts in enumerate(([0, 105], [0, 7, 30, 61, 105])):
        live = livemap.LiveHeatmap(str(tmp_path / f"h{k}"), 2.0)
        by_time = sorted(rows, key=lambda x: (x[1], x[0]))
        for b in range(len(cuts) - 1):
            batch = spark.createDataFrame(by_time[cuts[b] : cuts[b + 1]], schema)
            if b == 1:  # Stopped before its marker: what it wrote doesn't count and is written over.
                batch.limit(3).select("symbol", F.col("open").alias("price_bucket"), F.lit(1.0).alias("long_density"), F.lit(1.0).alias("short_density"), "open_time").write.parquet(f"{live.path}/cells/batch=1")
            live.add(batch, b)
            live.add(batch, b)
        got = {(r.symbol, r.open_time, r.price_bucket): (r.long_density, r.short_density) for r in live.cells(spark).collect()}
        assert got.keys() == whole.keys() and len(whole) > 100
        assert all(got[c] == pytest.approx(whole[c]) for c in whole)
        assert live.cells(spark).count() == len(whole)


@pytest.mark.parametrize("seed", range(8))
def test_weights_of_a_whole_series_equal_one_hour_at_a_time(seed):
    """Resets, hours without signals, defaults that don't add up to one, and a rule that can have no weight at all."""
    r = random.Random(seed)
    alpha, least = r.choice([0.1, 0.5, 1.0]), r.choice([0.0, 0.3, 0.6])
    long, short = r.choice([(0.6, 0.4), (0.5, 0.5), (0.7, 0.7)])
    total = np.array([r.choice([0.0, 3.0, 3.0]) for _ in range(300)])
    rate = np.array([r.choice([0.0, 0.25, 0.5, 0.9, r.random()]) for _ in range(300)])
    a, b, want = long, short, []
    for n, x in zip(total, rate, strict=True):
        if x < least:
            a, b = long, short
        elif n > 0:
            up, down = alpha * x + (1 - alpha) * a, alpha * x + (1 - alpha) * b
            a, b = (up / (up + down), down / (up + down)) if up + down > 0 else (long, short)
        want.append((a, b))
    got = sinks.smoothed(total, rate, alpha, least, long, short)
    if alpha < 1.0 or least > 0:
        assert np.allclose(np.array(want), np.stack(got, axis=1), atol=1e-12)
    else:  # With nothing kept of the past, an hour without hits falls back to the defaults.
        assert np.allclose(np.array(want)[:, 0], got[0], atol=1e-12)
    assert sinks.smoothed(np.zeros(0), np.zeros(0), alpha, least, long, short)[0].shape == (0,)


def _late_rows(seed=9, n=160):
    """Signals and events by arrival: each comes up to nine minutes after its time, in no order."""
    r = random.Random(seed)
    rows = [(900, True, "btc-perp", "long", 100.0, T0), (901, False, "btc", "long", 100.2, T0 + timedelta(minutes=31)), (902, False, "btc", "long", 100.1, T0 + timedelta(minutes=29))]
    for i in range(n):
        signal = i % 2 == 0
        rows.append((i, signal, f"{'btc' if i % 3 else 'eth'}{'-perp' if signal else ''}", r.choice(["long", "short"]), 100.0 * math.exp(r.uniform(-0.03, 0.03)), T0 + timedelta(minutes=20 + 2 * i, seconds=r.randrange(100))))
    return sorted(rows, key=lambda x: (x[5] + timedelta(minutes=r.uniform(0, 9)) if x[0] < 900 else T0 + timedelta(minutes=31 + (x[0] == 902) * 2)))


def _expected_matches(rows):
    want = {}
    for i, signal, sym, side, price, ts in rows:
        near = [e for e in rows if signal and not e[1] and e[2] == sym[:3] and e[3] == side and ts <= e[5] <= ts + timedelta(minutes=30) and abs(price - e[4]) / price * 100 <= 1]
        if near:
            want[i] = min(near, key=lambda e: (e[5], e[0]))[0]
    return want


def test_late_event_matches_however_rows_fall_into_batches(spark, tmp_path):
    """Late rows within the delay change no match: at once or one by one, given early and bettered or only when final."""
    rows = _late_rows()
    want = _expected_matches(rows)
    assert want[900] == 902 and len(want) > 15
    schema = "id long, is_signal boolean, symbol string, side string, price double, ts timestamp"
    for batches in (1, 11):
        for final in (False, True):
            folder = str(tmp_path / f"late{batches}{final}")
            path, check = str(tmp_path / f"out{batches}{final}"), str(tmp_path / f"check{batches}{final}")
            size = -(-len(rows) // batches)
            for b in range(batches):
                spark.createDataFrame(rows[b * size : (b + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
            beats = str(tmp_path / f"beats{batches}{final}")
            closing = spark.createDataFrame([(T0 + timedelta(days=1),)], "ts timestamp")
            closing.limit(0).write.parquet(beats)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
            signals = stream.filter("is_signal").withColumnRenamed("id", "signal_id").drop("is_signal")
            events = stream.filter("NOT is_signal").withColumnRenamed("id", "event_id").drop("is_signal")
            make = lambda: state.correlate_stream(signals, events, final=final, beats=spark.readStream.schema(closing.schema).parquet(beats))  # noqa: B023, E731
            run = sinks.run_to_table if final else sinks.run_matches
            run(make(), "m", path, check)
            closing.write.mode("append").parquet(beats)
            got = run(make(), "m", path, check).collect()
            assert len(got) == len({x.signal_id for x in got})
            assert {x.signal_id: x.event_id for x in got} == want, (batches, final)
            assert all(x.event_ts.replace(tzinfo=None) == next(r[5] for r in rows if r[0] == x.event_id).replace(tzinfo=None) for x in got)


def test_scorecard_ignores_repeated_observations(spark):
    obs = [(i, f"e{i % 2}", "s", T0, 100.0 + i % 5, "long", 0.5, 10) for i in range(40)]
    o = spark.createDataFrame(obs, "obs_id long, expert string, symbol string, snapshot_ts timestamp, level_price double, side string, confidence double, distance_bps long")
    t = spark.createDataFrame([("s", T0 + timedelta(minutes=i), 100.0 + i % 7) for i in range(200)], "symbol string, ts timestamp, price double")
    f = spark.createDataFrame([("s", "long", T0 + timedelta(minutes=i), 100.0 + i % 3) for i in range(200)], "symbol string, side string, event_ts timestamp, event_price double")
    once = scorecard.scorecard_bundle(o, t, f, ["e0", "e1", "e2"]).toPandas()
    twice = scorecard.scorecard_bundle(o.union(o), t, f, ["e0", "e1", "e2"]).toPandas()
    order = ["part", "expert", "symbol"]
    pd.testing.assert_frame_equal(once.sort_values(order, ignore_index=True), twice.sort_values(order, ignore_index=True))
    assert once["part"].value_counts().to_dict() == {"slice": 2, "gap": 1, "leader": 1}
    assert once.loc[once["part"] == "slice", "sample_count"].sum() == 40


def _snapshot_inputs(spark, step_minutes, hours, odd=0, seed=6):
    r = random.Random(seed)
    trades = [("ab"[i % 4 == 0], T0 + timedelta(seconds=60 * r.randrange(60 * hours) if i % 5 == 0 else r.uniform(0, 3600 * hours)), 100.0 * math.exp(r.gauss(0, 0.05)), r.choice(["buy", "sell"]), r.uniform(500, 5000)) for i in range(1500)]
    grid = [(s, T0 + timedelta(minutes=m + odd), 100.0 * math.exp(r.gauss(0, 0.03)), r.choice([1e4, 3e6, 9e7]), r.choice(["available", "available", "partial", "blocked_source_missing"])) for s in "abc" for m in range(0, 60 * hours, step_minutes)]
    return grid, trades, spark.createDataFrame(grid, "symbol string, snapshot_ts timestamp, price double, open_interest double, status string"), spark.createDataFrame(trades, "symbol string, ts timestamp, price double, side string, gross_value double")


@pytest.mark.parametrize("odd,lookback,unit", [(0, 6 * 3600, 3600), (17, 5 * 3600 + 120, 3600), (0, 1800, 3600), (7, 40 * 60, 600)])
def test_snapshot_cells_equal_every_trade_in_the_look_back(spark, odd, lookback, unit):
    from forcemap.functions.constants import MAINTENANCE_TIERS

    grid, trades, inputs, t = _snapshot_inputs(spark, 90, 12, odd)
    want = {}
    for sym, at, mark, oi, status in grid:
        rate = next((rate for cap, rate, _ in MAINTENANCE_TIERS if oi <= cap), MAINTENANCE_TIERS[0][1])
        for s, ts, price, side, gross in trades:
            if status.startswith("blocked") or s != sym or not at - timedelta(seconds=lookback) <= ts <= at:
                continue
            for lev in LEVERAGE_SHARES:
                liq = price * ((1 - 1 / lev) + rate) if side == "buy" else price * ((1 + 1 / lev) - rate)
                if (liq < mark) if side == "buy" else (liq > mark):
                    key = (sym, at, "long" if side == "buy" else "short", math.floor(liq / 2.0 + 0.5) * 2.0)
                    want[key] = want.get(key, 0.0) + gross / len(LEVERAGE_SHARES)
    got = snapshots.snapshot_cells(inputs, t, lookback, 2.0, unit).groupBy("symbol", "snapshot_ts", "side", "price_level").agg(F.sum("volume").alias("v")).collect()
    assert {(r["symbol"], r["snapshot_ts"].replace(tzinfo=None), r["side"], r["price_level"]): pytest.approx(r["v"]) for r in got} == want


def test_snapshot_rows_dont_follow_look_back_over_step(spark):
    """Eight times the look-back reads few more rows a snapshot: one more block for each doubling."""
    read = {}
    for hours in (4, 32):
        _, _, inputs, t = _snapshot_inputs(spark, 60, 48)
        seen = []

        def watch(name, rows):
            seen.append((name, rows))  # noqa: B023
            return rows

        snapshots.snapshot_cells(inputs, t, hours * 3600, 2.0, 3600, watch).count()
        counts = {name: rows.count() for name, rows in seen}
        read[hours] = counts["blocks"]
    assert read[32] < 3 * read[4], read


ORDER_EVENTS = "account long, oid int, block long, seq long, kind string, status string, removed boolean, coin string, side string, limit_px double, reduce_only boolean, book_size double"


def _order_loop(rows):
    """State of the orders block by block: {key: alive, coin, side, limit_px, size, status, reduce_only, seen}."""
    live = {}
    for b in sorted({x[2] for x in rows if x[2] is not None}):
        for key in {x[:2] for x in rows if x[2] == b}:
            ev = [x for x in rows if x[2] == b and x[:2] == key]
            s = live.pop(key, {"alive": False, "coin": None, "side": None, "limit_px": None, "size": None, "status": None, "reduce_only": None, "seen": False})
            status, book = [x for x in ev if x[4] == "status"], [x for x in ev if x[4] == "book"]
            if any(x[5] == "canceled" for x in status) or any(x[6] for x in book):
                continue
            if status and not s["seen"]:
                s["seen"], s["limit_px"] = True, 0.0
            for x in status:
                for name, i in (("status", 5), ("coin", 7), ("side", 8), ("limit_px", 9), ("reduce_only", 10)):
                    s[name] = x[i] if x[i] is not None else s[name]
            if book:
                s["alive"] = True
                s["limit_px"] = s["limit_px"] if s["seen"] else next((x[9] for x in book if x[9] is not None), s["limit_px"])
                for name, i in (("coin", 7), ("side", 8)):
                    s[name] = s[name] if s[name] is not None else next((x[i] for x in reversed(book) if x[i] is not None), None)
                s["size"] = next((x[11] for x in reversed(book) if x[11] is not None), s["size"] if s["size"] is not None else 0.0)
            if status or book or s["alive"] or s["seen"]:
                live[key] = s
    return live


@pytest.mark.parametrize("seed", [1, 2])
def test_orders_folded_batch_by_batch_equal_the_block_loop(spark, seed):
    """Any split at a block gives the loop's state, null keys and values included; no row is handed to Python."""
    r = random.Random(seed)
    maybe = lambda x: x if r.random() < 0.6 else None
    rows = []
    for seq in range(500):
        status = r.random() < 0.45
        rows.append((r.choice([1, 2, None]), r.choice([0, 1, None]), None if r.random() < 0.02 else seq // 4, seq, r.choice(["status" if status else "book"] * 9 + [None]),
                     (maybe(r.choice(["open", "open", "open", "triggered", "canceled"]) if r.random() < 0.3 else "open")) if status else None, (r.random() < 0.08 or None) if not status else None,
                     maybe(r.choice(["BTC", "ETH"])), maybe(r.choice("AB")), maybe(float(seq)), maybe(r.random() < 0.5) if status else None, None if status else maybe(seq * 2.0)))
    want = _order_loop(rows)
    assert len(want) > 4
    for cuts in ([0, 500], [0, 120, 320, 500]):
        now = spark.createDataFrame([], state.ORDER_STATE)
        for a, b in zip(cuts, cuts[1:]):
            now = state.fold_orders(spark.createDataFrame(rows[a:b], ORDER_EVENTS), now)
            assert "Python" not in now._jdf.queryExecution().executedPlan().toString() and "Pandas" not in now._jdf.queryExecution().executedPlan().toString()
            now = spark.createDataFrame(now.collect(), state.ORDER_STATE)
        got = {(x.account, x.oid): {k: v for k, v in x.asDict().items() if k not in ("account", "oid")} for x in now.collect()}
        assert got == want


def test_breaker_walks_long_symbols_in_pieces(spark):
    """Pieces of seven rows and several batches give what one walk over each whole symbol gives."""
    from forcemap.streaming import breaker

    r = random.Random(8)
    limits = breaker.Limits(3, -40.0, 4, 900.0)
    rows = [(i, r.choice(["a", "b", None]), T0 + timedelta(seconds=200 * i + r.randrange(50)), r.uniform(-9, 10)) for i in range(400)]
    want = {}
    for symbol in ("a", "b", None):
        mine = sorted((x for x in rows if x[1] == symbol), key=lambda x: (x[2], x[0]))
        seconds = np.array([(x[2] - datetime(1970, 1, 1)).total_seconds() for x in mine])
        reasons = breaker.pass_signals(breaker.Breaker(), seconds, np.array([x[3] for x in mine]), limits)
        want |= {x[0]: (symbol, why == "", why) for x, why in zip(mine, reasons, strict=True)}
    assert len({w[2] for w in want.values()}) > 2
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        now, got = spark.createDataFrame([], breaker.FOLDED), {}
        for part in (rows[:150], [], rows[150:]):
            df = spark.createDataFrame(part, "signal_id long, symbol string, ts timestamp, pnl double")
            out = breaker.circuit_breaker(df, now, limits.losses, limits.drawdown, limits.per_hour, limits.cooldown).collect()
            got |= {x.signal_id: (x.symbol, x.allowed, x.reason) for x in out if x.state is None}
            now = spark.createDataFrame(out, breaker.FOLDED)
            assert sum(x.state is not None for x in out) == 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == want


def test_matches_are_found_in_bounded_pieces_and_kept_packed(monkeypatch):
    from forcemap.streaming import correlation as c

    r = np.random.default_rng(3)
    signals, events = np.zeros(60, c.SIGNAL_TYPE), np.zeros(300, c.EVENT_TYPE)
    for x in (signals, events):
        x["id"], x["price"], x["us"] = np.arange(len(x)), 100 * np.exp(r.uniform(-0.03, 0.03, len(x))), r.integers(0, 400, len(x))
    signals["event"] = signals["event_us"] = c.NONE
    want = []
    for s in signals:
        near = [(e["us"], e["id"]) for e in events if s["us"] <= e["us"] <= s["us"] + 50 and abs(s["price"] - e["price"]) / s["price"] * 100 <= 1]
        want.append(min(near) if near else (c.NONE, c.NONE))
    for pairs in (1, 40, 1 << 20):
        monkeypatch.setattr(c, "PAIRS", pairs)
        got = signals.copy()
        for part in (events[100:], events[:100]):  # The better event may come later.
            c.best_events(got, part, 1.0, 50)
        assert list(zip(got["event_us"].tolist(), got["event"].tolist())) == [(int(a), int(b)) for a, b in want]

    class Rows:
        kept = []
        put, get, exists = (lambda self, rows: setattr(self, "kept", rows)), (lambda self: iter(self.kept)), (lambda self: bool(self.kept))

    monkeypatch.setattr(c, "PACKED_ROWS", 128)
    kept = Rows()
    c.Correlator._store(kept, events)
    assert len(kept.kept) == 3 and (c.Correlator._load(kept, c.EVENT_TYPE) == events).all()
