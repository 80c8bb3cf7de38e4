"""P: projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from forcemap.functions import columns as C
from forcemap.functions import identifiers
from forcemap.operators import accounts, features, parsing
from forcemap.plans.registry import query


@query(
    "P1",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ts, symbol, side, gross_value FROM trades
       WHERE gross_value >= 60000 AND ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '2000-12-31'""",
)
def large_trades(v):
    return features.large_trades(
        v.trades, 60000.0, F.lit("1996-01-01").cast("timestamp"), F.lit("2000-12-31").cast("timestamp")
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ts", "symbol", "side", "gross_value")


@query(
    "P2",
    """SELECT event_id, floor(price / 2.5) * 2.5e0 AS floored, round(price / 2.5) * 2.5e0 AS nearest,
              mark + round((price - mark) / 0.5e0) * 0.5e0 AS snapped,
              floor((price - 1.25e0) / 2.5e0 + 1e-9) * 2.5e0 + 1.25e0 AS anchored
       FROM ticks JOIN tick_marks USING (symbol)""",
)
def price_bins(v):
    return v.ticks.join(v.tick_marks, "symbol").select(
        "event_id",
        C.floor_bin("price", 2.5).alias("floored"),
        C.nearest_bin("price", 2.5).alias("nearest"),
        C.snap_to_grid("price", "mark", 0.5).alias("snapped"),
        C.anchored_floor_bin("price", F.lit(1.25), 2.5).alias("anchored"),
    )


@query(
    "P3",
    """SELECT event_id, date_trunc('minute', ts) AS m1, time_bucket(INTERVAL '5 minutes', ts) AS m5,
              time_bucket(INTERVAL '15 minutes', ts) AS m15, date_trunc('hour', ts) AS h1,
              time_bucket(INTERVAL '4 hours', ts) AS h4, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d1
       FROM ticks""",
)
def time_floors(v):
    names = {"m1": "1m", "m5": "5m", "m15": "15m", "h1": "1h", "h4": "4h", "d1": "1d"}
    return v.ticks.select("event_id", *[C.floor_time("ts", i).alias(n) for n, i in names.items()])


@query(
    "P4",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CASE WHEN side = 'buy' THEN price * (1 - 1e0 / quantity + 0.004)
                   ELSE price * (1 + 1e0 / quantity - 0.004) END AS liq_price
       FROM trades""",
)
def forced_close_prices(v):
    return v.trades.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        C.forced_close_price("price", "quantity", F.col("side") == "buy").alias("liq_price"),
    )


@query(
    "P5",
    """WITH n AS (SELECT *, gross_value * 100 AS notional FROM trades),
       k AS (SELECT n.*, (SELECT min(t.tier) FROM tiers t WHERE n.notional <= t.cap) AS tier FROM n)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, k.tier,
              CASE WHEN side = 'buy' THEN price * (1 - 1e0 / quantity + rate - amount / notional)
                   ELSE price * (1 + 1e0 / quantity - rate + amount / notional) END AS liq_price
       FROM k JOIN tiers USING (tier)""",
)
def tiered_close_prices(v):
    t = v.trades.withColumn("notional", F.col("gross_value") * 100).withColumn("t", C.tier_of("notional"))
    return t.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("t.tier").alias("tier"),
        C.forced_close_price(
            "price", "quantity", F.col("side") == "buy", F.col("t.rate"), F.col("t.amount") / F.col("notional")
        ).alias("liq_price"),
    )


@query(
    "P6",
    """WITH n AS (SELECT o_orderkey, o_totalprice * 20 AS notional, c_acctbal AS balance,
                         5.0 + o_orderkey % 20 AS leverage
                  FROM orders JOIN customer ON o_custkey = c_custkey),
       k AS (SELECT n.*, (SELECT min(t.tier) FROM tiers t WHERE n.notional <= t.cap) AS tier FROM n)
       SELECT o_orderkey, notional / CAST(leverage AS DOUBLE) AS initial_margin, notional * rate - amount AS margin,
              CASE WHEN balance > 0 THEN (notional * rate - amount) / balance END AS margin_ratio,
              (notional * rate - amount) / notional AS effective_rate
       FROM k JOIN tiers USING (tier)""",
)
def margins(v):
    n = (
        v.table("orders")
        .join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            (F.col("o_totalprice") * 20).alias("notional"),
            F.col("c_acctbal").alias("balance"),
            (F.lit(5.0) + F.col("o_orderkey") % 20).alias("leverage"),
        )
    )
    return accounts.margin_columns(n, "notional", "leverage", "balance").select(
        "o_orderkey", "initial_margin", "margin", "margin_ratio", "effective_rate"
    )


_SPLIT = """
    b AS (SELECT symbol, ts, rate, least(greatest(rate, -0.0005e0), 0.0005e0) AS capped FROM funding),
    c AS (SELECT *, 0.5 + tanh(capped * 100 * 50) * 0.2e0 AS long_share,
                 least(greatest(tanh(abs(capped) * 100 * 2), 0e0), 1e0) AS conf FROM b)"""


@query(
    "P7",
    f"""WITH {_SPLIT}
        SELECT symbol, ts, round(long_share, 9) AS long_ratio, round(1 - long_share, 9) AS short_ratio,
               round(conf, 9) AS confidence, abs(long_share + (1 - long_share) - 1) < 1e-10 AS conserved
        FROM c""",
)
def funding_split(v):
    return features.funding_split(v.funding, "rate", cap=0.0005).select(
        "symbol", "ts",
        F.round("long_ratio", 9).alias("long_ratio"),
        F.round("short_ratio", 9).alias("short_ratio"),
        F.round("confidence", 9).alias("confidence"),
        "conserved",
    )


@query(
    "P8",
    f"""WITH {_SPLIT},
        o AS (SELECT symbol, arg_max(oi_value, ts) AS total_oi FROM oi GROUP BY symbol),
        s AS (SELECT symbol, ts, rate FROM funding UNION ALL SELECT symbol, TIMESTAMP '2023-12-31', NULL FROM o),
        j AS (SELECT s.symbol, s.ts, s.rate, total_oi, c.long_share, c.conf
              FROM s JOIN o USING (symbol) LEFT JOIN c ON s.symbol = c.symbol AND s.ts = c.ts AND s.rate IS NOT NULL),
        k AS (SELECT *, CASE WHEN rate IS NULL THEN 0.5
                             WHEN long_share > 0.7 THEN least(long_share, 0.5 + 0.0005) ELSE long_share END AS l
              FROM j)
        SELECT symbol, ts, round(l, 9) AS long_ratio, round(total_oi * l, 4) AS long_oi,
               round(total_oi * (1 - l), 4) AS short_oi, round(coalesce(conf, 0.5), 9) AS confidence,
               coalesce(abs(rate) >= 0.001, false) AS extreme, rate IS NULL AS neutral
        FROM k""",
)
def open_interest_split(v):
    latest = v.oi.groupBy("symbol").agg(F.max_by("oi_value", "ts").alias("total_oi"))
    missing = v.oi.select("symbol").distinct().select(
        "symbol",
        F.lit("2023-12-31").cast("timestamp").alias("ts"),
        F.lit(None).cast("double").alias("rate"),
    )
    rates = v.funding.unionByName(missing).join(latest, "symbol")
    return features.interest_split(rates, "rate", "total_oi", cap=0.0005, extreme=0.001).select(
        "symbol", "ts",
        F.round("long_ratio", 9).alias("long_ratio"),
        F.round("long_oi", 4).alias("long_oi"),
        F.round("short_oi", 4).alias("short_oi"),
        F.round("confidence", 9).alias("confidence"),
        "extreme", "neutral",
    )


@query("P9", "SELECT symbol, open_time, CASE WHEN close < open THEN 'short' ELSE 'long' END AS side FROM candles")
def candle_sides(v):
    return v.candles.select("symbol", "open_time", C.candle_side("open", "close").alias("side"))


@query(
    "P10",
    """SELECT * FROM (
         SELECT c.symbol, c.open_time, d.oi_delta,
                CASE WHEN oi_delta > 0 AND close > open THEN 'buy' WHEN oi_delta > 0 AND close < open THEN 'sell'
                     WHEN oi_delta < 0 AND close > open THEN 'sell' WHEN oi_delta < 0 AND close < open THEN 'buy'
                END AS side
         FROM candles c LEFT JOIN oi_deltas d ON c.symbol = d.symbol AND c.open_time = d.bucket)
       WHERE side IS NOT NULL""",
)
def quadrant_sides(v):
    d = v.oi_deltas.select("symbol", F.col("bucket").alias("open_time"), "oi_delta")
    return (
        v.candles.join(d, ["symbol", "open_time"], "left")
        .select("symbol", "open_time", "oi_delta", C.quadrant_side("oi_delta", "open", "close").alias("side"))
        .filter("side IS NOT NULL")
    )


@query(
    "P11",
    """WITH d AS (SELECT symbol, min(price) AS low, max(price) AS high FROM ticks GROUP BY symbol)
       SELECT symbol, venue, price_level, side,
              CASE WHEN price_level < mark THEN 'long' WHEN price_level > mark THEN 'short' END AS map_side,
              CASE WHEN side = 'long' THEN low <= price_level ELSE high >= price_level END AS triggered
       FROM levels JOIN tick_marks USING (symbol) JOIN d USING (symbol)
       WHERE price_level <> mark""",
)
def sides_against_mark(v):
    extremes = v.ticks.groupBy("symbol").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    return (
        v.levels.join(v.tick_marks, "symbol")
        .join(extremes, "symbol")
        .select(
            "symbol", "venue", "price_level", "side",
            C.side_against_mark("price_level", "mark").alias("map_side"),
            C.is_triggered("side", "price_level", "low", "high").alias("triggered"),
        )
        .filter("map_side IS NOT NULL")
    )


@query(
    "P12",
    """WITH r AS (SELECT symbol, strftime(open_time, '%Y-%m-%d') AS day, max(high) - min(low) AS span,
                         arg_max(close, open_time) AS price FROM candles GROUP BY ALL),
       h AS (SELECT r.*, unnest([1, 7, 30, 90]) AS days FROM r)
       SELECT symbol, day, days, CASE WHEN days <= 7 THEN 100e0 WHEN days <= 30 THEN 250e0 ELSE 500e0 END AS stepped,
              CASE WHEN symbol = 'click' AND days = 1 THEN 15e0
                   ELSE round(greatest(CASE days WHEN 1 THEN 0.5e0 WHEN 7 THEN 1e0 WHEN 30 THEN 2e0 ELSE 5e0 END,
                     price * CASE days WHEN 1 THEN 0.0003e0 WHEN 7 THEN 0.0005e0 WHEN 30 THEN 0.001e0 ELSE 0.002e0 END), 2)
              END AS scaled,
              pow(10, ceil(log10(CASE WHEN span <= 0 THEN price * 0.2 ELSE span END)) - 2) AS decade
       FROM h""",
)
def bin_sizes(v):
    daily = v.candles.groupBy("symbol", F.date_format("open_time", "yyyy-MM-dd").alias("day")).agg(
        (F.max("high") - F.min("low")).alias("span"), F.max_by("close", "open_time").alias("price")
    )
    horizons = daily.select("*", F.explode(F.array(*[F.lit(d) for d in (1, 7, 30, 90)])).alias("days"))
    override = (F.col("symbol") == "click") & (F.col("days") == 1)
    return horizons.select(
        "symbol", "day", "days",
        C.stepped_bin_size("days").alias("stepped"),
        F.when(override, 15.0).otherwise(C.price_scaled_bin_size("days", "price")).alias("scaled"),
        C.decade_bin_size("span", "price").alias("decade"),
    )


@query(
    "P13",
    """WITH raw AS (SELECT event_id, unnest([5, 10, 7, 25]) AS lev,
                           unnest([volume, floor(price), 3e0, 0e0]) AS w FROM ticks),
       ok AS (SELECT * FROM raw WHERE lev IN (5, 10, 25, 50, 100) AND w > 0)
       SELECT event_id, lev AS leverage, w / sum(w) OVER (PARTITION BY event_id) AS weight FROM ok""",
)
def leverage_weights(v):
    text = F.concat(
        F.lit("5:"), F.col("volume").cast("int"), F.lit(",10:"), F.floor("price"), F.lit(",7:3,25:0,bad")
    )
    return parsing.leverage_weights(v.ticks.select("event_id", text.alias("spec")), "spec").select(
        "event_id", "leverage", "weight"
    )


@query(
    "P14",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_mktsegment || 'USDT' END AS plain,
              CASE c_custkey % 5 WHEN 0 THEN '1d' WHEN 1 THEN '1w' WHEN 2 THEN '1m' WHEN 3 THEN '3m' ELSE 'other' END AS timeframe,
              CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1000.25 + c_custkey % 100 * 1000 END::DOUBLE AS amount
       FROM (SELECT c_custkey, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN 'USDT' ELSE '' END AS c_mktsegment FROM customer)""",
)
def normalised_names(v):
    key = F.col("c_custkey")
    symbol = F.when(key % 2 == 0, F.concat("c_mktsegment", F.lit("USDT-PERP"))).otherwise(F.lower("c_mktsegment"))
    spelled = F.element_at(F.array(*[F.lit(x) for x in (" 24h", "7 Day", "30d", "90 DAY", "Other")]), (key % 5 + 1).cast("int"))
    amount = F.when(key % 7 == 0, "n/a").otherwise(F.concat(F.lit("$"), key % 100 + 1, F.lit(",000.25")))
    return v.table("customer").select(
        "c_custkey",
        C.plain_symbol(symbol).alias("plain"),
        C.canonical_timeframe(spelled).alias("timeframe"),
        (C.number_or_null(amount)).alias("amount"),
    )


@query(
    "P15",
    """SELECT symbol, count(*) AS n, count(*) FILTER (NOT (price BETWEEN 5 AND 300)) AS bad_price,
              count(*) FILTER (NOT (volume >= 10)) AS bad_volume,
              count(*) FILTER (NOT (abs((price - 25) / 10000e0) <= 0.01)) AS bad_funding,
              count(*) FILTER (symbol NOT IN ('click', 'view')) AS bad_symbol
       FROM ticks GROUP BY symbol""",
)
def record_checks(v):
    checked = features.record_flags(
        v.ticks.withColumn("rate", (F.col("price") - 25) / 10000.0),
        price_range=(5, 300), min_volume=10, max_rate=0.01, symbols=["click", "view"],
    )
    flags = ("price", "volume", "funding", "symbol")
    return checked.groupBy("symbol").agg(
        F.count("*").alias("n"), *[F.count_if(~F.col(f"valid_{f}")).alias(f"bad_{f}") for f in flags]
    )


@query(
    "P16",
    """WITH d AS (SELECT obs_id, confidence, CAST(round_even(abs(level_price - mark) / mark * 10000, 0) AS BIGINT) AS bps
                  FROM signals JOIN tick_marks USING (symbol))
       SELECT obs_id, bps, CASE WHEN bps <= 25 THEN '0-25' WHEN bps <= 50 THEN '25-50' WHEN bps <= 100 THEN '50-100'
                                WHEN bps <= 200 THEN '100-200' ELSE '200+' END AS distance_bucket,
              CASE WHEN confidence <= 0.3 THEN '0.0-0.3' WHEN confidence <= 0.6 THEN '0.3-0.6'
                   WHEN confidence <= 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS confidence_bucket,
              CASE WHEN bps <= 2000 THEN 'q1' WHEN bps <= 5000 THEN 'q2' WHEN bps <= 9000 THEN 'q3' ELSE 'q4' END AS learned_bucket
       FROM d""",
)
def score_labels(v):
    d = v.signals.join(v.tick_marks, "symbol").withColumn(
        "bps", F.bround(F.try_divide(F.abs(F.col("level_price") - F.col("mark")), F.col("mark")) * 10000).cast("long")
    )
    learned = F.array(*[F.lit(x) for x in (0, 2000, 5000, 9000, 10**9)])
    return d.select(
        "obs_id", "bps",
        C.distance_label("bps").alias("distance_bucket"),
        C.confidence_label("confidence").alias("confidence_bucket"),
        C.learned_label("bps", learned).alias("learned_bucket"),
    )


@query(
    "P17",
    """WITH h AS (SELECT obs_id, expert, symbol, side, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(
                    expert || symbol || strftime(snapshot_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' || CAST(level_price AS VARCHAR) || side)) AS s
                  FROM signals)
       SELECT obs_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-'
              || substr('89ab', 1 + CAST('0x' || substr(s, 17, 1) AS INT) % 4, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS id,
              expert || ':' || symbol || ':' || side || ':0-25:0.3-0.6:none' AS slice_id
       FROM h""",
)
def record_ids(v):
    return v.signals.select(
        "obs_id",
        identifiers.observation_id("expert", "symbol", "snapshot_ts", "level_price", "side").alias("id"),
        identifiers.slice_id("expert", "symbol", "side", F.lit("0-25"), F.lit("0.3-0.6")).alias("slice_id"),
    )


@query(
    "P18",
    """SELECT symbol, venue, side, price_level, round(abs(price_level - mark) / mark * 100, 2) AS distance_pct,
              CASE WHEN price_level > mark THEN 'above' ELSE 'below' END AS direction
       FROM levels JOIN tick_marks USING (symbol)""",
)
def zone_distance(v):
    return v.levels.join(v.tick_marks, "symbol").select(
        "symbol", "venue", "side", "price_level",
        F.round(C.distance_pct("price_level", "mark"), 2).alias("distance_pct"),
        F.when(F.col("price_level") > F.col("mark"), "above").otherwise("below").alias("direction"),
    )


@query(
    "P19",
    """WITH z AS (SELECT symbol, venue, side, price_level, volume, abs(price_level - mark) / mark * 100 AS d
                  FROM levels JOIN tick_marks USING (symbol))
       SELECT symbol, venue, side, price_level,
              CASE WHEN d <= 30 AND volume >= 800 THEN 'critical' WHEN d <= 60 AND volume >= 400 THEN 'warning'
                   WHEN d <= 100 AND volume >= 100 THEN 'info' END AS severity FROM z""",
)
def zone_severity(v):
    limits = {"critical": (30.0, 800.0), "warning": (60.0, 400.0), "info": (100.0, 100.0)}
    z = v.levels.join(v.tick_marks, "symbol")
    return z.select(
        "symbol", "venue", "side", "price_level",
        C.severity(C.distance_pct("price_level", "mark"), "volume", limits).alias("severity"),
    )


@query(
    "P20",
    """WITH f AS (SELECT run_id, score, CASE WHEN run_id % 50 = 0 THEN 'nan'::DOUBLE ELSE score / 100 END AS f1, run_id % 20 AS age FROM runs)
       SELECT run_id, CASE WHEN isnan(f1) THEN NULL WHEN f1 >= 0.6 THEN 'pass' WHEN f1 >= 0.4 THEN 'acceptable' ELSE 'fail' END AS gate,
              CASE WHEN isnan(f1) THEN NULL WHEN f1 >= 0.8 THEN 'A' WHEN f1 >= 0.7 THEN 'B' WHEN f1 >= 0.6 THEN 'C' ELSE 'F' END AS f1_grade,
              CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' ELSE 'F' END AS grade,
              CASE WHEN isnan(f1) OR age > 14 OR f1 < 0.4 THEN 'critical' WHEN age > 7 OR f1 < 0.6 THEN 'warning' ELSE 'healthy' END AS status
       FROM f""",
)
def grades(v):
    f = v.runs.select(
        "run_id", "score",
        F.when(F.col("run_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("score") / 100).alias("f1"),
        (F.col("run_id") % 20).alias("age"),
    )
    return f.select(
        "run_id",
        C.f1_gate("f1").alias("gate"),
        C.f1_grade("f1").alias("f1_grade"),
        C.score_grade("score").alias("grade"),
        C.health_status("f1", "age").alias("status"),
    )


@query(
    "P21",
    """WITH j AS (SELECT o_orderkey, o_orderkey % 11 = 0 AS reduce_only,
                         CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'O' THEN 1 END AS sgn, o_totalprice / 1000 AS sz, p.size AS pos
                  FROM orders JOIN positions p ON o_custkey = p.account AND o_orderpriority = p.coin),
       e AS (SELECT *, CASE WHEN reduce_only THEN 'reduce_only' WHEN sgn IS NULL THEN 'unknown_side' WHEN pos = 0 THEN 'opening_flat'
                            WHEN pos * sgn > 0 THEN 'opening_same_side' WHEN sz <= abs(pos) THEN 'reducing_or_closing'
                            ELSE 'partially_opening_opposite' END AS effect FROM j)
       SELECT o_orderkey, effect, CASE WHEN effect IN ('opening_flat', 'opening_same_side') THEN sz
              WHEN effect = 'partially_opening_opposite' THEN sz - abs(pos) ELSE 0 END AS opening_size FROM e""",
)
def order_effects(v):
    o = v.table("orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("account"),
        F.col("o_orderpriority").alias("coin"),
        (F.col("o_orderkey") % 11 == 0).alias("reduce_only"),
        F.when(F.col("o_orderstatus") == "F", -1).when(F.col("o_orderstatus") == "O", 1).alias("sign"),
        (F.col("o_totalprice") / 1000).alias("order_size"),
    )
    e = o.join(v.positions, ["account", "coin"]).withColumn(
        "e", C.order_effect("reduce_only", "sign", "order_size", "size")
    )
    return e.select("o_orderkey", "e.effect", "e.opening_size")


@query(
    "P22",
    """WITH m AS (SELECT account, CASE WHEN account % 10 = 0 THEN 'portfolio' WHEN bool_and(margin_type = 'isolated') THEN 'isolated'
                                       ELSE 'cross' END AS mode,
                         CAST(round(sum(abs(size)) * 100000) AS BIGINT) / 100000.0 AS total FROM positions GROUP BY account),
       g AS (SELECT account, mode, total * 0.02e0 AS gap, (account % 40) / 10e0 AS dev FROM m),
       f AS (SELECT account, mode, unnest(CASE WHEN dev <= 1.0 OR gap <= 0 THEN [] WHEN dev <= 1.5 THEN ['multi_tier_rounding']
                     ELSE ['funding_timing', 'estimated_resting_order_reserve', 'unknown'] END) AS category, gap FROM g)
       SELECT account, mode, category, round(CASE category WHEN 'multi_tier_rounding' THEN gap WHEN 'funding_timing' THEN least(gap * 0.1, 25)
              WHEN 'estimated_resting_order_reserve' THEN greatest(gap - least(gap * 0.1, 25), 0) * 0.7
              ELSE greatest(gap - least(gap * 0.1, 25) - greatest(gap - least(gap * 0.1, 25), 0) * 0.7, 0) END, 6) AS impact FROM f""",
)
def margin_gap_factors(v):
    modes = accounts.margin_modes(v.positions, portfolio=F.col("account") % 10 == 0)
    total = v.positions.groupBy("account").agg(
        (F.round(F.sum(F.abs("size")) * 100000).cast("long") / 100000.0).alias("total")
    )
    g = modes.join(total, "account").select(
        "account", "mode", (F.col("total") * 0.02).alias("gap"), ((F.col("account") % 40) / 10.0).alias("dev")
    )
    return g.select("account", "mode", F.explode(C.gap_factors("dev", "gap")).alias("f")).select(
        "account", "mode", "f.category", F.round("f.impact", 6).alias("impact")
    )


@query(
    "P23",
    """WITH n AS (SELECT o_orderkey, o_totalprice AS a, o_totalprice * (0.5e0 + o_orderkey % 7) AS b,
                         50e0 + o_orderkey % 100 AS entry, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS sgn FROM orders),
       k AS (SELECT n.*, (SELECT min(tier) FROM tiers WHERE a <= cap) AS ta, (SELECT min(tier) FROM tiers WHERE b <= cap) AS tb FROM n),
       j AS (SELECT k.*, x.rate ra, x.amount ma, y.rate rb, y.amount mb FROM k JOIN tiers x ON x.tier = ta JOIN tiers y ON y.tier = tb)
       SELECT o_orderkey, ta AS old_tier, tb AS new_tier, abs(tb - ta) AS tiers_crossed, (b * rb - mb) - (a * ra - ma) AS margin_increase,
              ((b * rb - mb) - (a * ra - ma)) / (a * ra - ma) * 100 AS margin_increase_pct,
              CAST(floor(1 / ra + 1e-9) AS INT) AS old_max_leverage, CAST(floor(1 / rb + 1e-9) AS INT) AS new_max_leverage,
              entry * (1 - sgn * (1e0 / 10 - ra + ma / a)) AS old_liq, entry * (1 - sgn * (1e0 / 10 - rb + mb / b)) AS new_liq,
              CASE WHEN tb <= ta THEN 'info' WHEN tb - ta = 1 THEN 'warning' ELSE 'critical' END AS warning
       FROM j""",
)
def tier_change(v):
    key = F.col("o_orderkey")
    n = v.table("orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("old_notional"),
        (F.col("o_totalprice") * (0.5 + key % 7)).alias("new_notional"),
        (50.0 + key % 100).alias("entry"),
        (key % 2 == 0).alias("is_long"),
    )
    return accounts.tier_change_preview(n, "old_notional", "new_notional", "entry", F.lit(10.0), "is_long").select(
        "o_orderkey", "old_tier", "new_tier", "tiers_crossed", "margin_increase", "margin_increase_pct",
        "old_max_leverage", "new_max_leverage", "old_liq", "new_liq", "warning",
    )


@query(
    "P24",
    """WITH f AS (SELECT l.symbol, venue, sum(volume) FILTER (side = 'long') AS tl, sum(volume) FILTER (side = 'short') AS ts,
                         coalesce(min(abs(price_level - mark)) FILTER (side = 'long' AND volume > 0) / any_value(mark), 1) AS ld,
                         coalesce(min(abs(price_level - mark)) FILTER (side = 'short' AND volume > 0) / any_value(mark), 1) AS sd
                  FROM levels l JOIN tick_marks USING (symbol) GROUP BY ALL),
       s AS (SELECT *, unnest(['flat', 'long', 'short']) AS state, (tl - ts) / (tl + ts) AS net FROM f)
       SELECT symbol, venue, state, CASE WHEN ld < 0.05 AND state = 'long' THEN 'exit_long' WHEN sd < 0.05 AND state = 'short' THEN 'exit_short'
              WHEN state <> 'flat' THEN 'hold' WHEN least(ld, sd) < 0.05 THEN 'hold' WHEN abs(net) < 0.01 THEN 'hold'
              WHEN net > 0 THEN 'enter_long' ELSE 'enter_short' END AS action
       FROM s""",
)
def map_actions(v):
    f = features.map_features(v.levels.join(v.tick_marks, "symbol"), ["symbol", "venue"], "mark")
    s = f.select("*", F.explode(F.array(F.lit("flat"), F.lit("long"), F.lit("short"))).alias("state"))
    return s.select(
        "symbol", "venue", "state",
        C.map_action("state", "long_distance", "short_distance", "net_imbalance", 0.05, 0.01).alias("action"),
    )


@query(
    "P25",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([100, 50, 25, 10]) AS leverage,
              unnest(CASE WHEN side = 'buy' THEN [price * 0.99e0, price * 0.98e0, price * 0.96e0, price * 0.9e0]
                          ELSE [price * 1.01e0, price * 1.02e0, price * 1.04e0, price * 1.1e0] END) AS loss_cut
       FROM trades""",
)
def loss_cuts(v):
    return features.loss_cut_levels(v.trades).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "leverage", "loss_cut"
    )
