"""H, J2, J10, A1-A6, U5, W5: liquidation maps, models and public maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from forcemap.functions import columns as C
from forcemap.operators import maps, models, resample
from forcemap.operators.joins import per_tier
from forcemap.plans.registry import query
from forcemap.session import staged

TIERS5 = "(SELECT unnest([5, 10, 25, 50, 100]) AS leverage)"

_TRADE_LIQ = f"""
    liq AS (SELECT t.*, leverage, mark, CASE WHEN side = 'buy' THEN price * (1 - 1.0 / leverage + 0.004)
                                        ELSE price * (1 + 1.0 / leverage - 0.004) END AS liq_price
            FROM trades t CROSS JOIN {TIERS5} JOIN trade_marks USING (symbol) WHERE gross_value >= 20000),
    risk AS (SELECT * FROM liq WHERE (side = 'buy' AND liq_price < mark) OR (side = 'sell' AND liq_price > mark))"""


@query(
    "H1",
    f"""WITH {_TRADE_LIQ},
        v AS (SELECT *, count(*) OVER (PARTITION BY symbol, ts, price, gross_value, side) AS n FROM risk)
        SELECT symbol, floor(liq_price / 500) * 500e0 AS price_bucket, leverage, side,
               round(sum(gross_value / n), 4) AS total_volume, count(*) AS count
        FROM v GROUP BY ALL""",
)
def trade_map(v):
    m = maps.trade_map(v.trades, v.trade_marks, 500.0, 20000.0)
    return m.withColumn("total_volume", F.round("total_volume", 4))


@query(
    "W2",
    f"""WITH {_TRADE_LIQ},
        v AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM risk)
        SELECT symbol, floor(liq_price / 500) * 500e0 AS price_bucket, leverage, side,
               round(sum(gross_value / n), 4) AS total_volume, count(*) AS count
        FROM v GROUP BY ALL""",
)
def trade_map_by_id(v):
    m = maps.trade_map(v.trades, v.trade_marks, 500.0, 20000.0, by_trade=True)
    return m.withColumn("total_volume", F.round("total_volume", 4))


@query(
    "J2",
    f"""SELECT symbol, leverage, count(*) AS n, round(sum(gross_value / 100 * share), 2) AS volume
        FROM trades CROSS JOIN leverages GROUP BY ALL""",
)
def tier_expansion(v):
    return (
        per_tier(v.trades, maps.LEVERAGE_SHARES)
        .groupBy("symbol", "leverage")
        .agg(F.count("*").alias("n"), F.round(F.sum(F.col("gross_value") / 100 * F.col("share")), 2).alias("volume"))
    )


@query(
    "A1",
    f"""WITH {_TRADE_LIQ}
        SELECT symbol, floor(liq_price / 1000) * 1000e0 AS price_bucket, leverage, side,
               round(sum(gross_value), 2) AS volume, count(*) AS count FROM risk GROUP BY ALL""",
)
def bucket_sums(v):
    levels = maps._at_risk(
        v.trades.filter("gross_value >= 20000").join(v.trade_marks, "symbol"), maps.LEVERAGE_SHARES, 0.004
    ).select("symbol", "side", "gross_value", F.explode("_risk").alias("r"))
    return levels.groupBy(
        "symbol", C.floor_bin("r.liq", 1000.0).alias("price_bucket"), F.col("r.leverage").alias("leverage"), "side"
    ).agg(F.round(F.sum("gross_value"), 2).alias("volume"), F.count("*").alias("count"))


def sided_sql(lookback: int, weights: tuple[float, float], width: float) -> str:
    buy, sell = weights
    return f"""
    c15 AS (SELECT symbol, time_bucket(INTERVAL '15 minutes', ts) AS open_time, arg_min(price, ts) AS open, max(price) AS high,
                   min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume FROM ticks GROUP BY ALL),
    span AS (SELECT symbol, max(open_time) - INTERVAL '{lookback} days' AS start_time FROM c15 GROUP BY symbol),
    latest AS (SELECT symbol, arg_max(oi_value, ts) AS latest_oi FROM oi GROUP BY symbol),
    ob AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS b, arg_max(oi_value, ts) AS v FROM oi JOIN span USING (symbol)
           WHERE ts >= start_time - INTERVAL '1 day' GROUP BY ALL),
    od AS (SELECT symbol, b, v - lag(v) OVER (PARTITION BY symbol ORDER BY b) AS delta FROM ob),
    sided AS (SELECT c15.*, delta, CASE WHEN delta > 0 AND close > open THEN 'buy' WHEN delta > 0 AND close < open THEN 'sell'
                     WHEN delta < 0 AND close > open THEN 'sell' WHEN delta < 0 AND close < open THEN 'buy' END AS side
              FROM c15 JOIN span USING (symbol)
              LEFT JOIN od ON od.symbol = c15.symbol AND od.b = time_bucket(INTERVAL '1 hour', open_time)
              WHERE open_time >= start_time),
    shape AS (SELECT symbol, floor(close / {width}) * {width}e0 AS price_bin, side,
                     sum(close * volume * CASE WHEN side = 'buy' THEN {buy}e0 ELSE {sell}e0 END) AS vol
              FROM sided WHERE side IS NOT NULL GROUP BY ALL),
    total AS (SELECT symbol, sum(vol) AS tot FROM shape GROUP BY symbol),
    dist AS (SELECT shape.*, latest_oi, vol * latest_oi / tot AS oi_at_price
             FROM shape JOIN total USING (symbol) JOIN latest USING (symbol))"""


@query(
    "H2",
    f"""WITH {sided_sql(20, (1.0, 1.0), 2.0)},
        lv AS (SELECT dist.*, leverage, oi_at_price * share AS volume, mark,
                      CASE WHEN side = 'buy' THEN price_bin * (1 - 1.0 / leverage + 0.004)
                           ELSE price_bin * (1 + 1.0 / leverage - 0.004) END AS liq_price
               FROM dist CROSS JOIN leverages JOIN tick_marks USING (symbol))
        SELECT symbol, price_bin AS price_bucket, leverage, side, round(volume, 6) AS volume, liq_price
        FROM lv WHERE (side = 'sell' AND liq_price > mark) OR (side = 'buy' AND liq_price < mark)""",
)
def interest_map(v):
    m = maps.interest_map(resample.ohlcv(v.ticks, "15m"), v.oi, v.tick_marks, 2.0, 20, "1h")
    return m.select("symbol", "price_bucket", "leverage", "side", F.round("volume", 6).alias("volume"), "liq_price")


@query(
    "A6",
    f"""WITH {sided_sql(30, (0.5, 1.5), 5.0)}
        SELECT symbol, price_bin, side, round(vol, 4) AS volume_at_price, round(oi_at_price, 6) AS oi_at_price FROM dist""",
)
def interest_shares(v):
    d = maps.interest_distribution(
        resample.ohlcv(v.ticks, "15m"), v.oi, 5.0, 30, "1h", {"buy": 0.5, "sell": 1.5}
    )
    return d.select(
        "symbol", "price_bin", "side", F.round("volume_at_price", 4).alias("volume_at_price"),
        F.round("oi_at_price", 6).alias("oi_at_price"),
    )


def _intervals(v):
    from functools import reduce

    parts = [resample.ohlcv(v.ticks, i).withColumn("interval", F.lit(i)) for i in ("1m", "5m", "15m")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "H3",
    """WITH c AS (SELECT symbol, '1m' AS i, time_bucket(INTERVAL '1 minute', ts) AS t FROM ticks GROUP BY ALL
                  UNION ALL SELECT symbol, '5m', time_bucket(INTERVAL '5 minutes', ts) FROM ticks GROUP BY ALL
                  UNION ALL SELECT symbol, '15m', time_bucket(INTERVAL '15 minutes', ts) FROM ticks GROUP BY ALL),
       m AS (SELECT symbol, i, max(t) AS mx FROM c GROUP BY ALL),
       k0 AS (SELECT c.symbol, c.i, mx, count(*) AS n
             FROM c JOIN m ON c.symbol = m.symbol AND c.i = m.i WHERE t >= mx - INTERVAL '14 days' GROUP BY ALL),
       k AS (SELECT *, n / (14e0 * CASE i WHEN '1m' THEN 1440 WHEN '5m' THEN 288 ELSE 96 END) AS cov FROM k0),
       ok AS (SELECT *, mx >= (SELECT max(ts) FROM ticks) - INTERVAL '20 minutes' AS fresh FROM k
              WHERE cov >= CASE i WHEN '1m' THEN 0.03 WHEN '5m' THEN 0.2 ELSE 0.45 END),
       r AS (SELECT *, CASE i WHEN '5m' THEN 0 WHEN '15m' THEN 1 ELSE 2 END + CASE WHEN fresh THEN 0 ELSE 10 END AS rk FROM ok),
       b AS (SELECT symbol, arg_min(i, rk) AS source, arg_min(cov, rk) AS coverage, min(rk) >= 10 AS stale FROM r GROUP BY symbol)
       SELECT s.symbol, source, round(coverage, 9) AS coverage, stale FROM (SELECT DISTINCT symbol FROM ticks) s LEFT JOIN b USING (symbol)""",
)
def source_choice(v):
    now = v.ticks.agg(F.max("ts")).scalar()
    rules = {"1m": (1440, 0.03), "5m": (288, 0.2), "15m": (96, 0.45)}
    return maps.resolve_source(_intervals(v), now, "auto", 14, allow_stale=True, rules=rules).select(
        "symbol", "source", F.round("coverage", 9).alias("coverage"), "stale"
    )


_INPUTS = """
    inputs AS (SELECT symbol, mark, open_interest, (SELECT min(tier) FROM tiers WHERE open_interest <= cap) AS k
               FROM (SELECT symbol, mark, oi_value AS open_interest
                     FROM tick_marks JOIN (SELECT symbol, arg_max(oi_value, ts) * 50 AS oi_value FROM oi GROUP BY symbol) USING (symbol))),
    rated AS (SELECT i.*, coalesce(t.rate, 0.004) AS rate FROM inputs i LEFT JOIN tiers t ON t.tier = i.k)"""


def model_inputs(v):
    oi = v.oi.groupBy("symbol").agg((F.max_by("oi_value", "ts") * 50).alias("open_interest"))
    return staged(v.tick_marks.select("symbol", "mark").join(oi, "symbol"), "inputs")


@query(
    "H4",
    f"""WITH inputs AS (SELECT symbol, mark, (SELECT sum(gross_value) FROM trades t WHERE t.symbol = m.symbol) AS open_interest FROM trade_marks m),
        rated AS (SELECT i.*, coalesce((SELECT rate FROM tiers WHERE cap >= open_interest ORDER BY cap LIMIT 1), 0.004) AS rate FROM inputs i),
        lv AS (SELECT t.symbol, side, leverage, gross_value / 5 AS volume, mark,
                      CASE WHEN side = 'buy' THEN price * ((1 - 1e0 / leverage) + rate) ELSE price * ((1 + 1e0 / leverage) - rate) END AS liq
               FROM trades t JOIN rated USING (symbol) CROSS JOIN {TIERS5})
        SELECT symbol, CASE WHEN side = 'buy' THEN 'long' ELSE 'short' END AS side, leverage, floor(liq / 1000) * 1000e0 AS price_bucket,
               round(sum(volume), 4) AS volume, count(*) AS n
        FROM lv WHERE (side = 'buy' AND liq < mark) OR (side = 'sell' AND liq > mark) GROUP BY ALL""",
)
def standard_on_trades(v):
    oi = v.trades.groupBy("symbol").agg(F.sum("gross_value").alias("open_interest"))
    levels = maps.trade_levels(v.trades, v.trade_marks.join(oi, "symbol"))
    return levels.groupBy("symbol", "side", "leverage", C.floor_bin("price_level", 1000.0).alias("price_bucket")).agg(
        F.round(F.sum("volume"), 4).alias("volume"), F.count("*").alias("n")
    )


_GAUSS = f"""{_INPUTS},
    g0 AS (SELECT r.*, leverage, s.side, CASE WHEN s.side = 'long' THEN 1 - 1e0 / leverage + rate ELSE 1 + 1e0 / leverage - rate END AS f
           FROM rated r CROSS JOIN {TIERS5} CROSS JOIN (SELECT unnest(['long', 'short']) AS side) s),
    g1 AS (SELECT *, mark / f AS edge,
                  CASE WHEN side = 'long' THEN CASE WHEN f < 1 THEN mark * 1.01e0 ELSE mark / f * 0.85e0 END ELSE mark / f * 1.01e0 END AS lo,
                  CASE WHEN side = 'long' THEN CASE WHEN f < 1 THEN least(mark * 1.15e0, mark / f * 0.99e0) ELSE mark / f * 0.99e0 END
                       ELSE CASE WHEN f > 1 THEN least(mark * 0.99e0, mark / f * 1.15e0) ELSE mark / f * 1.15e0 END END AS hi FROM g0),
    g2 AS (SELECT *, CASE WHEN hi <= lo THEN edge * CASE WHEN side = 'long' THEN 0.8e0 ELSE 1.02e0 END ELSE lo END AS a,
                  CASE WHEN hi <= lo THEN edge * CASE WHEN side = 'long' THEN 0.95e0 ELSE 1.2e0 END ELSE hi END AS b FROM g1),
    g3 AS (SELECT *, a + i * ((b - a) / 49) AS entry FROM g2 CROSS JOIN (SELECT unnest(range(50)) AS i)),
    g4 AS (SELECT *, exp(-0.5 * pow((entry - (a + b) / 2) / greatest(mark * 0.03, 1), 2)) AS w FROM g3),
    standard AS (SELECT symbol, leverage, side, i AS bin, entry * f AS price_level,
                        open_interest / 5 / 2 * w / sum(w) OVER (PARTITION BY symbol, leverage, side) AS volume FROM g4)"""


@query(
    "H5",
    f"""WITH {_GAUSS}
        SELECT symbol, leverage, side, bin, round(price_level, 10) AS price_level, round(volume, 4) AS volume FROM standard""",
)
def gaussian_model(v):
    return models.gaussian_levels(model_inputs(v)).select(
        "symbol", "leverage", "side", "bin", F.round("price_level", 10).alias("price_level"), F.round("volume", 4).alias("volume")
    )


@query(
    "H6",
    f"""WITH {_INPUTS},
        fr AS (SELECT symbol, 0.5 + tanh(arg_max(rate, ts) * 100 * 50) * 0.2 AS lr FROM funding GROUP BY symbol),
        b0 AS (SELECT r.*, leverage, s.side, lr, i FROM rated r JOIN fr USING (symbol) CROSS JOIN {TIERS5}
               CROSS JOIN (SELECT unnest(['long', 'short']) AS side) s CROSS JOIN (SELECT unnest(range(50)) AS i)),
        b1 AS (SELECT *, CASE WHEN side = 'long' THEN mark * 1.01e0 + i * ((mark * 1.15e0 - mark * 1.01e0) / 49)
                              ELSE mark * 0.953e0 + i * ((mark * 0.99e0 - mark * 0.953e0) / 49) END AS entry,
                      mark * CASE WHEN side = 'long' THEN 1.05e0 ELSE 0.95e0 END AS centre FROM b0),
        b2 AS (SELECT *, exp(-0.5 * pow((entry - centre) / (mark * 0.03), 2)) AS w FROM b1)
        SELECT symbol, leverage, side, i AS bin,
               round(entry * CASE WHEN side = 'long' THEN 1 - 1e0 / leverage + rate ELSE 1 + 1e0 / leverage - rate END, 10) AS price_level,
               round(open_interest / 5 * CASE WHEN side = 'long' THEN lr ELSE 1 - lr END * w / sum(w) OVER (PARTITION BY symbol, leverage, side), 4) AS volume
        FROM b2""",
)
def bias_model(v):
    ratio = v.funding.groupBy("symbol").agg(C.funding_long_share(F.max_by("rate", "ts")).alias("long_ratio"))
    return models.biased_levels(model_inputs(v).join(ratio, "symbol")).select(
        "symbol", "leverage", "side", "bin", F.round("price_level", 10).alias("price_level"), F.round("volume", 4).alias("volume")
    )


_SHIFT = f"""{_GAUSS},
    fr AS (SELECT symbol, arg_max(rate, ts) AS rate FROM funding GROUP BY symbol),
    shifted AS (SELECT s.symbol, leverage, side, bin, volume,
                       price_level * CASE WHEN side = 'long' THEN 1 + rate * 10 ELSE 1 - rate * 10 END AS price_level
                FROM standard s JOIN fr USING (symbol))"""


def latest_funding(v):
    return v.funding.groupBy("symbol").agg(F.max_by("rate", "ts").alias("rate"))


@query(
    "H7",
    f"""WITH {_SHIFT} SELECT symbol, leverage, side, bin, round(price_level, 10) AS price_level, round(volume, 4) AS volume FROM shifted""",
)
def funding_model(v):
    m = models.funding_shifted(models.gaussian_levels(model_inputs(v)), latest_funding(v))
    return m.select(
        "symbol", "leverage", "side", "bin", F.round("price_level", 10).alias("price_level"), F.round("volume", 4).alias("volume")
    )


def book(v):
    return v.ticks.join(v.tick_marks, "symbol").select(
        "symbol", F.when(F.col("price") < F.col("mark"), "bid").otherwise("ask").alias("side"), "price", F.col("volume").alias("size")
    )


_BOOK = """
    book AS (SELECT t.symbol, CASE WHEN price < mark THEN 'bid' ELSE 'ask' END AS side, price, volume AS size
             FROM ticks t JOIN tick_marks USING (symbol)),
    rungs AS (SELECT symbol, side, price, sum(price * size) AS quote FROM book GROUP BY ALL)"""
_DEPTH = """coalesce((SELECT sum(quote) FROM rungs r WHERE r.symbol = l.symbol AND
               ((l.side = 'long' AND r.side = 'bid' AND r.price >= l.price_level) OR
                (l.side = 'short' AND r.side = 'ask' AND r.price <= l.price_level))), 0)"""


@query(
    "J10",
    f"""WITH {_BOOK}, d AS (SELECT l.*, {_DEPTH} AS depth FROM levels l)
        SELECT symbol, venue, side, price_level, round(depth, 2) AS depth,
               round(CASE WHEN depth > 0 THEN 1 + volume / (volume + depth) ELSE 2 END, 9) AS impact FROM d""",
)
def depth_at_levels(v):
    d = models.depth_weighted(v.levels, book(v), 5.0)
    return d.select(
        "symbol", "venue", "side", "price_level", F.round("depth", 2).alias("depth"), F.round("impact", 9).alias("impact")
    )


@query(
    "H8",
    f"""WITH {_GAUSS}, {_BOOK}, d AS (SELECT l.*, {_DEPTH} AS depth FROM standard l)
        SELECT symbol, leverage, side, bin, round(volume * CASE WHEN depth > 0 THEN 1 + volume / (volume + depth) ELSE 2 END, 4) AS volume FROM d""",
)
def depth_model(v):
    d = models.depth_weighted(models.gaussian_levels(model_inputs(v)), book(v), 5.0)
    return d.select("symbol", "leverage", "side", "bin", F.round("volume", 4).alias("volume"))


_UNION = f"""{_SHIFT},
    every AS (SELECT symbol, 'standard' AS model, leverage, side, price_level, volume, 0.95 AS conf, 0.5 / 0.8 AS w FROM standard
              UNION ALL SELECT symbol, 'funding', leverage, side, price_level, volume, 0.75, 0.3 / 0.8 FROM shifted),
    ens0 AS (SELECT symbol, leverage, side, sum(w * price_level) / sum(w) AS price_level, sum(w * volume) AS volume,
                    avg(price_level) AS mean, max(price_level) AS mx, min(price_level) AS mn FROM every GROUP BY ALL),
    ens AS (SELECT *, greatest(mx - mean, mean - mn) / mean AS disagreement FROM ens0)"""


def model_union(v):
    standard = staged(models.gaussian_levels(model_inputs(v)), "standard")
    return standard.unionByName(models.funding_shifted(standard, latest_funding(v)))


@query(
    "A5",
    f"""WITH {_UNION} SELECT symbol, leverage, side, round(price_level, 6) AS price_level, round(volume, 4) AS volume,
               round(disagreement, 8) AS disagreement, CASE WHEN disagreement > 0.05 THEN 0.7e0 ELSE 0.85e0 END AS confidence FROM ens""",
)
def weighted_ensemble(v):
    return models.ensemble(model_union(v), ("standard", "funding")).select(
        "symbol", "leverage", "side", F.round("price_level", 6).alias("price_level"), F.round("volume", 4).alias("volume"),
        F.round("disagreement", 8).alias("disagreement"), "confidence",
    )


@query(
    "H9",
    f"""WITH {_UNION},
        allm AS (SELECT symbol, model, price_level, volume, conf FROM every
                 UNION ALL SELECT symbol, 'ensemble', price_level, volume, CASE WHEN disagreement > 0.05 THEN 0.7 ELSE 0.85 END FROM ens)
        SELECT symbol, model, count(*) AS levels, round(sum(volume), 4) AS volume, round(sum(price_level * volume) / sum(volume), 6) AS mean_price,
               round(min(price_level), 6) AS low, round(max(price_level), 6) AS high, max(conf)::DOUBLE AS confidence
        FROM allm GROUP BY ALL""",
)
def model_comparison(v):
    every = model_union(v)
    blend = models.ensemble(every, ("standard", "funding")).withColumn("model", F.lit("ensemble"))
    keep = ["symbol", "model", "price_level", "volume", "confidence"]
    c = models.side_by_side(every.select(keep).unionByName(blend.select(keep)))
    return c.select(
        "symbol", "model", "levels", F.round("volume", 4).alias("volume"), F.round("mean_price", 6).alias("mean_price"),
        F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "confidence",
    )


@query(
    "A4",
    """WITH r AS (SELECT symbol, side, round(price_level * 1.004 / 10) * 10e0 AS bucket, volume FROM levels),
       g AS (SELECT symbol, min(bucket) AS grid_min, max(bucket) AS grid_max FROM r GROUP BY symbol),
       s AS (SELECT symbol, bucket, sum(volume) FILTER (side = 'long') AS long_density, sum(volume) FILTER (side = 'short') AS short_density
             FROM r GROUP BY ALL)
       SELECT symbol, bucket, coalesce(long_density, 0) AS long_density, coalesce(short_density, 0) AS short_density, grid_min, grid_max, 10e0 AS grid_step
       FROM s JOIN g USING (symbol)""",
)
def side_distributions(v):
    from forcemap.operators.distributions import explode_sides, to_distribution

    d = to_distribution(v.levels.withColumn("price_level", F.col("price_level") * 1.004), ["symbol"], 10.0)
    cells = explode_sides(d).groupBy("symbol", "bucket", "grid_min", "grid_max", "grid_step").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("side") == s, F.col("volume"))), F.lit(0.0)).alias(f"{s}_density")
            for s in ("long", "short")
        ]
    )
    return cells


@query(
    "U5",
    """WITH b AS (SELECT symbol, venue, side, price_level, volume, CASE positions % 3 WHEN 0 THEN 25 WHEN 1 THEN 50
                         ELSE CASE WHEN venue = 3 THEN 10 ELSE 100 END END AS lev FROM levels),
       f AS (SELECT symbol, venue, bool_or(lev NOT IN (25, 50, 100)) AS exact FROM b GROUP BY ALL),
       e AS (SELECT b.symbol, b.venue, side, price_level, volume, CASE WHEN exact THEN [lev] ELSE CASE lev WHEN 25 THEN [25, 30, 40]
                    WHEN 50 THEN [50, 60, 70] ELSE [80, 90, 100] END END AS t FROM b JOIN f ON b.symbol = f.symbol AND b.venue = f.venue),
       x AS (SELECT symbol, venue, side, price_level, volume / len(t) AS volume, unnest(t) AS leverage FROM e)
       SELECT symbol, venue, side, price_level, leverage, round(sum(volume), 6) AS volume FROM x GROUP BY ALL""",
)
def ladder(v):
    third = F.when(F.col("venue") == 3, 10).otherwise(100)
    lev = F.when(F.col("positions") % 3 == 0, 25).when(F.col("positions") % 3 == 1, 50).otherwise(third)
    b = v.levels.withColumn("leverage", lev).drop("positions")
    return maps.expand_ladder(b, ["symbol", "venue"]).withColumn("volume", F.round("volume", 6))


@query(
    "W5",
    """WITH p AS (SELECT l.symbol, side, price_level, mark, sum(volume) AS v FROM levels l JOIN tick_marks USING (symbol)
                  WHERE (side = 'long' AND price_level < mark) OR (side = 'short' AND price_level > mark) GROUP BY ALL)
       SELECT symbol, side, price_level, sum(v) OVER (PARTITION BY symbol, side ORDER BY abs(price_level - mark)) AS value FROM p
       UNION ALL SELECT symbol, unnest(['long', 'short']), mark, 0 FROM tick_marks""",
)
def cumulative(v):
    return maps.cumulative_curve(v.levels.join(v.tick_marks, "symbol"), ["symbol"]).select("symbol", "side", "price_level", "value")


_PUBLIC = f"""{sided_sql(30, (0.42, 1.0), 2.0)},
    lv AS (SELECT dist.*, leverage, oi_at_price * share AS volume, mark,
                  CASE WHEN side = 'buy' THEN price_bin * (1 - 1.0 / leverage + 0.004) ELSE price_bin * (1 + 1.0 / leverage - 0.004) END AS liq_price
           FROM dist CROSS JOIN (VALUES (25, 0.28), (50, 0.34), (100, 0.38)) x(leverage, share) JOIN tick_marks USING (symbol)),
    seeds AS (SELECT symbol, CASE WHEN side = 'buy' THEN 'long' ELSE 'short' END AS side, leverage, mark,
                     round(mark + round((liq_price - mark) / 2e0) * 2e0, 2) AS price_level, sum(volume) AS volume
              FROM lv WHERE (side = 'sell' AND liq_price > mark) OR (side = 'buy' AND liq_price < mark) GROUP BY ALL),
    buckets AS (SELECT symbol, side, mark, price_level, volume / 3 AS volume,
                       unnest(CASE leverage WHEN 25 THEN [25, 30, 40] WHEN 50 THEN [50, 60, 70] ELSE [80, 90, 100] END) AS leverage FROM seeds)"""


@query(
    "H13",
    f"""WITH {_PUBLIC},
        pv AS (SELECT symbol, side, price_level, mark, sum(volume) AS v FROM buckets
               WHERE (side = 'long' AND price_level < mark) OR (side = 'short' AND price_level > mark) GROUP BY ALL),
        cum AS (SELECT symbol, side, price_level, sum(v) OVER (PARTITION BY symbol, side ORDER BY abs(price_level - mark)) AS value FROM pv),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY price_level) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM buckets),
        q AS (SELECT symbol, any_value(mark) AS mark, max(price_level) FILTER (i = floor((n - 1) * 0.02e0)) AS lo,
                     max(price_level) FILTER (i = ceil((n - 1) * 0.98e0)) AS hi FROM ranked GROUP BY symbol),
        rg AS (SELECT symbol, round(greatest(least(lo - (hi - lo) * 0.06, mark * 0.88), mark * 0.82), 2) AS x_min,
                      round(least(greatest(hi + (hi - lo) * 0.06, mark * 1.12), mark * 1.18), 2) AS x_max FROM q)
        SELECT symbol, 'bucket' AS kind, side, price_level, leverage, round(volume, 6) AS value, x_min, x_max FROM buckets JOIN rg USING (symbol)
        UNION ALL SELECT symbol, 'cumulative', side, price_level, 0, round(value, 6), x_min, x_max FROM cum JOIN rg USING (symbol)
        UNION ALL SELECT symbol, 'cumulative', s, mark, 0, 0, x_min, x_max FROM tick_marks JOIN rg USING (symbol) CROSS JOIN (SELECT unnest(['long', 'short']) AS s)""",
)
def public_map(v):
    levels = maps.interest_map(
        resample.ohlcv(v.ticks, "15m"), v.oi, v.tick_marks, 2.0, 30, "1h",
        shares={25: 0.28, 50: 0.34, 100: 0.38}, side_weights={"buy": 0.42, "sell": 1.0},
    )
    return maps.public_map(levels, 2.0, "1w").withColumn("value", F.round("value", 6))


@query(
    "H16",
    """SELECT symbol, 'expert_' || CAST(wallet % 3 AS VARCHAR) AS model, date_trunc('hour', ts) AS time_bucket,
              floor(price / 10) * 10e0 AS price_bucket, count(*) AS density, sum(volume) AS volume FROM ticks GROUP BY ALL""",
)
def density_grid(v):
    model = F.concat(F.lit("expert_"), (F.col("wallet") % 3).cast("string"))
    return maps.density_grid(v.ticks.withColumn("model", model).withColumnRenamed("price", "price_level"), 10.0)
