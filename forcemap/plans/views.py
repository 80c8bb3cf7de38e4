"""Market-shaped views over the generated tables, in Spark and in DuckDB text.

``Views`` builds lazily, so a query scans only the columns of the views it touches.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forcemap.functions.columns import floor_time
from forcemap.functions.constants import LEVERAGE_SHARES, MAINTENANCE_TIERS
from forcemap.operators.resample import ohlcv
from forcemap.session import prepare

TRADE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

_TIER_ROWS = ", ".join(
    f"({i + 1}, {cap!r}e0, {rate!r}e0, {amount!r}e0)" for i, (cap, rate, amount) in enumerate(MAINTENANCE_TIERS)
)
_LEVERAGE_ROWS = ", ".join(f"({lev}, {share!r}e0)" for lev, share in LEVERAGE_SHARES.items())

VIEW_SQL = {
    "tiers": f"SELECT * FROM (VALUES {_TIER_ROWS}) t(tier, cap, rate, amount)",
    "leverages": f"SELECT * FROM (VALUES {_LEVERAGE_ROWS}) t(leverage, share)",
    # One row per trade; the four key columns make any order total.
    "trades": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS ts, l_returnflag AS symbol,
               CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side,
               l_extendedprice / l_quantity AS price, l_quantity AS quantity,
               l_extendedprice AS gross_value
        FROM lineitem""",
    "trade_marks": """
        SELECT symbol, arg_max(price, (ts, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS mark
        FROM trades GROUP BY symbol""",
    "ticks": """
        SELECT event_id, ts, event_type AS symbol, value AS price,
               CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS volume, user_id AS wallet
        FROM events""",
    "tick_marks": "SELECT symbol, arg_max(price, ts) AS mark, max(ts) AS last_ts FROM ticks GROUP BY symbol",
    "candles": """
        SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS open_time,
               arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, ts) AS close, sum(volume) AS volume
        FROM ticks GROUP BY ALL""",
    "oi": """
        SELECT event_type AS symbol, ts, 1000.0 + 10.0 * value AS oi_value FROM events""",
    "oi_hourly": """
        SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS bucket, arg_max(oi_value, ts) AS oi_value
        FROM oi GROUP BY ALL""",
    "oi_deltas": """
        SELECT symbol, bucket, oi_value,
               oi_value - lag(oi_value) OVER (PARTITION BY symbol ORDER BY bucket) AS oi_delta
        FROM oi_hourly""",
    "funding": """
        SELECT event_type AS symbol, time_bucket(INTERVAL '8 hours', ts) AS ts,
               (CAST(round(sum(value * 100)) AS BIGINT) / 100.0 / count(*) - 25.0) / 10000.0 AS rate
        FROM events GROUP BY ALL""",
    # One position per account and coin; signed size, mark from all orders of the coin.
    "positions": """
        SELECT o_custkey AS account, o_orderpriority AS coin,
               CAST(sum((CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END)
                    * CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100000.0 AS size,
               50.0 + CAST(sum(o_orderkey % 100) AS BIGINT) / CAST(count(*) AS DOUBLE) AS entry_px,
               CASE WHEN min(o_orderkey) % 4 = 0 THEN 'isolated' ELSE 'cross' END AS margin_type,
               CAST(5 + min(o_orderkey) % 20 AS DOUBLE) AS leverage
        FROM orders GROUP BY ALL""",
    "coin_marks": """
        SELECT o_orderpriority AS coin,
               50.0 + CAST(sum(o_orderkey % 100) AS BIGINT) / CAST(count(*) AS DOUBLE) AS mark
        FROM orders GROUP BY ALL""",
    # Levels of a modelled map: 10x forced-close price of every tick, binned per venue and symbol.
    "levels": """
        SELECT symbol, wallet % 4 AS venue, side, floor(liq / 5.0) * 5.0 AS price_level,
               sum(volume) AS volume, count(*) AS positions
        FROM (SELECT symbol, wallet, volume,
                     CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS side,
                     CASE WHEN event_id % 2 = 0 THEN price * (1 - 1e0 / 10 + 0.004)
                          ELSE price * (1 + 1e0 / 10 - 0.004) END AS liq
              FROM ticks)
        GROUP BY ALL""",
    # The same levels as four providers publish them: two grids, one provider with an extra tier.
    "provider_map": """
        SELECT symbol, 'p' || CAST(venue AS VARCHAR) AS provider, side,
               CASE positions % 3 WHEN 0 THEN 25 WHEN 1 THEN 50 ELSE CASE WHEN venue = 3 THEN 10 ELSE 100 END END AS leverage,
               CASE WHEN venue % 2 = 1 THEN floor(price_level / 10) * 10e0 ELSE price_level END AS price_level,
               sum(volume) AS volume
        FROM levels GROUP BY ALL""",
    # Expert predictions: every tick at a quarter-hour-aligned snapshot claims a level.
    "signals": """
        SELECT event_id AS obs_id, 'expert_' || CAST(wallet % 3 AS VARCHAR) AS expert, symbol,
               time_bucket(INTERVAL '15 minutes', ts) AS snapshot_ts,
               CASE WHEN event_id % 3 = 0 THEN price * 1.02e0 ELSE price END AS level_price,
               CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS side,
               volume / 100.0 AS confidence
        FROM ticks WHERE price > 0""",
    # Forced closes seen on the venue: every tick, side by account.
    "forced": """
        SELECT event_id, ts AS event_ts, symbol, CASE WHEN wallet % 2 = 0 THEN 'long' ELSE 'short' END AS side,
               price AS event_price, volume AS event_size
        FROM ticks""",
    # Daily validation runs: one row per order, score in 0..100.
    "runs": """
        SELECT o_orderkey AS run_id, CAST(o_orderdate AS TIMESTAMP) AS run_ts,
               'model_' || o_orderstatus AS model, o_orderpriority AS test,
               CAST(o_totalprice AS DOUBLE) / 5000.0 AS score,
               CASE WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey % 300 AS DOUBLE) END AS duration_seconds
        FROM orders""",
    # Closed signals with a profit or loss.
    "feedback": """
        SELECT event_id AS signal_id, event_type AS symbol, ts, value - 20.0 AS pnl,
               CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS side
        FROM events""",
}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def trades(self) -> DataFrame:
        return self.table("lineitem").select(
            *TRADE_KEY,
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            F.col("l_returnflag").alias("symbol"),
            F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("gross_value"),
        )

    @cached_property
    def trade_marks(self) -> DataFrame:
        return self.trades.groupBy("symbol").agg(
            F.max_by("price", F.struct("ts", *TRADE_KEY)).alias("mark")
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def ticks(self) -> DataFrame:
        return self.events.select(
            "event_id",
            "ts",
            F.col("event_type").alias("symbol"),
            F.col("value").alias("price"),
            F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("volume"),
            F.col("user_id").alias("wallet"),
        )

    @cached_property
    def tick_marks(self) -> DataFrame:
        return self.ticks.groupBy("symbol").agg(
            F.max_by("price", "ts").alias("mark"), F.max("ts").alias("last_ts")
        )

    @cached_property
    def candles(self) -> DataFrame:
        return ohlcv(self.ticks, "1h")

    @cached_property
    def oi(self) -> DataFrame:
        return self.events.select(
            F.col("event_type").alias("symbol"), "ts", (1000.0 + 10.0 * F.col("value")).alias("oi_value")
        )

    @cached_property
    def oi_hourly(self) -> DataFrame:
        from forcemap.operators.resample import last_per_bucket

        return last_per_bucket(self.oi, "oi_value", "1h")

    @cached_property
    def oi_deltas(self) -> DataFrame:
        from forcemap.operators.resample import level_delta

        return level_delta(self.oi_hourly, "oi_value", "bucket", out="oi_delta")

    @cached_property
    def funding(self) -> DataFrame:
        mean = F.round(F.sum(F.col("value") * 100)).cast("long") / 100.0 / F.count("*")
        return (
            self.events.groupBy(F.col("event_type").alias("symbol"), floor_time("ts", 8 * 3600).alias("ts"))
            .agg(((mean - 25.0) / 10000.0).alias("rate"))
        )

    @cached_property
    def positions(self) -> DataFrame:
        cents = F.round(F.col("o_totalprice") * 100).cast("long")
        signed = F.when(F.col("o_orderstatus") == "F", -cents).otherwise(cents)
        key = F.col("o_orderkey")
        return (
            self.table("orders")
            .groupBy(F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("coin"))
            .agg(
                (F.sum(signed) / 100000.0).alias("size"),
                (50.0 + F.sum(key % 100) / F.count("*")).alias("entry_px"),
                F.when(F.min(key) % 4 == 0, "isolated").otherwise("cross").alias("margin_type"),
                (5 + F.min(key) % 20).cast("double").alias("leverage"),
            )
        )

    @cached_property
    def coin_marks(self) -> DataFrame:
        return (
            self.table("orders")
            .groupBy(F.col("o_orderpriority").alias("coin"))
            .agg((50.0 + F.sum(F.col("o_orderkey") % 100) / F.count("*")).alias("mark"))
        )

    @cached_property
    def levels(self) -> DataFrame:
        even = F.col("event_id") % 2 == 0
        liq = F.when(even, F.col("price") * (1 - 1 / 10 + 0.004)).otherwise(
            F.col("price") * (1 + 1 / 10 - 0.004)
        )
        return (
            self.ticks.groupBy(
                "symbol",
                (F.col("wallet") % 4).alias("venue"),
                F.when(even, "long").otherwise("short").alias("side"),
                (F.floor(liq / 5.0).cast("double") * 5.0).alias("price_level"),
            ).agg(F.sum("volume").alias("volume"), F.count("*").alias("positions"))
        )

    @cached_property
    def provider_map(self) -> DataFrame:
        third = F.when(F.col("venue") == 3, 10).otherwise(100)
        lev = F.when(F.col("positions") % 3 == 0, 25).when(F.col("positions") % 3 == 1, 50).otherwise(third)
        wide = F.floor(F.col("price_level") / 10).cast("double") * 10.0
        return self.levels.groupBy(
            "symbol",
            F.concat(F.lit("p"), F.col("venue").cast("string")).alias("provider"),
            "side",
            lev.alias("leverage"),
            F.when(F.col("venue") % 2 == 1, wide).otherwise(F.col("price_level")).alias("price_level"),
        ).agg(F.sum("volume").alias("volume"))

    @cached_property
    def signals(self) -> DataFrame:
        return self.ticks.filter("price > 0").select(
            F.col("event_id").alias("obs_id"),
            F.concat(F.lit("expert_"), (F.col("wallet") % 3).cast("string")).alias("expert"),
            "symbol",
            floor_time("ts", "15m").alias("snapshot_ts"),
            F.when(F.col("event_id") % 3 == 0, F.col("price") * 1.02).otherwise(F.col("price")).alias("level_price"),
            F.when(F.col("event_id") % 2 == 0, "long").otherwise("short").alias("side"),
            (F.col("volume") / 100.0).alias("confidence"),
        )

    @cached_property
    def forced(self) -> DataFrame:
        return self.ticks.select(
            "event_id",
            F.col("ts").alias("event_ts"),
            "symbol",
            F.when(F.col("wallet") % 2 == 0, "long").otherwise("short").alias("side"),
            F.col("price").alias("event_price"),
            F.col("volume").alias("event_size"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("run_id"),
            F.col("o_orderdate").cast("timestamp").alias("run_ts"),
            F.concat(F.lit("model_"), "o_orderstatus").alias("model"),
            F.col("o_orderpriority").alias("test"),
            (F.col("o_totalprice") / 5000.0).alias("score"),
            F.when(F.col("o_orderkey") % 7 == 0, "failed").otherwise("completed").alias("status"),
            F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_custkey") % 300).cast("double")).alias("duration_seconds"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("signal_id"),
            F.col("event_type").alias("symbol"),
            "ts",
            (F.col("value") - 20.0).alias("pnl"),
            F.when(F.col("event_id") % 2 == 0, "long").otherwise("short").alias("side"),
        )
