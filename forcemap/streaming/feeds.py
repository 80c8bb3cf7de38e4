"""Streaming sources and stateless steps: parsing, union of venues, de-duplication, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CHAIN_TRADES = "struct<channel:string,data:array<struct<coin:string,px:string,sz:string,side:string,time:bigint,tid:bigint,liquidation:boolean>>>"


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def canonical_raw(symbol: str, quote: str = "USDT") -> str:
    """Configured symbol spelling to the venue's own, for the allow list."""
    plain = symbol.upper().replace("-PERP", "").replace("/", "").replace(":USDT", "")
    return plain if plain.endswith(quote) else plain + quote


def parse_force_orders(lines: DataFrame, symbols: list[str], column: str = "value") -> DataFrame:
    """Exchange force-order messages: allowed symbols, positive price and quantity.

    The average price is used where given; a SELL closes a long.
    """
    # Field names differ only in case (e/E, s/S), so they are read by path, which is case-sensitive.
    def field(path: str) -> Column:
        return F.get_json_object(column, path)

    raw = field("$.o.s")
    price = F.coalesce(field("$.o.ap"), field("$.o.p")).try_cast("double")
    quantity = field("$.o.q").try_cast("double")
    millis = F.coalesce(field("$.o.T"), field("$.E")).try_cast("bigint")
    return (
        lines.filter(field("$.e") == "forceOrder")
        .filter(raw.isin([canonical_raw(s) for s in symbols]))
        .select(
            F.timestamp_millis(millis).alias("ts"), F.concat(raw, F.lit("-PERP")).alias("symbol"), F.lit("exchange").alias("venue"),
            F.when(field("$.o.S") == "SELL", "long").otherwise("short").alias("side"), price.alias("price"), quantity.alias("quantity"),
            (price * quantity).alias("value"), field("$.o.i").try_cast("bigint").alias("order_id"),
        )
        .filter((F.col("price") > 0) & (F.col("quantity") > 0))
    )


def parse_chain_trades(lines: DataFrame, long_side: str = "A", column: str = "value") -> DataFrame:
    """On-chain trade messages flagged as liquidations. Which side code means a long is a parameter."""
    m = lines.select(F.from_json(column, CHAIN_TRADES).alias("m")).filter("m.channel = 'trades'")
    t = m.select(F.explode("m.data").alias("t")).filter("t.liquidation")
    price, quantity = F.col("t.px").try_cast("double"), F.col("t.sz").try_cast("double")
    return t.select(
        F.timestamp_millis("t.time").alias("ts"), F.concat("t.coin", F.lit("USDT-PERP")).alias("symbol"), F.lit("chain").alias("venue"),
        F.when(F.col("t.side") == long_side, "long").otherwise("short").alias("side"), price.alias("price"), quantity.alias("quantity"),
        (price * quantity).alias("value"), F.col("t.tid").alias("order_id"),
    ).filter((F.col("price") > 0) & (F.col("quantity") > 0))


def multiplex(streams: list[DataFrame]) -> DataFrame:
    """One stream of all venues."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def deduplicated(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """First row per key within the delay; state is dropped behind the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def window_candles(stream: DataFrame, interval: str, key="symbol", ts="ts", price="price", volume="volume", delay: str = "10 minutes") -> DataFrame:
    """Tumbling candles, emitted once the watermark has passed them."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(key, F.window(ts, interval))
        .agg(
            F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"),
            F.sum(volume).alias("volume"),
        )
        .select(key, F.col("window.start").alias("open_time"), "open", "high", "low", "close", "volume")
    )


# Lengths of the rolling windows, in hours.
ROLLING = {"1h": 1, "24h": 24, "7d": 168}


def sliding_metrics(stream: DataFrame, lengths: dict[str, int] | None = None, key="symbol", ts="ts", delay: str = "10 minutes") -> DataFrame:
    """Rolling total, profitable count, hit rate and mean result every hour, for every named window length in hours.

    Rows are summed per hour first, so only one row per key and hour is repeated for the windows it is in. The
    longest window holds the shorter ones, so one aggregation gives all lengths.
    """
    lengths = lengths or ROLLING
    hourly = (
        stream.withWatermark(ts, delay)
        .groupBy(key, F.window(ts, "1 hour"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pnl") > 0).alias("good"), F.sum("pnl").alias("pnl"))
        .select(key, F.window_time("window").alias("at"), "n", "good", "pnl")
    )
    held = hourly.select(key, "at", "n", "good", "pnl", F.window("at", f"{max(lengths.values())} hours", "1 hour").alias("span"))
    sums = []
    for name, hours in lengths.items():
        inside = F.col("at") >= F.col("span.end") - F.expr(f"INTERVAL {hours} HOURS")
        sums += [F.sum(F.when(inside, F.col(c))).alias(f"{c}_{name}") for c in ("n", "good", "pnl")]
    each = F.array(*[F.struct(F.lit(m).alias("length"), F.col(f"n_{m}").alias("total"), F.col(f"good_{m}").alias("profitable"), F.col(f"pnl_{m}").alias("_sum")) for m in lengths])
    found = held.groupBy(key, "span").agg(*sums).select(key, F.col("span.end").alias("window_end"), F.explode(each).alias("_e")).select(key, "window_end", "_e.*")
    n = F.col("total")
    return found.filter("total > 0").select(
        key, "length", "window_end", "total", "profitable", (F.col("profitable") / n).alias("hit_rate"), (F.col("_sum") / n).alias("avg_pnl")
    )


def shadow_positions(entries: DataFrame, exits: DataFrame, hold: str = "7 days", delay: str = "10 minutes") -> DataFrame:
    """Entries joined to their exits by signal id, with the result by side.

    Entries: signal_id, symbol, side, entry_price, entry_ts; exits: exit_id, exit_price, exit_ts. Works on
    streams (bounded by ``hold``) and on tables.
    """
    a, b = entries.withWatermark("entry_ts", delay), exits.withWatermark("exit_ts", delay)
    within = F.col("exit_ts").between(F.col("entry_ts"), F.col("entry_ts") + F.expr(f"INTERVAL {hold}"))
    move = F.col("exit_price") - F.col("entry_price")
    return a.join(b, (F.col("signal_id") == F.col("exit_id")) & within).select(
        "signal_id", "symbol", "side", "entry_price", "exit_price", "exit_ts", F.when(F.col("side") == "long", move).otherwise(-move).alias("pnl")
    )
