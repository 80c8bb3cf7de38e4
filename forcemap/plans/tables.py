"""Sources, sinks and table maintenance.

Queries over files first write the given tables in the source's layout to the shared folder.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forcemap.functions.columns import floor_time
from forcemap.operators import tables
from forcemap.operators.distributions import explode_sides, to_distribution
from forcemap.plans.registry import query
from forcemap.session import fresh_path, staged
from forcemap.sources import artifacts, blocks, files


def millis(ts: str):
    return F.unix_millis(F.col(ts))


@query(
    "S1",
    """SELECT l_orderkey * 10 + l_linenumber AS agg_trade_id, ts AS timestamp, CAST(quantity AS DOUBLE) AS quantity, CAST(gross_value AS DOUBLE) AS price,
              CASE WHEN (l_partkey + l_suppkey) % 2 = 0 THEN 'sell' ELSE 'buy' END AS side, gross_value * quantity AS gross_value
       FROM trades WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '2000-06-30'""",
)
def trade_files(v):
    t = v.trades.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("agg_trade_id"), F.col("gross_value").alias("price"), "quantity",
        F.lit(0).alias("first_trade_id"), F.lit(0).alias("last_trade_id"), millis("ts").alias("transact_time"),
        ((F.col("l_partkey") + F.col("l_suppkey")) % 2 == 0).alias("is_buyer_maker"), "symbol",
    )
    root = fresh_path(v.spark, "trades")
    t.filter("symbol = 'A'").drop("symbol").write.csv(f"{root}/with-header", header=True)
    t.filter("symbol <> 'A'").drop("symbol").write.csv(f"{root}/without-header", header=False)
    out = files.read_trades(v.spark, root, "X", "venue", "1996-01-01", "2000-06-30")
    return out.select(
        "agg_trade_id", "timestamp", F.col("quantity").cast("double").alias("quantity"), F.col("price").cast("double").alias("price"), "side", "gross_value"
    )


@query(
    "S2",
    """SELECT open_time, open, high, low, close, volume, open_time + INTERVAL '1 hour' - INTERVAL '1 millisecond' AS close_time, volume * 2 AS quote_volume, 7 AS count FROM candles""",
)
def candle_files(v):
    c = v.candles.select(
        millis("open_time").alias("open_time"), "open", "high", "low", "close", "volume", (millis("open_time") + 3_599_999).alias("close_time"),
        (F.col("volume") * 2).alias("quote_volume"), F.lit(7).alias("count"), F.lit(1.5).alias("taker_buy_volume"), F.lit(2.5).alias("taker_buy_quote_volume"),
        F.lit(0).alias("ignore"), "symbol",
    )
    root = fresh_path(v.spark, "candles")
    c.filter("symbol = 'click'").drop("symbol").write.csv(f"{root}/with-header", header=True)
    c.filter("symbol <> 'click'").drop("symbol").write.csv(f"{root}/without-header", header=False)
    d = files.read_candles(v.spark, root, "X")
    return d.select("open_time", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")], "close_time", F.col("quote_volume").cast("double").alias("quote_volume"), "count")


@query(
    "S3",
    """SELECT 'open_interest' AS kind, symbol, date_trunc('second', ts) AS timestamp, round(oi_value, 2) AS value FROM oi
       UNION ALL SELECT 'funding', 'X', ts, floor(rate * 1000000) / 1000000 FROM funding UNION ALL SELECT 'ratio', symbol, date_trunc('second', ts), price / 100 FROM ticks""",
)
def metric_files(v):
    root = fresh_path(v.spark, "metrics")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("create_time")
    v.oi.select(text, "symbol", F.lit(1.0).alias("sum_open_interest"), F.round("oi_value", 2).alias("sum_open_interest_value")).write.csv(f"{root}/oi", header=True)
    v.funding.select(millis("ts").alias("calc_time"), F.lit(8).alias("funding_interval_hours"), F.format_string("%.8f", F.floor(F.col("rate") * 1000000) / 1000000).alias("last_funding_rate")).write.csv(
        f"{root}/funding", header=True
    )
    v.ticks.select(text, "symbol", *[(F.col("price") / d).alias(r) for d, r in zip((100, 200, 300, 400), files.RATIOS)]).write.csv(f"{root}/ratio", header=True)
    a = files.read_open_interest(v.spark, f"{root}/oi").select(F.lit("open_interest").alias("kind"), "symbol", "timestamp", F.col("open_interest_value").cast("double").alias("value"))
    b = files.read_funding(v.spark, f"{root}/funding", "X").select(F.lit("funding").alias("kind"), "symbol", "timestamp", F.col("funding_rate").cast("double").alias("value"))
    c = files.read_ratios(v.spark, f"{root}/ratio").select(F.lit("ratio").alias("kind"), "symbol", "timestamp", F.col(files.RATIOS[0]).alias("value"))
    return a.unionByName(b).unionByName(c)


@query(
    "S4",
    """SELECT event_id, price FROM ticks WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'""",
)
def dated_files(v):
    root = fresh_path(v.spark, "daily")
    v.ticks.withColumn("date", F.date_format("ts", "yyyy-MM-dd")).select("event_id", "price", "date").write.partitionBy("date").parquet(root)
    d = v.spark.read.option("ignoreCorruptFiles", "true").schema("event_id long, price double, date string").parquet(root)
    return files.dated(d, "2024-01-05", "2024-01-12").select("event_id", "price")


@query(
    "S5",
    """SELECT symbol, open_time AS timestamp, close FROM candles WHERE symbol <> 'signup' AND open_time > TIMESTAMP '2024-01-10'""",
)
def catalog(v):
    root = fresh_path(v.spark, "catalog")
    venue = F.when(F.col("symbol") == "signup", "other").otherwise("venue")
    v.candles.select(
        F.concat("symbol", F.lit("-PERP")).alias("symbol"), venue.alias("venue"), F.lit("1h").alias("timeframe"), F.col("open_time").alias("timestamp"), "close"
    ).write.partitionBy("venue", "timeframe").parquet(root)
    return files.read_catalog(v.spark, root, "venue", "1h", F.lit("2024-01-10").cast("timestamp")).select("symbol", "timestamp", "close")


@query(
    "S6",
    """SELECT event_id AS trade_id, user_id || 'w' AS wallet, event_type AS coin, value AS price, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS size, event_id // 4 AS block_number,
              CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS side, CASE WHEN event_id % 3 = 0 THEN value - 20 ELSE 0 END AS closed_pnl
       FROM events WHERE value >= 1 AND event_type IN ('click', 'view', 'purchase')""",
)
def fill_blocks(v):
    e = v.events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0))
    key = F.col("event_id")
    fill = F.to_json(
        F.struct(
            F.col("event_type").alias("coin"), F.when(F.col("value") < 0.5, "n/a").otherwise(F.col("value").cast("string")).alias("px"), F.col("k").alias("sz"),
            F.when(key % 2 == 0, "A").otherwise("B").alias("side"), F.lit("Close Long").alias("dir"), F.when((F.col("value") < 0.5) | (F.col("value") >= 1), key).alias("tid"),
            F.when(key % 3 == 0, (F.col("value") - 20).cast("string")).alias("closedPnl"), (key % 2 == 0).alias("crossed"),
        )
    )
    pair = F.concat(F.lit('["'), F.col("user_id").cast("string"), F.lit('w",'), fill, F.lit("]"))
    lines = (
        e.groupBy(F.floor(key / 4).alias("b"))
        .agg(F.concat_ws(",", F.collect_list(pair)).alias("events"))
        .select(F.concat(F.lit('{"block_time":"t","block_number":'), F.col("b").cast("string"), F.lit(',"events":['), "events", F.lit("]}")).alias("value"))
    )
    path = fresh_path(v.spark, "blocks")
    lines.write.text(path, compression="gzip")
    f = blocks.read_fill_blocks(v.spark, path, ["click", "view", "purchase"])
    return f.select("trade_id", "wallet", "coin", "price", "size", "block_number", "side", "closed_pnl")


@query(
    "S7",
    """SELECT 'funding' AS input_class, count(*) AS row_count, round(sum(rate * 1000000), 3) AS total FROM funding UNION ALL SELECT 'open_interest', count(*), round(sum(oi_value), 2) FROM oi
       UNION ALL SELECT 'orderbook', count(*), round(sum(price * volume), 2) FROM ticks UNION ALL SELECT 'klines', count(*), round(sum(close), 4) FROM candles
       UNION ALL SELECT 'trades', count(*), round(sum(price * volume), 2) FROM ticks""",
)
def raw_classes(v):
    def summary(kind, df, value):
        n = files.normalise_raw(df, kind)
        total = n.agg(F.lit(kind).alias("input_class"), F.count("*").alias("row_count"), value.alias("total"))
        return total

    ms = millis("ts").cast("string")
    # One document per symbol and day, as a venue's history gives them.
    fund = v.funding.groupBy("symbol", floor_time("ts", "1d")).agg(
        F.to_json(F.struct(F.collect_list(F.struct(ms.alias("funding_rate_timestamp"), F.col("rate").cast("string").alias("funding_rate"))).alias("result"))).alias("value")
    )
    oi = v.oi.groupBy("symbol", floor_time("ts", "1h")).agg(
        F.to_json(F.collect_list(F.struct(ms.alias("timestamp"), F.col("oi_value").cast("string").alias("open_interest")))).alias("value")
    )
    kl = v.candles.groupBy("symbol", floor_time("open_time", "1d")).agg(
        F.to_json(F.collect_list(F.array(millis("open_time").cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")]))).alias("value")
    )
    books = _zipped_books(v)
    path = fresh_path(v.spark, "trades")
    v.ticks.select(millis("ts").alias("T"), F.col("price").alias("p"), F.col("volume").alias("q"), F.lit("Buy").alias("S")).write.option("header", True).csv(path, compression="gzip")
    parts = [
        summary("trades", v.spark.read.option("header", True).csv(path), F.round(F.sum(F.col("price") * F.col("quantity")), 2)),
        summary("funding", files.json_records(fund, "value", ["funding_rate_timestamp", "timestamp", "funding_rate"]), F.round(F.sum(F.col("funding_rate") * 1000000), 3)),
        summary("open_interest", files.json_records(oi, "value", ["timestamp", "open_interest"]), F.round(F.sum("open_interest_value"), 2)),
        summary("orderbook", files.unzip_csv(books, ["timestamp", "side", "price", "size"]), F.round(F.sum(F.col("price") * F.col("size")), 2)),
        summary("klines", files.candle_arrays(kl, "value"), F.round(F.sum("close"), 4)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _zipped_books(v):
    """One ZIP archive per symbol and hour, built in tasks from the ticks."""
    @F.pandas_udf(T.BinaryType())
    def zipped(text: pd.Series) -> pd.Series:
        def one(body: str) -> bytes:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("book.csv", "timestamp,side,price,size\n" + body)
            return buffer.getvalue()

        return text.map(one)

    line = F.concat_ws(",", millis("ts").cast("string"), F.lit("bid"), F.col("price").cast("string"), F.col("volume").cast("string"))
    return v.ticks.groupBy("symbol", floor_time("ts", "1h")).agg(F.concat_ws("\n", F.collect_list(line)).alias("t")).select(zipped("t").alias("content"))


KEYS = ["l_orderkey", "l_linenumber"]


@query(
    "S8",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, gross_value FROM trades WHERE symbol = 'A'),
       i AS (SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, gross_value, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS r FROM trades) WHERE r = 1 AND (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM t))
       SELECT * FROM t UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, gross_value FROM i""",
)
def idempotent(v):
    t = v.trades.select(*KEYS, "l_partkey", "l_suppkey", "gross_value", "symbol")
    return tables.insert_or_ignore(t.filter("symbol = 'A'").drop("symbol"), t.drop("symbol"), KEYS, ["l_partkey", "l_suppkey"])


@query(
    "S9",
    """WITH o AS (SELECT symbol, open_time, close, 0 AS version FROM candles WHERE symbol <> 'view'), n AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS open_time, arg_max(price, volume * 100000 + event_id % 100000) AS close, 1 AS version FROM ticks WHERE symbol IN ('view', 'click') GROUP BY ALL)
       SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.open_time, o.open_time) AS open_time, coalesce(n.close, o.close) AS close, coalesce(n.version, o.version) AS version FROM o FULL JOIN n ON o.symbol = n.symbol AND o.open_time = n.open_time""",
)
def upserted(v):
    old = v.candles.filter("symbol <> 'view'").select("symbol", "open_time", "close", F.lit(0).alias("version"), F.lit(0.0).alias("rank"))
    new = v.ticks.filter(F.col("symbol").isin("view", "click")).select(
        "symbol", floor_time("ts", "1h").alias("open_time"), F.col("price").alias("close"), F.lit(1).alias("version"),
        (F.col("volume") * 100000 + F.col("event_id") % 100000).alias("rank"),
    )
    path = fresh_path(v.spark, "candles")
    old.write.partitionBy("symbol").parquet(path)
    tables.upsert_table(path, new, ["symbol", "open_time"], ["rank"], ["symbol"])
    return v.spark.read.parquet(path).drop("rank")


@query(
    "S9_counts",
    """WITH o AS (SELECT symbol, open_time FROM candles WHERE CAST(open_time AS DATE) < DATE '2024-01-20') SELECT c.symbol, count(*) AS offered, count(*) FILTER (o.symbol IS NULL) AS inserted FROM candles c LEFT JOIN o ON o.symbol = c.symbol AND o.open_time = c.open_time GROUP BY c.symbol""",
)
def upsert_counts(v):
    c = v.candles.select("symbol", "open_time")
    return tables.inserted_count(c.filter(F.col("open_time") < F.lit("2024-01-20").cast("timestamp")), c, ["symbol", "open_time"], ["symbol"])


@query(
    "S10",
    """WITH t AS (SELECT symbol, max(ts) AS mark FROM ticks WHERE symbol <> 'error' AND ts < TIMESTAMP '2024-01-21' GROUP BY symbol)
       SELECT event_id, k.symbol, ts FROM ticks k LEFT JOIN t ON t.symbol = k.symbol WHERE ts > coalesce(mark, (SELECT max(ts) FROM ticks) - INTERVAL '14 days')""",
)
def incremental(v):
    now = v.ticks.agg(F.max("ts")).scalar()
    target = v.ticks.filter((F.col("symbol") != "error") & (F.col("ts") < F.lit("2024-01-21").cast("timestamp")))
    return tables.after_watermark(v.ticks, target, ["symbol"], "ts", now).select("event_id", "symbol", "ts")


@query(
    "S11",
    """WITH d AS (SELECT *, CASE symbol WHEN 'click' THEN 7 WHEN 'view' THEN 14 END AS days, (SELECT max(ts) FROM ticks) AS now FROM ticks)
       SELECT symbol, count(*) FILTER (days IS NULL OR ts >= now - to_days(days)) AS kept, count(*) FILTER (days IS NOT NULL AND ts < now - to_days(days)) AS deleted FROM d GROUP BY symbol""",
)
def retention(v):
    now = v.ticks.agg(F.max("ts")).scalar()
    days = F.when(F.col("symbol") == "click", 7).when(F.col("symbol") == "view", 14)
    path = fresh_path(v.spark, "ticks")
    v.ticks.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.partitionBy("symbol", "day").parquet(path)
    planned = staged(tables.retention_counts(tables.retained(v.ticks, "ts", now, days), ["symbol"]), "planned")
    tables.prune_table(v.spark, path, ["symbol", "day"], "ts", now, days)
    left = v.spark.read.parquet(path).groupBy("symbol").agg(F.count("*").alias("kept"))
    return planned.drop("kept").join(left, "symbol", "left").fillna(0, ["kept"])


@query(
    "S12",
    """WITH a AS (SELECT symbol, arg_max(price, ts) AS value, max(ts) AS as_of, '1m' AS source, 0 AS r FROM ticks WHERE symbol IN ('click', 'view') GROUP BY symbol UNION ALL
                 SELECT symbol, arg_max(close, open_time), max(open_time), '1h', 1 FROM candles WHERE symbol <> 'error' GROUP BY symbol UNION ALL
                 SELECT symbol, arg_max(oi_value, ts), max(ts), 'oi', 2 FROM oi GROUP BY symbol)
       SELECT symbol, arg_min(value, r) AS value, arg_min(as_of, r) AS as_of, arg_min(source, r) AS source FROM a GROUP BY symbol""",
)
def latest(v):
    return tables.latest_with_fallback(
        {
            "1m": v.ticks.filter(F.col("symbol").isin("click", "view")).select("symbol", "ts", F.col("price").alias("x")),
            "1h": v.candles.filter("symbol <> 'error'").select("symbol", F.col("open_time").alias("ts"), F.col("close").alias("x")),
            "oi": v.oi.select("symbol", "ts", F.col("oi_value").alias("x")),
        },
        "symbol", "ts", "x",
    )


@query(
    "S13",
    """SELECT event_id, symbol, ts FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM ticks) WHERE r <= 50""",
)
def newest(v):
    return tables.recent(v.ticks, ["symbol"], [F.desc("ts")], 50).select("event_id", "symbol", "ts")


@query("S13_range", "SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20') AS in_range FROM ticks GROUP BY symbol")
def ranges(v):
    inside = F.col("ts").between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return v.ticks.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(inside).alias("in_range"))


@query(
    "S14",
    """SELECT symbol, date_trunc('day', event_ts)::TIMESTAMP AS ts, floor(event_price / 10) * 10e0 AS price_bucket, coalesce(sum(event_size) FILTER (side = 'long'), 0) AS long_density, coalesce(sum(event_size) FILTER (side = 'short'), 0) AS short_density
       FROM forced GROUP BY ALL HAVING sum(event_size) > 0""",
)
def snapshot_round_trip(v):
    from forcemap.functions.columns import floor_bin

    long = v.forced.groupBy("symbol", F.date_trunc("day", "event_ts").alias("ts"), floor_bin("event_price", 10.0).alias("price_bucket"), "side").agg(F.sum("event_size").alias("active_volume"))
    stored = staged(tables.to_long(tables.to_cells(long)), "snapshots")
    return tables.to_cells(stored)


@query(
    "S15",
    """WITH c AS (SELECT symbol, open_time AS ts, open_time + INTERVAL '10 minutes' AS computed_at FROM candles WHERE open_time BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-29'),
       g AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS gap FROM c),
       r AS (SELECT symbol, count(*) AS rows, epoch(min(ts)) - epoch(TIMESTAMP '2024-01-02') >= 3600 AS leading_hole, epoch(TIMESTAMP '2024-01-29') - epoch(max(ts)) >= 3600 AS trailing_hole, coalesce(max(gap) > 3600, false) AS interior_hole,
                    epoch(TIMESTAMP '2024-01-30') - epoch(min(computed_at)) > 40 * 86400 AS stale FROM g GROUP BY symbol)
       SELECT *, NOT (leading_hole OR trailing_hole OR interior_hole OR stale) AS usable FROM r""",
)
def coverage(v):
    cache = v.candles.select("symbol", F.col("open_time").alias("ts"), (F.col("open_time") + F.expr("INTERVAL 10 MINUTES")).alias("computed_at"))
    at = [F.lit(d).cast("timestamp") for d in ("2024-01-02", "2024-01-29", "2024-01-30")]
    return tables.cache_coverage(cache, ["symbol"], *at, 3600, 40 * 86400)


def day_artifacts(v):
    t = v.forced.select(
        F.concat(F.lit("expert_"), (F.col("event_id") % 3).cast("string")).alias("expert_id"), "symbol", F.date_format("event_ts", "yyyy-MM-dd").alias("snapshot_day"),
        F.col("event_price").alias("price_level"), F.col("event_size").alias("volume"), "side",
    )
    d = to_distribution(t, ["expert_id", "symbol", "snapshot_day"], 5.0)
    grid = F.struct(F.col("grid_min").alias("min_price"), F.col("grid_max").alias("max_price"), F.col("grid_step").alias("step"))

    def text_keys(side: str):
        return F.transform_keys(f"{side}_distribution", lambda k, _: k.cast("string")).alias(f"{side}_distribution")

    return d.select(
        "expert_id", "symbol", "snapshot_day", F.concat("snapshot_day", F.lit("T00:00:00Z")).alias("snapshot_ts"), F.lit(100.0).alias("reference_price"),
        grid.alias("bucket_grid"), text_keys("long"), text_keys("short"),
    )


@query(
    "S16",
    """SELECT 'expert_' || CAST(event_id % 3 AS VARCHAR) AS expert_id, symbol, strftime(event_ts, '%Y-%m-%d') || 'T00:00:00Z' AS snapshot_ts, side, round(event_price / 5e0) * 5e0 AS bucket, sum(event_size) AS volume
       FROM forced WHERE symbol IN ('click', 'view') AND event_id % 3 IN (0, 1) AND NOT (event_id % 3 = 1 AND day(event_ts) % 2 = 0) GROUP BY ALL""",
)
def retained_artifacts(v):
    a = staged(day_artifacts(v), "artifacts")
    root = fresh_path(v.spark, "artifacts")
    a.drop("snapshot_day").write.json(f"{root}/artifacts")
    status = F.when((F.col("expert_id") == "expert_1") & (F.dayofmonth(F.to_date("snapshot_day")) % 2 == 0), "blocked_source_missing").otherwise("available")
    artifacts.export_manifests(a.withColumn("availability_status", status), f"{root}/manifests")
    got = artifacts.read_available(v.spark, f"{root}/manifests", f"{root}/artifacts", ["click", "view"], ["expert_0", "expert_1"])
    return explode_sides(got.select("expert_id", "symbol", "snapshot_ts", "long_distribution", "short_distribution")).select(
        "expert_id", "symbol", "snapshot_ts", "side", F.col("bucket").cast("double").alias("bucket"), "volume"
    )


def _canonical_map(side: str) -> str:
    """The side's buckets as key-sorted JSON entries, in SQL."""
    entry = """'{"key":"' || bucket || '","value":' || volume || '}'"""
    return f"""'[' || coalesce(string_agg({entry}, ',' ORDER BY bucket) FILTER (side = '{side}'), '') || ']'"""


@query(
    "S17",
    f"""WITH c AS (SELECT 'expert_' || event_id % 3 AS expert_id, symbol, strftime(event_ts, '%Y-%m-%d') AS d, side, round(event_price / 5e0) * 5e0 AS b, sum(event_size) AS volume FROM forced GROUP BY ALL),
        t AS (SELECT *, CAST(b AS VARCHAR) AS bucket FROM c),
        g AS (SELECT expert_id, symbol, d || 'T00:00:00Z' AS snapshot_ts, count(*) FILTER (side = 'long') AS long_buckets, count(*) FILTER (side = 'short') AS short_buckets,
                     '{{"expert_id":"' || expert_id || '","symbol":"' || symbol || '","snapshot_ts":"' || d || 'T00:00:00Z","reference_price":100.0,"bucket_grid":{{"min_price":' || min(b) || ',"max_price":' || max(b)
                     || ',"step":5.0}},"long_distribution":' || {_canonical_map("long")} || ',"short_distribution":' || {_canonical_map("short")} || '}}' AS body
              FROM t GROUP BY expert_id, symbol, d)
        SELECT expert_id, symbol, snapshot_ts, sha256(body) AS content_hash, long_buckets::INTEGER AS long_buckets, short_buckets::INTEGER AS short_buckets,
               'available' AS availability_status, 'symbol=' || symbol || '/snapshot_day=' || snapshot_ts[:10] AS artifact_path FROM g""",
)
def exported(v):
    a = staged(artifacts.with_hash(day_artifacts(v), ["expert_id", "symbol", "snapshot_ts", "reference_price", "bucket_grid", "long_distribution", "short_distribution"]), "hashed")
    root = fresh_path(v.spark, "export")
    artifacts.export(a, f"{root}/artifacts")
    artifacts.export_manifests(a.withColumn("availability_status", F.lit("available")), f"{root}/manifests")
    schema = artifacts.ARTIFACT.replace("symbol string, ", "") + ", content_hash string, symbol string, snapshot_day string"
    stored = v.spark.read.schema(schema).json(f"{root}/artifacts").select("expert_id", "symbol", "snapshot_ts", "content_hash", F.size("long_distribution").alias("long_buckets"), F.size("short_distribution").alias("short_buckets"))
    listed = v.spark.read.schema(artifacts.MANIFEST).json(f"{root}/manifests").select("symbol", "snapshot_ts", F.explode("experts").alias("expert_id", "_e")).select("symbol", "snapshot_ts", "expert_id", "_e.*")
    return stored.join(listed, ["symbol", "snapshot_ts", "expert_id"])


@query(
    "S18",
    """SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS trade_date, floor(price / 500) * 500e0 AS price_bin, round(sum(gross_value), 2) AS total_volume, count(*) AS trade_count FROM trades WHERE gross_value >= 50000 GROUP BY ALL""",
)
def profile(v):
    p = staged(tables.volume_profile(v.trades, 500.0, 50000.0), "profile")
    return p.withColumn("total_volume", F.round("total_volume", 2))


@query(
    "S19",
    """WITH f AS (SELECT DISTINCT event_type AS dataset, CAST(ts AS DATE) AS day FROM events)
       SELECT dataset, count(*) FILTER (day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25') AS days_present, strftime(max(day) FILTER (day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'), '%Y-%m-%d') AS latest_day,
              strftime(max(day) FILTER (day <= DATE '2024-01-05'), '%Y-%m-%d') AS anchor_day, 21 - count(*) FILTER (day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25') AS days_missing FROM f GROUP BY dataset""",
)
def dataset_days(v):
    root = fresh_path(v.spark, "datasets")
    days = v.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    # The operator looks at file names only; each dataset and day that occurs becomes one folder.
    days.select(F.col("event_type").alias("dataset"), "day").distinct().withColumn("x", F.lit(1)).withColumn("d", F.col("dataset")).write.partitionBy("d", "day").parquet(root)
    f = files.list_files(v.spark, root).filter("day IS NOT NULL").withColumn("dataset", F.regexp_replace("dataset", "^d=", ""))
    c = tables.dataset_coverage(f, F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date"))
    return c.select(
        "dataset", "days_present", F.date_format("latest_day", "yyyy-MM-dd").alias("latest_day"), F.date_format("anchor_day", "yyyy-MM-dd").alias("anchor_day"), F.col("days_missing").cast("long").alias("days_missing")
    )


@query(
    "H15",
    """WITH d AS (SELECT DISTINCT event_type AS symbol, CAST(ts AS DATE) AS day FROM events), q AS (SELECT symbol, day, ch AS channel, unnest(CASE ch WHEN 'standard' THEN ['klines', 'trades'] ELSE ['klines', 'trades', 'orderbook'] END) AS ic FROM d CROSS JOIN (SELECT unnest(['standard', 'depth_weighted']) AS ch)),
       f AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, CASE user_id % 3 WHEN 0 THEN 'klines' WHEN 1 THEN 'trades' ELSE 'orderbook' END AS ic, min(CASE WHEN value < 8 THEN 0 WHEN value < 16 THEN 1 ELSE 2 END) AS rk FROM events GROUP BY ALL),
       j AS (SELECT q.*, CASE WHEN q.ic = 'orderbook' AND q.day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' THEN NULL ELSE rk END AS rk FROM q LEFT JOIN f ON f.symbol = q.symbol AND f.day = q.day AND f.ic = q.ic)
       SELECT symbol, strftime(day, '%Y-%m-%d') AS day, channel, count(*) AS required, count(*) FILTER (rk IS NULL) AS missing, CASE WHEN bool_or(rk IS NULL) THEN 'blocked_source_missing' WHEN bool_or(rk = 2) THEN 'blocked_source_unverified' ELSE 'available' END AS status FROM j GROUP BY ALL""",
)
def ready(v):
    e = v.events.withColumn("day", F.to_date("ts")).withColumn("symbol", F.col("event_type"))
    standard, deep = ["klines", "trades"], ["klines", "trades", "orderbook"]
    need = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(i).alias("input_class")) for c, xs in (("standard", standard), ("depth_weighted", deep)) for i in xs])
    req = e.select("symbol", "day").distinct().select("symbol", "day", F.explode(need).alias("n")).select("symbol", "day", "n.*")
    kind = F.when(F.col("value") < 8, "catalog").when(F.col("value") < 16, "normalised").otherwise("raw")
    cls = F.element_at(F.array(*[F.lit(x) for x in deep]), (F.col("user_id") % 3 + 1).cast("int"))
    listed = e.select("symbol", "day", cls.alias("input_class"), kind.alias("kind"))
    r = tables.readiness(req, listed, ("2024-01-10", "2024-01-12"))
    return r.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
