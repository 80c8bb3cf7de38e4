"""File sources with explicit schemas: exchange CSV layouts, dated files, catalog Parquet, archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


DEC = "decimal(18,8)"
WIDE = "decimal(20,8)"


def _raw(spark: SparkSession, paths, columns: int) -> DataFrame:
    """CSV as text columns c0, c1, …, header lines included, bad files skipped."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(columns)])
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").csv(paths)


def _is_row(first: str = "c0") -> Column:
    """A data row starts with a whole number; header lines of either layout do not."""
    return F.col(first).try_cast("bigint").isNotNull()


def _millis(c: str) -> Column:
    return F.timestamp_millis(F.col(c).try_cast("bigint"))


def read_trades(spark: SparkSession, paths, symbol: str, exchange: str, start=None, end=None) -> DataFrame:
    """Trade CSV with or without header: id, price, quantity, first, last, time (ms), buyer-is-maker.

    Side follows the taker, gross value is price x quantity; rows outside [start, end] are dropped.
    """
    raw = _raw(spark, paths, 7).filter(_is_row())
    price, quantity = F.col("c1").try_cast(DEC), F.col("c2").try_cast(DEC)
    out = raw.select(
        F.col("c0").try_cast("bigint").alias("agg_trade_id"), _millis("c5").alias("timestamp"), F.lit(symbol).alias("symbol"),
        F.lit(exchange).alias("exchange"), price.alias("price"), quantity.alias("quantity"),
        F.when(F.lower("c6") == "true", "sell").otherwise("buy").alias("side"),
        (F.col("c1").try_cast("double") * F.col("c2").try_cast("double")).alias("gross_value"),
    )
    if start is not None:
        out = out.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.filter(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    return out


CANDLE_COLUMNS = [
    ("open_time", None), ("open", DEC), ("high", DEC), ("low", DEC), ("close", DEC), ("volume", DEC), ("close_time", None),
    ("quote_volume", WIDE), ("count", "int"), ("taker_buy_volume", DEC), ("taker_buy_quote_volume", WIDE),
]


def read_candles(spark: SparkSession, paths, symbol: str) -> DataFrame:
    """Candle CSV with or without header (twelve columns, the last is ignored)."""
    raw = _raw(spark, paths, 12).filter(_is_row())
    cols = [
        (_millis(f"c{i}") if kind is None else F.col(f"c{i}").try_cast(kind)).alias(name) for i, (name, kind) in enumerate(CANDLE_COLUMNS)
    ]
    return raw.select(F.lit(symbol).alias("symbol"), *cols)


def _named(spark: SparkSession, paths, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (
        spark.read.schema(schema).option("header", "true").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").csv(paths)
    )


def read_open_interest(spark: SparkSession, paths, symbol: str | None = None) -> DataFrame:
    raw = _named(spark, paths, ["create_time", "symbol", "sum_open_interest", "sum_open_interest_value"])
    out = raw.select(
        F.col("create_time").try_cast("timestamp").alias("timestamp"), "symbol",
        F.col("sum_open_interest_value").try_cast(WIDE).alias("open_interest_value"), F.col("sum_open_interest").try_cast(WIDE).alias("open_interest_contracts"),
    ).filter("timestamp IS NOT NULL")
    return out if symbol is None else out.filter(F.col("symbol") == symbol)


def read_funding(spark: SparkSession, paths, symbol: str) -> DataFrame:
    raw = _named(spark, paths, ["calc_time", "funding_interval_hours", "last_funding_rate"])
    return raw.select(
        _millis("calc_time").alias("timestamp"), F.lit(symbol).alias("symbol"), F.col("last_funding_rate").try_cast("decimal(10,8)").alias("funding_rate"),
        F.col("funding_interval_hours").try_cast("int").alias("funding_interval_hours"),
    )


RATIOS = ["count_toptrader_long_short_ratio", "sum_toptrader_long_short_ratio", "count_long_short_ratio", "sum_taker_long_short_vol_ratio"]


def read_ratios(spark: SparkSession, paths, symbol: str | None = None) -> DataFrame:
    raw = _named(spark, paths, ["create_time", "symbol", *RATIOS])
    out = raw.select(F.col("create_time").try_cast("timestamp").alias("timestamp"), "symbol", *[F.col(r).try_cast("double").alias(r) for r in RATIOS])
    out = out.filter("timestamp IS NOT NULL")
    return out if symbol is None else out.filter(F.col("symbol") == symbol)


def dated(df: DataFrame, start: str, end: str, monthly: bool = False) -> DataFrame:
    """Rows of files whose path carries a date (or month) in [start, end].

    The condition is on file metadata, so files outside the range are skipped, not read.
    """
    pattern = r"(\d{4}-\d{2})" if monthly else r"(\d{4}-\d{2}-\d{2})"
    stamp = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    lo, hi = (start[:7], end[:7]) if monthly else (start, end)
    return df.filter(stamp.between(lo, hi))


def read_catalog(spark: SparkSession, path: str, venue: str, timeframe: str, after=None) -> DataFrame:
    """Catalog Parquet of one venue and timeframe, perpetual suffix stripped, UTC timestamps."""
    d = spark.read.parquet(path).filter((F.col("venue") == venue) & (F.col("timeframe") == timeframe))
    if after is not None:
        d = d.filter(F.col("timestamp") > after)
    return d.withColumn("symbol", F.regexp_replace("symbol", "-PERP$", "")).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` with dataset (first folder), day in the path, length and time; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    clean = root.rstrip("/")
    below = F.regexp_replace("path", f"^.*{clean}/", "")
    return raw.select(
        "path", "length", "modificationTime", F.split(below, "/")[0].alias("dataset"),
        F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date").alias("day"),
    )


# ---- heterogeneous raw inputs --------------------------------------------

# Class -> (target, accepted source names, type).
RAW_COLUMNS: dict[str, list[tuple[str, list[str], str]]] = {
    "trades": [
        ("timestamp_ms", ["timestamp", "T", "time"], "bigint"), ("price", ["price", "p"], "double"),
        ("quantity", ["size", "qty", "quantity", "q"], "double"), ("side", ["side", "S"], "string"),
    ],
    "funding": [("timestamp_ms", ["funding_rate_timestamp", "timestamp"], "bigint"), ("funding_rate", ["funding_rate", "fundingRate"], "double")],
    "open_interest": [("timestamp_ms", ["timestamp"], "bigint"), ("open_interest_value", ["open_interest", "openInterest"], "double")],
    "orderbook": [
        ("timestamp_ms", ["timestamp"], "bigint"), ("side", ["side"], "string"), ("price", ["price"], "double"), ("size", ["size"], "double"),
    ],
    "klines": [
        ("timestamp_ms", ["timestamp"], "bigint"), ("open", ["open"], "double"), ("high", ["high"], "double"), ("low", ["low"], "double"),
        ("close", ["close"], "double"), ("volume", ["volume"], "double"),
    ],
}


def normalise_raw(df: DataFrame, kind: str) -> DataFrame:
    """One schema per class from rows that name columns differently; the first filled name wins.

    Rows without a time are dropped.
    """
    def pick(names: list[str], target: str) -> Column:
        have = [F.col(n).cast("string").try_cast(target) for n in names if n in df.columns]
        return F.coalesce(*have) if have else F.lit(None).cast(target)

    cols = [pick(names, kind_).alias(name) for name, names, kind_ in RAW_COLUMNS[kind]]
    return df.select(*cols).filter("timestamp_ms IS NOT NULL").withColumn("timestamp", F.timestamp_millis("timestamp_ms")).drop("timestamp_ms")


def candle_arrays(df: DataFrame, column: str) -> DataFrame:
    """Rows of a JSON array of [time, open, high, low, close, volume, …] arrays."""
    names = ["timestamp", "open", "high", "low", "close", "volume"]
    rows = df.select(F.explode(F.from_json(column, "array<array<string>>")).alias("_r"))
    return rows.select(*[F.col("_r")[i].alias(n) for i, n in enumerate(names)])


def json_records(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows of a JSON array of objects, or of an object holding one under ``result``."""
    item = "struct<" + ",".join(f"{n}:string" for n in names) + ">"
    inner = F.coalesce(F.get_json_object(column, "$.result"), F.col(column))
    return df.select(F.explode(F.from_json(inner, f"array<{item}>")).alias("_r")).select("_r.*")


def unzip_csv(archives: DataFrame, columns: list[str], content: str = "content") -> DataFrame:
    """Rows of all CSV members of ZIP archives held in a binary column; an archive is read by one task."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch[content]:
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for name in z.namelist():
                        if name.endswith(".csv"):
                            with z.open(name) as f:
                                yield pd.read_csv(f, dtype=str).reindex(columns=columns)

    return archives.select(content).mapInPandas(members, ", ".join(f"{c} string" for c in columns))
