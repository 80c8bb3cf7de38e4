"""Table maintenance: idempotent inserts, upserts, watermarks, retention, lookups and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forcemap.functions import columns as C
from forcemap.operators.joins import attach
from forcemap.session import staged


def new_rows(target: DataFrame, incoming: DataFrame, keys: list[str], tiebreak: list[str]) -> DataFrame:
    """Incoming rows whose key is new, first by ``tiebreak`` among copies of a key.

    Copies collapse in a grouped minimum before the anti-join.
    """
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*tiebreak)).alias("_r")).select(*keys, "_r.*")
    return first.join(target.select(*keys), keys, "left_anti").select(*incoming.columns)


def insert_or_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], tiebreak: list[str]) -> DataFrame:
    return target.unionByName(new_rows(target, incoming, keys, tiebreak))


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Target after replacing or adding rows; among versions of a key the latest wins, incoming over old."""
    rest = [c for c in target.columns if c not in keys]
    both = target.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", *version)).alias("_r")).select(*keys, "_r.*")


def _replace_partitions(rows: DataFrame, path: str, partition: list[str]) -> None:
    """Write whole partitions in place of the stored ones; other partitions stay. ``rows`` mustn't read ``path``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def upsert_table(path: str, incoming: DataFrame, keys: list[str], version: list[str], partition: list[str]) -> None:
    """Upsert into a partitioned Parquet table; only partitions that ``incoming`` touches are read and rewritten.

    The partition columns are keys, so a key never moves between partitions.
    """
    if not set(partition) <= set(keys):
        raise ValueError("partition columns must be keys")
    target = incoming.sparkSession.read.parquet(path)
    touched = target.join(incoming.select(*partition).distinct(), partition, "left_semi")
    _replace_partitions(staged(upsert(touched, incoming.select(*target.columns), keys, version), "merged"), path, partition)


def inserted_count(target: DataFrame, incoming: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Keys added (not replaced) by an upsert, per group."""
    added = incoming.select(*keys).distinct().join(target.select(*keys), keys, "left_anti")
    total = incoming.select(*keys).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("offered"))
    n = added.groupBy(*group).agg(F.count(F.lit(1)).alias("inserted"))
    return total.join(n, group, "left").fillna(0, ["inserted"])


def after_watermark(source: DataFrame, target: DataFrame, keys: list[str], ts: str, now: Column, bootstrap_days: int = 14) -> DataFrame:
    """Source rows newer than the target's latest per key; a key new to the target starts ``bootstrap_days`` back."""
    marks = target.groupBy(*keys).agg(F.max(ts).alias("_mark"))
    start = F.coalesce("_mark", now - F.expr(f"INTERVAL {bootstrap_days} DAYS"))
    return attach(source, marks, keys, "left").filter(F.col(ts) > start).drop("_mark")


def retained(df: DataFrame, ts: str, now: Column, days: Column) -> DataFrame:
    """Rows with ``keep``: not older than their retention; a null retention keeps everything."""
    cutoff = now - F.make_dt_interval(days=days)
    return df.withColumn("keep", days.isNull() | (F.col(ts) >= cutoff))


def retention_counts(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """What a retention run would keep and delete (dry run)."""
    return flagged.groupBy(*keys).agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("deleted"))


def prune_table(spark: SparkSession, path: str, partition: list[str], ts: str, now: Column, days: Column) -> None:
    """Delete the expired rows of a partitioned Parquet table.

    Partitions without any are left alone, partly expired ones rewritten, wholly expired ones removed.
    """
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]+$", "")
    flagged = retained(spark.read.parquet(path).withColumn("_folder", folder), ts, now, days)
    touched = staged(retention_counts(flagged, ["_folder"]).filter("deleted > 0"), "touched")
    left = flagged.join(touched.filter("kept > 0").select("_folder"), "_folder", "left_semi").filter("keep").drop("_folder", "keep")
    _replace_partitions(staged(left, "left"), path, partition)
    jvm = spark._jvm
    for row in touched.filter("kept = 0").select("_folder").toLocalIterator():  # folders: the calendar bounds them
        gone = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["_folder"]))
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def latest_with_fallback(series: dict[str, DataFrame], key: str, ts: str, value: str) -> DataFrame:
    """Latest value per key from the first listed source that has any, with the source's name."""
    out = None
    for rank, (name, df) in enumerate(series.items()):
        d = df.groupBy(key).agg(F.max_by(value, ts).alias("value"), F.max(ts).alias("as_of")).withColumn("source", F.lit(name)).withColumn("_rank", F.lit(rank))
        out = d if out is None else out.unionByName(d)
    pick = F.min_by(F.struct("value", "as_of", "source"), F.when(F.col("value").isNotNull(), F.col("_rank")))
    return out.groupBy(key).agg(pick.alias("_p")).select(key, "_p.*")


def recent(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The ``n`` newest rows per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def to_cells(long: DataFrame, ts: str = "ts") -> DataFrame:
    """Long snapshot rows (ts, symbol, price_bucket, side, active_volume) to one row per cell."""
    def side(s: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == s, F.col("active_volume"))), F.lit(0.0)).alias(f"{s}_density")

    return long.groupBy(ts, "symbol", "price_bucket").agg(side("long"), side("short"))


def to_long(cells: DataFrame, ts: str = "ts") -> DataFrame:
    """Cells back to long rows; empty sides are not stored."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_density").alias("active_volume")) for s in ("long", "short")])
    return cells.select(ts, "symbol", "price_bucket", F.explode(sides).alias("_s")).select(ts, "symbol", "price_bucket", "_s.*").filter("active_volume > 0")


def cache_coverage(cache: DataFrame, keys: list[str], start: Column, end: Column, now: Column, interval_seconds: int, max_age_seconds: int) -> DataFrame:
    """Whether cached snapshots cover [start, end] without leading, interior or trailing hole, and are fresh.

    ``cache`` has the keys, ts and computed_at; its length per key is bounded by the calendar.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    gap = C.seconds_between("ts", F.lag("ts").over(w))
    d = cache.filter(F.col("ts").between(start, end)).withColumn("_gap", gap)
    step = float(interval_seconds)
    return (
        d.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("rows"), (C.seconds_between(F.min("ts"), start) >= step).alias("leading_hole"),
            (C.seconds_between(end, F.max("ts")) >= step).alias("trailing_hole"), F.coalesce(F.max("_gap") > step, F.lit(False)).alias("interior_hole"),
            (F.max(C.seconds_between(now, "computed_at")) > max_age_seconds).alias("stale"),
        )
        .withColumn("usable", ~(F.col("leading_hole") | F.col("trailing_hole") | F.col("interior_hole") | F.col("stale")))
    )


def volume_profile(trades: DataFrame, width: float, min_gross: float) -> DataFrame:
    """Daily value and count of large trades per price bin."""
    return (
        trades.filter(F.col("gross_value") >= min_gross)
        .groupBy("symbol", F.date_trunc("day", "ts").alias("trade_date"), C.floor_bin("price", width).alias("price_bin"))
        .agg(F.sum("gross_value").alias("total_volume"), F.count(F.lit(1)).alias("trade_count"))
    )


def dataset_coverage(files: DataFrame, start: Column, end: Column) -> DataFrame:
    """Per dataset: days in the window with files, file count, newest file, days missing, and the latest
    day at or before the window start (its anchor)."""
    inside = F.col("day").between(start, end)
    return (
        files.groupBy("dataset")
        .agg(
            F.count_distinct(F.when(inside, F.col("day"))).alias("days_present"), F.count_if(inside).alias("file_count"),
            F.max(F.when(inside, F.col("day"))).alias("latest_day"), F.max(F.when(F.col("day") <= start, F.col("day"))).alias("anchor_day"),
        )
        .withColumn("days_missing", F.datediff(end, start) + 1 - F.col("days_present"))
    )


# Source kinds in order of preference and the status each gives.
SOURCE_STATUS = {"catalog": "catalog", "normalised": "historical_normalised", "raw": "historical_raw_unnormalised"}


def readiness(requirements: DataFrame, files: DataFrame, gap: tuple[str, str] | None = None) -> DataFrame:
    """Readiness per (symbol, day, channel) from required input classes and listed source files.

    requirements: symbol, day, channel, input_class; files: symbol, day, input_class, kind. The best kind
    per class counts. A missing class blocks; a class only present raw leaves the source unverified. Inside
    ``gap`` (closed day range) the order book counts as missing.
    """
    rank = C.case([(F.col("kind") == k, F.lit(i)) for i, k in enumerate(SOURCE_STATUS)])
    best = files.groupBy("symbol", "day", "input_class").agg(F.min(rank).alias("_rank"))
    d = requirements.join(best, ["symbol", "day", "input_class"], "left")
    if gap is not None:
        hole = (F.col("input_class") == "orderbook") & F.col("day").between(F.lit(gap[0]).cast("date"), F.lit(gap[1]).cast("date"))
        d = d.withColumn("_rank", F.when(~hole, F.col("_rank")))
    raw = list(SOURCE_STATUS).index("raw")
    return d.groupBy("symbol", "day", "channel").agg(
        F.count(F.lit(1)).alias("required"), F.count_if(F.col("_rank").isNull()).alias("missing"),
        F.when(F.bool_or(F.col("_rank").isNull()), "blocked_source_missing")
        .when(F.bool_or(F.col("_rank") == raw), "blocked_source_unverified")
        .otherwise("available")
        .alias("status"),
    )
