"""Running streams to completion and sinks that survive replays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from forcemap.operators.tables import new_rows
from forcemap.session import fresh_path, staged


def run_to_table(stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available into a Parquet table and return it. Append-mode streams."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, label)
    checkpoint = checkpoint or fresh_path(spark, f"{label}-checkpoint")
    q = (
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_matches(stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Matches given as soon as they were seen: of a signal's matches the one with the earliest event counts."""
    given = run_to_table(stream, label, path, checkpoint)
    rest = [c for c in stream.columns if c != "signal_id"]
    return given.groupBy("signal_id").agg(F.min(F.struct("event_ts", "event_id", *[c for c in rest if c not in ("event_ts", "event_id")])).alias("_m")).select("signal_id", *[f"_m.{c}" for c in rest])


def batch_folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Numbers and folders of the batches that ``run_folded`` has written, in order."""
    if not path_exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return [(n, f"{path}/batch={n}") for n in sorted(int(x[6:]) for x in names if x.startswith("batch=") and x[6:].isdigit())]


def folded(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def run_folded(stream: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], schema: str, path: str, checkpoint: str) -> list[str]:
    """Every batch through ``fold(rows, before)``, where ``before`` is what the batch before it wrote; returns all batches' folders.

    State is a table, so a batch is one job over its rows and no key is handed to Python by itself. A batch writes a folder of
    its own number; a replayed one reads the folder before its own again and writes over what it left.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [f for n, f in batch_folders(spark, path) if n < batch_id]
        fold(batch, folded(spark, before[-1:], schema)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return [f for _, f in batch_folders(stream.sparkSession, path)]


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class KeyedTable:
    """A stored table with one row per key, laid out in folders that the key itself names.

    ``folder`` is a column of the keys' values only, by default the day of a time key, else one of ``SLOTS`` hash slots. So a
    key can only be stored in one folder, and a batch looks for its keys in the folders of its own rows; with a time key
    these don't grow with the table. A finished batch leaves a marker, and a batch that finds its marker does nothing. A batch that was
    stopped between its rows and its marker finds what it stored and adds the rest.
    """

    SLOTS = 256

    def __init__(self, path: str, schema: StructType, keys: list[str], tiebreak: list[str], folder: Column | None = None) -> None:
        self.path, self.schema, self.keys, self.tiebreak = path, schema, keys, tiebreak
        times = [k for k in keys if schema[k].dataType.typeName().startswith(("timestamp", "date"))]
        slot = F.date_format(times[0], "yyyy-MM-dd") if times else F.pmod(F.xxhash64(*keys), F.lit(self.SLOTS)).cast("string")
        self.folder = F.coalesce(slot if folder is None else folder.cast("string"), F.lit("none"))

    def rows(self, spark: SparkSession, folders: list[str] | None = None) -> DataFrame:
        """What is stored, or only what is stored in some folders: no other folder is listed or read."""
        known = [f"{self.path}/rows"] if folders is None else [f"{self.path}/rows/_folder={f}" for f in folders]
        found = [p for p in known if path_exists(spark, p)]
        return spark.read.schema(self.schema).parquet(*found) if found else spark.createDataFrame([], self.schema)

    def add(self, batch: DataFrame, batch_id: int) -> list[str]:
        """Store the keys of a batch that are new; the files that were read are returned."""
        spark, marker = batch.sparkSession, f"{self.path}/batches/{batch_id}"
        if path_exists(spark, marker):
            return []
        placed = staged(batch.withColumn("_folder", self.folder), "batch")
        # Days or slots of one batch.
        folders = [r["_folder"] for r in placed.select("_folder").distinct().collect()]
        stored = self.rows(spark, folders)
        read = stored.inputFiles()
        fresh = new_rows(stored, placed.drop("_folder"), self.keys, self.tiebreak)
        # One file per folder and batch, more where a folder's rows are many.
        fresh.withColumn("_folder", self.folder).hint("rebalance", "_folder").write.mode("append").partitionBy("_folder").parquet(f"{self.path}/rows")
        spark.createDataFrame([(batch_id,)], "batch long").write.mode("overwrite").parquet(marker)
        return read


def run_idempotent(stream: DataFrame, keys: list[str], tiebreak: list[str], label: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """At-least-once input into a table with one row per key: every batch adds only keys not yet stored."""
    spark = stream.sparkSession
    table = KeyedTable(path or fresh_path(spark, label), stream.schema, keys, tiebreak)
    q = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: table.add(batch, batch_id) and None)
        .option("checkpointLocation", checkpoint or fresh_path(spark, f"{label}-checkpoint")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return table.rows(spark)


# ---- alerts --------------------------------------------------------------


def _spaced(alerts: DataFrame, last: DataFrame, cutoffs: DataFrame, cooldown_seconds: int) -> DataFrame:
    """Alerts a zone would send each day, given every day's cap cut-off so far.

    Inside a day the cut-off is ignored (it cannot change what comes before it); only alerts up to it start
    a cooldown that reaches into later days. A zone's alerts are walked in time order by one task; zones are
    many and alerts pass a severity bound first.
    """
    gap = pd.Timedelta(seconds=cooldown_seconds)
    names = list(alerts.columns)

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts", "alert_id"])
        settled = group["last_ts"].iloc[0]
        keep, day, free = [], None, settled
        for ts, alert_id, d, cut_ts, cut_id in zip(group["ts"], group["alert_id"], group["day"], group["cut_ts"], group["cut_id"]):
            if d != day:
                day, free = d, settled
            ok = pd.isna(free) or ts - free >= gap
            keep.append(ok)
            if ok:
                free = ts
                if pd.isna(cut_ts) or (ts, alert_id) <= (cut_ts, cut_id):
                    settled = ts
        return group.loc[keep, [*names, "day"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alerts.schema.fields)
    dated = alerts.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return (
        dated.join(cutoffs, "day", "left").join(last, "zone", "left").groupBy("zone").applyInPandas(walk, f"{fields}, day string")
    )


def send_alerts(alerts: DataFrame, last: DataFrame, cooldown_seconds: int, daily_cap: int, used: DataFrame | None = None) -> DataFrame:
    """Alerts sent under a per-zone cooldown and a daily cap over all zones.

    Alerts: alert_id, zone, ts; last: zone, last_ts; used: day, n sent before (by earlier batches). An alert the cap
    suppresses starts no cooldown, so a day's cut-off can depend on the day before. All days are settled together and
    repeated until no cut-off moves; after k rounds the first k days are final, and mostly two or three rounds settle all.
    """
    alerts, last = staged(alerts, "alerts"), staged(last, "last")
    spark = alerts.sparkSession
    used = spark.createDataFrame([], "day string, n long") if used is None else staged(used, "used")
    # A day that is full already lets nothing pass: its cut-off lies before all alerts.
    full = used.filter(F.col("n") >= daily_cap).select("day", F.timestamp_seconds(F.lit(-9_000_000_000)).alias("cut_ts"), F.lit(-1).cast("long").alias("cut_id"))
    cutoffs = full
    in_day = Window.partitionBy("day").orderBy("ts", "alert_id")
    while True:
        passed = _spaced(alerts, last, cutoffs, cooldown_seconds).join(used, "day", "left")
        place = F.row_number().over(in_day) + F.coalesce("n", F.lit(0))
        sent = staged(passed.withColumn("_r", place).filter(F.col("_r") <= daily_cap), "sent")
        at_cap = sent.filter(F.col("_r") == daily_cap).select("day", F.col("ts").alias("cut_ts"), F.col("alert_id").cast("long").alias("cut_id")).union(full)
        if at_cap.exceptAll(cutoffs).isEmpty() and cutoffs.exceptAll(at_cap).isEmpty():
            return sent.select(*alerts.columns)
        cutoffs = staged(at_cap, "cutoffs")


def run_alerts(stream: DataFrame, cooldown_seconds: int, daily_cap: int, label: str = "alerts") -> DataFrame:
    """Alert stream through ``send_alerts``; the sent table, partitioned by day, is the state of the next batch.

    The cap counts what earlier batches sent on a day, so any split of the time-ordered stream into batches sends the same.
    A batch reads only the days that its cooldowns can reach back to.
    """
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark, label), fresh_path(spark, f"{label}-checkpoint")
    stored = StructType([*stream.schema.fields, StructField("day", StringType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
        reach = F.date_format(F.min("ts") - F.make_dt_interval(secs=F.lit(cooldown_seconds)), "yyyy-MM-dd")
        first_day = batch.agg(reach).first()[0]
        if first_day is None:
            return
        sent = _table(batch.sparkSession, path, stored).filter(F.col("day") >= first_day)
        last = sent.groupBy("zone").agg(F.max("ts").alias("last_ts"))
        used = sent.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
        fresh = batch.join(sent.select("day", "alert_id"), ["day", "alert_id"], "left_anti").select(*stream.columns)
        out = send_alerts(fresh, last, cooldown_seconds, daily_cap, used)
        out.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(path)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return _table(spark, path, stored).drop("day")


# ---- adaptive weights ----------------------------------------------------


def smoothed(total: np.ndarray, rate: np.ndarray, alpha: float, least: float, long: float, short: float) -> tuple[np.ndarray, np.ndarray]:
    """Long and short weight after each hour, for a whole series at once.

    With both weights adding up to one, an hour maps the long weight w to a + b w; a reset is b = 0. Maps of ever longer
    stretches are put together by doubling, so there is no step per hour.
    """
    n = len(total)
    reset = rate < least
    moves = ~reset & (total > 0)
    # Before the first move after a start or a reset the weights are the defaults, whatever these add up to.
    event = np.where(reset | moves, np.arange(n), -1)
    before = np.concatenate(([-1], np.maximum.accumulate(event)[:-1])) if n else event
    fresh = (before < 0) | reset[np.maximum(before, 0)]
    whole = 2 * alpha * rate + (1 - alpha) * np.where(fresh, long + short, 1.0)
    sound = whole > 0
    safe = np.where(sound, whole, 1.0)
    a = np.where(moves & sound, (alpha * rate + np.where(fresh, (1 - alpha) * long, 0.0)) / safe, np.where(reset | moves, long, 0.0))
    b = np.where(moves & sound, np.where(fresh, 0.0, (1 - alpha) / safe), np.where(reset | moves, 0.0, 1.0))
    k = 1
    while k < n:
        a, b = np.concatenate((a[:k], a[k:] + b[k:] * a[:-k])), np.concatenate((b[:k], b[k:] * b[:-k]))
        k *= 2
    up = a + b * long
    # Still the defaults: reset, undefined, or no move since.
    still = reset | (moves & ~sound) | (~moves & fresh)
    return up, np.where(still, short, 1.0 - up)


def weight_history(hourly: DataFrame, alpha: float, least: float, defaults: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Long and short weight per symbol and hour: moved toward the hit rate and normalised, reset below ``least``.

    ``hourly`` has symbol, hour, total, hit_rate; its length per symbol is bounded by the calendar.
    """
    long, short = defaults

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("hour")
        a, b = smoothed(group["total"].to_numpy(float), group["hit_rate"].to_numpy(float), alpha, least, long, short)
        return group.assign(long_weight=a, short_weight=b)[["symbol", "hour", "total", "hit_rate", "long_weight", "short_weight"]]

    return hourly.groupBy("symbol").applyInPandas(
        walk, "symbol string, hour timestamp, total long, hit_rate double, long_weight double, short_weight double"
    )
