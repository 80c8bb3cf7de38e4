"""The time-evolving heatmap fed by a stream of candles, with its price cells.

What a batch leaves behind is a table of open levels, one row a level, in folders by batch and price range; no row and no
state key holds the levels of a symbol. The next batch carries them on by the rule of the whole series (``heatmap.resume``),
so any split of the candles gives the cells of one run. A symbol's levels are written anew only by batches that have candles
of it. Everything a batch writes is in folders of its own number and counts once its marker is there: a replay of a finished
batch does nothing, and one that was stopped is written over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forcemap.operators import heatmap
from forcemap.session import fresh_path, staged
from forcemap.streaming.sinks import path_exists

LEVELS = "symbol string, side string, liq double, volume double"
VERSIONS = "symbol string, last_time timestamp, batch long"
CELLS = "symbol string, price_bucket double, long_density double, short_density double, open_time timestamp"
RANGE = 0.1  # Log-price width of a folder of levels.


class LiveHeatmap:
    """Candles: symbol, open_time, open, high, low, close, oi_delta; per symbol in time order between batches.

    A candle at or before the last one seen of its symbol is left out.
    """

    def __init__(self, path: str, width: float, shares: dict[int, float] | None = None) -> None:
        self.path, self.width, self.shares = path, width, shares

    def _read(self, spark: SparkSession, kind: str, schema: str, batches: list[int] | None = None) -> DataFrame:
        done = self.finished(spark) if batches is None else batches
        found = [p for p in (f"{self.path}/{kind}/batch={b}" for b in done) if path_exists(spark, p)]
        return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)

    def finished(self, spark: SparkSession) -> list[int]:
        """Numbers of the finished batches."""
        root = f"{self.path}/finished"
        if not path_exists(spark, root):
            return []
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        listed = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
        return sorted(int(f.getPath().getName()) for f in listed if f.getPath().getName().isdigit())

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cells so far: symbol, open_time, price_bucket, long_density, short_density."""
        return self._read(spark, "cells", CELLS)

    def open_levels(self, spark: SparkSession) -> DataFrame:
        """(symbol, side, liq, volume) after the last candle of each symbol, of the batch that wrote it last."""
        latest = self._latest(spark)
        # As many folders as batches that some symbol was last seen in.
        batches = [r["batch"] for r in latest.select("batch").distinct().collect()]
        of = self._read(spark, "levels", f"{LEVELS}, batch long", batches)
        return of.join(latest.select("symbol", "batch"), ["symbol", "batch"]).drop("batch")

    def _latest(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "versions", VERSIONS).groupBy("symbol").agg(F.max("batch").alias("batch"), F.max_by("last_time", "batch").alias("last_time"))

    def add(self, candles: DataFrame, batch_id: int) -> None:
        spark, marker = candles.sparkSession, f"{self.path}/finished/{batch_id}"
        if path_exists(spark, marker):
            return
        rows, until = staged(candles, "candles"), self._latest(spark).select("symbol", "last_time")
        seen = rows.select("symbol").distinct()
        carried = self.open_levels(spark).join(seen, "symbol", "left_semi")
        cells, levels = heatmap.resume(rows, until, carried, self.width, self.shares)

        def write(df: DataFrame, kind: str, *by: str) -> None:
            df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{kind}/batch={batch_id}")

        write(cells.select(*[c.split()[0] for c in CELLS.split(", ")]), "cells")
        write(levels.withColumn("batch", F.lit(batch_id).cast("long")).withColumn("price_range", F.floor(F.log("liq") / RANGE)), "levels", "price_range")
        versions = rows.groupBy("symbol").agg(F.max("open_time").alias("last_time")).join(until.withColumnRenamed("last_time", "_before"), "symbol", "left")
        write(versions.select("symbol", F.greatest("last_time", "_before").alias("last_time"), F.lit(batch_id).cast("long").alias("batch")), "versions")
        spark.createDataFrame([(batch_id,)], "batch long").write.mode("overwrite").parquet(marker)


def run_heatmap(stream: DataFrame, width: float, shares: dict[int, float] | None = None, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all available candles; returns the cells so far."""
    spark = stream.sparkSession
    live = LiveHeatmap(path or fresh_path(spark, "heatmap"), width, shares)
    q = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: live.add(batch, batch_id))
        .option("checkpointLocation", checkpoint or fresh_path(spark, "heatmap-checkpoint")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return live.cells(spark)
