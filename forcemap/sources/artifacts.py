"""Distribution artifacts and manifests as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTIFACT = (
    "expert_id string, symbol string, snapshot_ts string, reference_price double, "
    "bucket_grid struct<min_price:double,max_price:double,step:double>, "
    "long_distribution map<string,double>, short_distribution map<string,double>"
)
MANIFEST = "symbol string, snapshot_ts string, experts map<string,struct<availability_status:string,artifact_path:string>>"


def with_hash(artifacts: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 of the canonical JSON of ``columns`` (maps as key-sorted entries)."""
    types = dict(artifacts.dtypes)
    canon = [
        F.array_sort(F.map_entries(c)).alias(c) if types[c].startswith("map") else F.col(c) for c in columns
    ]
    return artifacts.withColumn("content_hash", F.sha2(F.to_json(F.struct(*canon)), 256))


def export(artifacts: DataFrame, path: str) -> None:
    """Artifacts as JSON lines under symbol and snapshot folders, one deterministic layout."""
    artifacts.write.mode("overwrite").partitionBy("symbol", "snapshot_day").json(path)


def export_manifests(entries: DataFrame, path: str) -> None:
    """One manifest a symbol and snapshot: status and artifact path of every expert.

    ``entries`` has symbol, snapshot_day, snapshot_ts, expert_id and availability_status; experts of a snapshot are few.
    """
    where = F.concat(F.lit("symbol="), "symbol", F.lit("/snapshot_day="), "snapshot_day")
    entry = F.struct("availability_status", F.when(F.col("availability_status") == "available", where).alias("artifact_path"))
    one = entries.groupBy("symbol", "snapshot_day", "snapshot_ts").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("expert_id", entry)))).alias("experts"))
    one.select("snapshot_day", "symbol", "snapshot_ts", "experts").write.mode("overwrite").partitionBy("snapshot_day").json(path)


def read_available(
    spark: SparkSession, manifests: str, artifacts: str, symbols: list[str] | None = None, experts: list[str] | None = None
) -> DataFrame:
    """Artifacts that a manifest lists as available, filtered by symbol and expert.

    Manifests and artifacts are both read as tables and met by a semi-join on (expert, symbol, time).
    """
    m = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(manifests)
    listed = (
        m.select("symbol", "snapshot_ts", F.explode("experts").alias("expert_id", "_e"))
        .filter(F.col("_e.availability_status") == "available")
        .select("symbol", "snapshot_ts", "expert_id")
    )
    if symbols:
        listed = listed.filter(F.col("symbol").isin(symbols))
    if experts:
        listed = listed.filter(F.col("expert_id").isin(experts))
    a = spark.read.schema(ARTIFACT).option("recursiveFileLookup", "true").json(artifacts)
    return a.join(listed, ["symbol", "snapshot_ts", "expert_id"], "left_semi")
