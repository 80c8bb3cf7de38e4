"""Nested block and account-snapshot JSON to flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forcemap.operators.joins import attach

FILL_FIELDS = (
    "struct<coin:string,px:string,sz:string,side:string,dir:string,time:bigint,tid:bigint,closedPnl:string,"
    "startPosition:string,crossed:boolean,fee:string,hash:string,oid:bigint>"
)

BLOCK = "struct<block_time:string,block_number:bigint,events:array<string>>"


def fills_from_blocks(lines: DataFrame, column: str = "value", coins: list[str] | None = None) -> DataFrame:
    """One row per complete fill of JSON block lines; each event is ``[wallet, fill]``.

    Events that are not pairs, lack a required field or hold a number that does not parse are
    dropped. Absent closed result, start position and fee count as zero. Extra columns are kept.
    """
    rest = [c for c in lines.columns if c != column]
    block = F.from_json(F.col(column), BLOCK)
    events = lines.select(*rest, block.alias("_b")).select(*rest, "_b.block_time", "_b.block_number", F.explode("_b.events").alias("_e"))
    pair = F.from_json("_e", "array<string>")
    fill = F.from_json(F.col("_p")[1], FILL_FIELDS)
    f = (
        events.select("*", pair.alias("_p"))
        .filter(F.size("_p") >= 2)
        .select(*rest, "block_time", "block_number", F.col("_p")[0].alias("wallet"), fill.alias("_f"))
        .filter(
            F.col("_f.coin").isNotNull() & F.col("_f.px").isNotNull() & F.col("_f.sz").isNotNull()
            & F.col("_f.side").isNotNull() & F.col("_f.dir").isNotNull() & F.col("_f.tid").isNotNull()
        )
    )
    if coins is not None:
        f = f.filter(F.col("_f.coin").isin(coins))

    def number(name: str, default: bool):
        raw = F.col(f"_f.{name}")
        parsed = raw.try_cast("double")
        return F.when(raw.isNull(), F.lit(0.0)).otherwise(parsed) if default else parsed

    return (
        f.select(
            *rest, "block_time", "block_number", F.col("_f.time").alias("event_time_ms"), F.col("_f.coin").alias("coin"),
            number("px", False).alias("price"), number("sz", False).alias("size"), F.col("_f.side").alias("side"),
            F.col("_f.dir").alias("direction"), number("closedPnl", True).alias("closed_pnl"),
            number("startPosition", True).alias("start_position"), F.col("_f.crossed").alias("crossed"),
            number("fee", True).alias("fee"), "wallet", F.col("_f.hash").alias("tx_hash"), F.col("_f.oid").alias("order_id"),
            F.col("_f.tid").alias("trade_id"),
        )
        .dropna(subset=["price", "size", "closed_pnl", "start_position", "fee"])
    )


def read_fill_blocks(spark, paths: list[str], coins: list[str] | None = None) -> DataFrame:
    """Fills from JSON-lines files (plain or compressed by a Hadoop codec), with the source file."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source_file"))
    return fills_from_blocks(lines, "value", coins)


def realised_closes(fills: DataFrame) -> DataFrame:
    """Fills that look like forced closes: closing direction, loss, crossed the book."""
    return fills.filter(F.col("direction").isin("Close Long", "Close Short") & (F.col("closed_pnl") < 0) & F.col("crossed"))


ACCOUNT = "struct<user:string,u:bigint,p:array<struct<a:int,s:bigint,e:bigint,l:struct<t:string,v:double>>>>"


def flatten_accounts(snapshots: DataFrame, universe: DataFrame, column: str = "value") -> DataFrame:
    """One row per position of account-snapshot JSON.

    Sizes are integers scaled by the asset's decimals, money is in millionths; the entry price is cost
    over size. ``universe`` has (asset, coin, decimals, max_leverage) and gives the maintenance rate
    1 / (2 x max leverage). Cross positions carry the asset's greatest leverage, isolated ones their own.
    """
    flat = (
        snapshots.select(F.from_json(column, ACCOUNT).alias("_a"))
        .select(F.col("_a.user").alias("account"), (F.col("_a.u") / 1e6).alias("balance"), F.explode("_a.p").alias("_p"))
        .select("account", "balance", F.col("_p.a").alias("asset"), F.col("_p.s").alias("_s"), F.col("_p.e").alias("_e"), F.col("_p.l").alias("_l"))
    )
    size = F.col("_s") / F.pow(F.lit(10.0), F.col("decimals"))
    isolated = F.col("_l.t") == "isolated"
    return (
        attach(flat, universe, "asset")
        .filter(F.col("_s") != 0)
        .select(
            "account", "balance", "coin", size.alias("size"), (F.col("_e") / 1e6 / F.abs(size)).alias("entry_px"),
            F.when(isolated, "isolated").otherwise("cross").alias("margin_type"),
            F.when(isolated, F.col("_l.v")).otherwise(F.col("max_leverage")).alias("leverage"),
            (F.lit(1.0) / (F.lit(2.0) * F.col("max_leverage"))).alias("maintenance_rate"),
        )
    )
