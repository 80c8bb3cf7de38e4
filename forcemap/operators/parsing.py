"""Parsing of compact text parameters into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forcemap.functions.columns import col

# Leverage tiers a weight may name.
KNOWN_LEVERAGES = [5, 10, 25, 50, 100]


def leverage_weights(df: DataFrame, spec: str) -> DataFrame:
    """``"5:.2,10:.8"`` or a JSON object to one row per known leverage, weights summing to one."""
    text = F.trim(col(spec))
    as_json = F.from_json(text, "map<string,double>")
    pairs = F.filter(F.split(text, ","), lambda p: F.size(F.split(p, ":")) == 2)
    as_pairs = F.transform(
        pairs,
        lambda p: F.struct(
            F.trim(F.split(p, ":")[0]).try_cast("int").alias("leverage"),
            F.trim(F.split(p, ":")[1]).try_cast("double").alias("weight"),
        ),
    )
    from_map = F.transform(
        F.map_entries(as_json),
        lambda e: F.struct(e["key"].try_cast("int").alias("leverage"), e["value"].alias("weight")),
    )
    entries = F.when(text.startswith("{"), from_map).otherwise(as_pairs)
    valid = F.filter(entries, lambda e: e["leverage"].isin(KNOWN_LEVERAGES) & (e["weight"] > 0))
    total = F.aggregate(valid, F.lit(0.0), lambda acc, e: acc + e["weight"])
    return (
        df.withColumn("_valid", valid)
        .withColumn("_total", total)
        .select(*df.columns, "_total", F.explode("_valid").alias("_e"))
        .select(*df.columns, F.col("_e.leverage").alias("leverage"), (F.col("_e.weight") / F.col("_total")).alias("weight"))
    )
