"""Exact quantiles by counting, for groups of any size.

Values are counted first (map-side), then running counts over distinct values locate the wanted
ranks; no group is sorted or held in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forcemap.operators.scans import HOT_ROWS, scan
from forcemap.session import staged


def ranked_values(df: DataFrame, keys: list[str], value: str, width: float, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Distinct non-null values with ``start``/``stop``: the 0-based rank range they occupy, and ``n``."""
    # Written once: the running counts and the totals both read them.
    counts = staged(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count")), "counts")
    chunk = F.floor(F.col(value) / F.lit(width))
    running = scan(counts, keys, [value], chunk, hot_rows=hot_rows, stop=("sum", "_count"))
    totals = counts.groupBy(*keys).agg(F.sum("_count").alias("n"))
    return (
        running.join(totals, keys)
        .withColumn("start", F.col("stop") - F.col("_count"))
        .drop("_count")
    )


def _rank(method: str, n: Column, p: float, parts: int | None) -> tuple[Column, Column, Column]:
    """(lower rank, upper rank, weight or offset of the upper value), 0-based."""
    if method == "linear":
        pos = (n - 1) * F.lit(p)
        lo = F.floor(pos)
        return lo, F.ceil(pos), pos - lo
    if method == "index":
        at = F.least(F.floor(n * F.lit(p)), n - 1)
        return at, at, F.lit(0.0)
    if method == "exclusive":
        i = round(p * parts)
        j = F.least(F.greatest(F.floor((n + 1) * F.lit(i) / F.lit(parts)), F.lit(1)), n - 1)
        delta = (n + 1) * F.lit(i) - j * F.lit(parts)
        return j - 1, j, delta
    raise ValueError(f"unknown method {method}")


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    width: float,
    method: str = "linear",
    parts: int | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One column per named probability.

    Methods: ``linear`` (rank (n-1)p), ``exclusive`` (rank (n+1)p, ``parts`` equal groups),
    ``index`` (sorted[int(n p)]). ``width`` slices the value axis for the scan.
    """
    one = keys or ["_all"]
    d = df if keys else df.withColumn("_all", F.lit(0))
    ranked = ranked_values(d.select(*one, value), one, value, width, hot_rows)
    picks, outs = [], []
    for name, p in probs.items():
        lo, hi, w = _rank(method, F.col("n"), p, parts)

        def at(rank: Column) -> Column:
            return F.max(F.when((rank >= F.col("start")) & (rank < F.col("stop")), F.col(value)))

        picks += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}"), F.max(w).alias(f"_w_{name}")]
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        w = F.col(f"_w_{name}")
        if method == "exclusive":
            outs.append(((low * (parts - w) + high * w) / parts).alias(name))
        else:
            outs.append((low + (high - low) * w).alias(name))
    wide = ranked.groupBy(*one).agg(F.max("n").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), *picks)
    return wide.select(*keys, "n", "low", "high", *outs)
