"""Fixed-length row frames over series of any length.

Rows are numbered by a distributed running count and cut into blocks; the last rows of a block are
copied into the next one, so each frame is complete inside one block and no key fills one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from forcemap.operators.scans import HOT_ROWS, scan

BLOCK_ROWS = 65_536


def numbered(df: DataFrame, keys: list[str], order: list[str], chunk: Column, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add ``_i``: 1, 2, … per key in ``order`` (which must be total)."""
    return scan(df.withColumn("_one", F.lit(1)), keys, order, chunk, hot_rows=hot_rows, _i=("sum", "_one")).drop("_one")


def _placed(n: DataFrame, length: int, block_rows: int) -> DataFrame:
    """Numbered rows in blocks (``_block``), with the rows before a block that its frames reach back to; ``_home`` is a row's own."""
    block_rows = max(block_rows, 4 * length)
    home = F.floor((F.col("_i") - 1) / F.lit(block_rows))
    tail = (F.col("_i") - 1) % block_rows >= block_rows - (length - 1)
    return n.withColumn("_home", home).withColumn("_block", F.explode(F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))))


def rolling(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, length: int, outputs, hot_rows: int | None = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add columns over the last ``length`` rows.

    ``outputs`` maps a name to a function of the frame (a WindowSpec ending at the current row).
    ``_i`` stays in the result so callers can tell full frames from short ones.
    """
    placed = _placed(numbered(df, keys, order, chunk, hot_rows), length, block_rows)
    frame = Window.partitionBy(*keys, "_block").orderBy("_i").rowsBetween(-(length - 1), 0)
    named = [fn(frame).alias(name) for name, fn in outputs.items()]
    return placed.select("*", *named).filter(F.col("_home") == F.col("_block")).drop("_home", "_block")


def rolling_mean(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, length: int, column: str, name: str, hot_rows: int | None = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``name``: the mean of ``column`` over the last ``length`` rows, at a cost that ``length`` doesn't change.

    Rows are cut into stretches of ``length``, so a frame is the end of one stretch and the beginning of the next: the running
    sums of the stretches from either side add up to it, and no value outside the frame ever enters its sum.
    """
    placed = _placed(numbered(df, keys, order, chunk, hot_rows), length, block_rows).withColumn("_stretch", F.floor((F.col("_i") - 1) / F.lit(length)))
    stretch = Window.partitionBy(*keys, "_block", "_stretch")
    zero, parts = F.lit(0), ["_tail", "_tail_n", "_head", "_head_n"]
    for (total, n), along in ((parts[:2], F.desc("_i")), (parts[2:], F.asc("_i"))):
        upto = stretch.orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        placed = placed.withColumns({total: F.coalesce(F.sum(column).over(upto), zero), n: F.count(column).over(upto)})
    # The rows of the stretch before that the frame holds; a number may be missing where rows have no place in the order.
    row = F.struct("_i", "_tail", "_tail_n")
    along = Window.partitionBy(*keys, "_block").orderBy("_i").rangeBetween(1 - length, 0)
    before = F.first(row).over(along)
    placed = placed.withColumn("_before", F.when(F.floor((before["_i"] - 1) / F.lit(length)) < F.col("_stretch"), before))
    mean = F.try_divide(F.col("_head") + F.coalesce("_before._tail", zero), F.col("_head_n") + F.coalesce("_before._tail_n", zero))
    return placed.filter(F.col("_home") == F.col("_block")).withColumn(name, mean).drop("_home", "_block", "_stretch", "_before", *parts)


def mean_of(column: str):
    return lambda frame: F.avg(column).over(frame)


def weighted_mean_of(column: str, weights: list[float]):
    """``weights`` run from the oldest row of the frame to the newest."""

    def build(frame: WindowSpec) -> Column:
        values = F.collect_list(F.col(column)).over(frame)
        terms = F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: v * w)
        total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
        return F.when(F.size(values) == len(weights), total / F.lit(float(sum(weights))))

    return build


def moving_averages(df: DataFrame, keys: list[str], ts: str, value: str, length: int, chunk: Column) -> DataFrame:
    """Simple and linearly weighted means over the last ``length`` rows; full frames only."""
    ramp = [float(i + 1) for i in range(length)]
    out = rolling(
        df, keys, [ts], chunk, length, {"sma": mean_of(value), "wma": weighted_mean_of(value, ramp)}
    )
    return out.filter(F.col("_i") >= length).drop("_i")


def decayed_smoothing(df: DataFrame, keys: list[str], ts: str, columns: list[str], length: int, chunk: Column, half_decay: float = 0.5) -> DataFrame:
    """Mean over the last ``length`` rows with weights 2^(-half_decay·age), renormalised when short."""

    def build(column: str):
        def over(frame: WindowSpec) -> Column:
            newest_first = F.reverse(F.collect_list(F.col(column)).over(frame))
            pairs = F.transform(
                newest_first,
                lambda v, i: F.struct((v * F.pow(F.lit(2.0), -half_decay * i)).alias("x"), F.pow(F.lit(2.0), -half_decay * i).alias("w")),
            )
            sums = F.aggregate(
                pairs,
                F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("w")),
                lambda a, p: F.struct((a["x"] + p["x"]).alias("x"), (a["w"] + p["w"]).alias("w")),
            )
            return sums["x"] / sums["w"]

        return over

    return rolling(df, keys, [ts], chunk, length, {f"smoothed_{c}": build(c) for c in columns}, hot_rows=None).drop("_i")
