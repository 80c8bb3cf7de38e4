"""Ordered prefix scans that never put a whole key into one task.

A scan runs inside chunks of the order axis; the state each chunk starts from comes from a
window over chunk summaries, which are small. A chunk with more rows than the threshold is cut
into as many parts as it holds thresholds, at order tuples taken from a sample by hash, so rows
that tie in the first column part too. Cuts only move rows between tasks: results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A chunk above this many rows is split into parts of about as many.
HOT_ROWS = 2_000_000
SAMPLES_PER_PART = 64
CUTS_PER_BLOCK = 256


def _cuts(d: DataFrame, keys: list[str], order: list[str], hot_rows: int) -> DataFrame:
    """(keys, _chunk, _blocks) of the hot chunks: cut tuples in order, in blocks, for a search in two steps."""
    every = max(1, hot_rows // SAMPLES_PER_PART)
    slot = [*keys, "_chunk"]
    hot = d.groupBy(*slot).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(*slot)
    picked = d.filter(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).select(*slot, F.struct(*order).alias("_stamp"))
    place = F.row_number().over(Window.partitionBy(*slot).orderBy("_stamp"))
    cuts = picked.join(hot, slot, "left_semi").withColumn("_i", place).filter(F.col("_i") % max(1, hot_rows // every) == 0)
    block = F.floor((F.col("_i") / max(1, hot_rows // every) - 1) / CUTS_PER_BLOCK)
    blocks = cuts.groupBy(*slot, block.alias("_block")).agg(F.array_sort(F.collect_list("_stamp")).alias("_cuts"))
    return blocks.groupBy(*slot).agg(F.array_sort(F.collect_list(F.struct("_block", "_cuts"))).alias("_blocks"))


def with_chunks(df: DataFrame, keys: list[str], order: list[str], chunk: Column, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add ``_chunk`` and ``_part``: a coarse slice of the order axis and its cut when hot.

    The cuts of hot chunks come by an ordinary join, whose form adaptive execution chooses by their size, and rows are
    then dealt by chunk and part. ``hot_rows=None`` skips this, for inputs bounded by a grid or a calendar.
    """
    d = df.withColumn("_chunk", chunk)
    if hot_rows is None:
        return d.withColumn("_part", F.lit(0).cast("long"))
    cut = d.join(_cuts(d, keys, order, hot_rows), [*keys, "_chunk"], "left")
    stamp = F.struct(*order)
    whole = F.size(F.filter("_blocks", lambda b: b["_cuts"][0] < stamp))
    below = F.size(F.filter(F.get("_blocks", whole - 1)["_cuts"], lambda c: c < stamp))
    part = F.when(F.col("_blocks").isNull() | (whole == 0), 0).otherwise((whole - 1) * CUTS_PER_BLOCK + below)
    return cut.withColumn("_part", part.cast("long")).drop("_blocks").repartition(*keys, "_chunk", "_part")


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    reverse: bool = False,
    hot_rows: int | None = HOT_ROWS,
    **outputs: tuple[str, str],
) -> DataFrame:
    """Add one column per output ``name=(kind, column)``.

    Kinds: ``sum``, ``max``, ``min`` over all rows up to and including this one, ``last`` (latest
    non-null value so far) and ``previous`` (value of the row before). ``order`` must be total when
    ties matter; ``chunk`` must rise with ``order[0]``. ``reverse`` scans from the end.
    """
    d = with_chunks(df, keys, order, chunk, hot_rows)
    slot = [*keys, "_chunk", "_part"]
    stamp = F.struct(*order)
    newest = F.min_by if reverse else F.max_by
    along = [F.desc(c) if reverse else F.asc(c) for c in order]
    slots_along = [F.desc(c) if reverse else F.asc(c) for c in ("_chunk", "_part")]

    summaries, carries, results = [], [], []
    before = Window.partitionBy(*keys).orderBy(*slots_along).rowsBetween(Window.unboundedPreceding, -1)
    step = Window.partitionBy(*keys).orderBy(*slots_along)
    inside = Window.partitionBy(*slot).orderBy(*along)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    for name, (kind, column) in outputs.items():
        s, c = f"_s_{name}", f"_c_{name}"
        value, carry = F.col(column), F.col(c)
        if kind == "sum":
            summaries.append(F.sum(value).alias(s))
            carries.append(F.sum(s).over(before).alias(c))
            inner = F.sum(value).over(upto)
            results.append(F.when(carry.isNull(), inner).otherwise(carry + F.coalesce(inner, F.lit(0))).alias(name))
        elif kind in ("max", "min"):
            agg, pick = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
            summaries.append(agg(value).alias(s))
            carries.append(agg(s).over(before).alias(c))
            results.append(pick(carry, agg(value).over(upto)).alias(name))
        elif kind == "last":
            summaries.append(newest(value, F.when(value.isNotNull(), stamp)).alias(s))
            carries.append(F.last(s, ignorenulls=True).over(before).alias(c))
            results.append(F.coalesce(F.last(value, ignorenulls=True).over(upto), carry).alias(name))
        elif kind == "previous":
            summaries.append(newest(value, stamp).alias(s))
            carries.append(F.lag(s).over(step).alias(c))
            first = F.row_number().over(inside) == 1
            results.append(F.when(first, carry).otherwise(F.lag(value).over(inside)).alias(name))
        else:
            raise ValueError(f"unknown scan kind {kind}")
    starts = d.groupBy(*slot).agg(*summaries).select(*slot, *carries)
    return d.join(starts, slot).select(*df.columns, *results)


def time_chunk(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000))


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_on: str,
    right_on: str,
    values: list[str],
    chunk,
    forward: bool = False,
    strict: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Attach ``values`` of the latest right row at or before each left row (or first at/after).

    ``chunk`` maps the shared axis column to a slice. One union and one scan, no pair explosion.
    ``strict`` excludes equal positions. Right rows must be unique per (keys, right_on).
    """
    # Side order at equal positions decides whether an equal right row is seen.
    right_first = forward == strict
    l = left.select(
        F.col(left_on).alias("_at"),
        F.lit(1 if right_first else 0).alias("_side"),
        *[F.col(k) for k in keys],
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
        F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_hit"),
    )
    r = right.select(
        F.col(right_on).alias("_at"),
        F.lit(0 if right_first else 1).alias("_side"),
        *[F.col(k) for k in keys],
        F.lit(None).cast(l.schema["_left"].dataType).alias("_left"),
        F.struct(*values).alias("_hit"),
    )
    both = l.unionByName(r)
    seen = scan(both, keys, ["_at", "_side"], chunk("_at"), reverse=forward, hot_rows=hot_rows, _found=("last", "_hit"))
    return seen.filter("_left IS NOT NULL").select("_left.*", *[F.col(f"_found.{v}").alias(v) for v in values])
