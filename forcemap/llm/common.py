"""Input shapes and small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bound the bytes Spark hands to a Python worker at once, for tables with very long texts.

    Only the registered queries and the pipeline call this; a caller's own value is kept.
    """
    if int(spark.conf.get(BATCH_BYTES, str(2**31 - 1)) or 0) >= 2**31 - 1:
        spark.conf.set(BATCH_BYTES, str(32 << 20))
    return spark


def ids_and_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so extra columns never clash; a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as the one column ``_whole``, so an operator's own names clash with none; ``_whole.*`` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("_whole")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` mentions it."""
    return F.transform(F.array(value), body)[0]


def running_starts(lengths: Column, block: int = 256) -> Column:
    """Exclusive running totals of an array of longs.

    Appends within blocks and over block sums, so an array of n costs about n * block, not n * n.
    """

    def appended(xs: Column, first: Column) -> Column:
        empty = F.array().cast("array<bigint>")
        state = F.struct(first.cast("bigint").alias("at"), empty.alias("out"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
        return F.aggregate(xs, state, step, lambda s: s["out"])

    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def over(xs: Column) -> Column:
        n = F.ceil(F.size(xs) / F.lit(block)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(xs, b * block + 1, F.lit(block)))
        return let(blocks, lambda bs: let(appended(F.transform(bs, total), F.lit(0)), lambda firsts: F.flatten(F.zip_with(bs, firsts, appended))))

    return let(lengths, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<bigint>")).otherwise(over(xs)))
