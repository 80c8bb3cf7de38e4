"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Rows are dealt to ``runs`` runs; a run is a partition, sorted by digest, with one entry per digest it has met. In each round
groups of ``fan`` runs exchange: an entry goes to the run of its group that the next digit of its digest names, and what
arrives is merged in digest order, the best row of each digest staying. After as many rounds as a run's number has digits
every entry is in the run its digest names, one per digest. All runs work in every round, and a digest that a third of all
rows share is at most ``fan`` entries for a run in a round. The winner goes back by (digest, first run), which spreads a hot
digest over all runs.

A digest is SHA-256 together with the text's length and an independent 64-bit hash; only entries that agree in all three are
merged, at every level. Two different texts would have to agree in all of them; for a trillion texts the odds of SHA-256 alone
are below 1e-53.

Defined results: a null text is empty; a null id takes part and loses to any other id when the largest stays, wins
when the smallest stays; of repeated rows with one id exactly one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forcemap.llm.common import ids_and_texts, whole_row
from forcemap.session import shuffled, staged

DIGEST = ["_digest", "_length", "_check"]
ROWS_PER_RUN = 250_000


def run_count(rows: int, fan: int = 4, least: int = 64) -> int:
    """Smallest power of ``fan`` with at most ``ROWS_PER_RUN`` rows per run, and at least ``least``."""
    runs = 1
    while runs < least or runs * ROWS_PER_RUN < rows:
        runs *= fan
    return runs


def with_digest(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its digest columns and a row number; write the result before using the row number."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        "*",
        F.unhex(F.sha2(text, 256)).alias("_digest"),
        F.length(text).cast("long").alias("_length"),
        F.xxhash64(text).alias("_check"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _in_order(entries: DataFrame, runs: int) -> DataFrame:
    """Each run in one partition, sorted by digest."""
    return entries.repartition(runs, "_run").sortWithinPartitions("_run", *DIGEST)


def merge_runs(entries: DataFrame, keep: str, runs: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Entries (digest, run, row, id) merged in rounds: those of the first runs, and one per digest."""
    best = F.max if keep == "largest" else F.min
    first = _in_order(entries, runs).groupBy("_run", *DIGEST).agg(best(F.struct("_id", "_row")).alias("_best"), F.count(F.lit(1)).alias("_n"))
    level, weight = first, 1
    goal = F.pmod(F.xxhash64(*DIGEST), F.lit(runs)).cast("int")
    while weight < runs:
        # The last digit may have fewer values than ``fan``.
        values = min(fan, -(-runs // weight))
        digit = lambda run: F.floor(run / weight) % values  # noqa: B023, E731
        moved = F.col("_run") + ((digit(goal) - digit(F.col("_run"))) * weight).cast("int")
        met = level.withColumn("_run", moved.cast("int"))
        level = _in_order(met, runs).groupBy("_run", *DIGEST).agg(best("_best").alias("_best"), F.sum("_n").alias("_n"))
        weight *= fan
    return first, level.drop("_run")


def mark(rows: DataFrame, keep: str = "largest", fan: int = 4, runs: int | None = None) -> DataFrame:
    """``rows`` (written, from ``with_digest`` and with an ``_id``) with ``_keep_id``, ``_group_size`` and ``_kept``."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    runs = runs or run_count(rows.count(), fan)
    dealt = rows.withColumn("_run", F.pmod(F.xxhash64("_row"), F.lit(runs)).cast("int"))
    first, root = merge_runs(dealt.select(*DIGEST, "_run", "_row", "_id"), keep, runs, fan)
    winners = root.select(*DIGEST, F.col("_best").alias("_win"), F.col("_n").alias("_group_size"))
    down = first.select(*DIGEST, "_run").join(shuffled(winners), DIGEST)
    found = dealt.join(shuffled(down), [*DIGEST, "_run"])
    return found.select(*rows.columns, F.col("_win._id").alias("_keep_id"), "_group_size", (F.col("_row") == F.col("_win._row")).alias("_kept"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``df`` without the rows whose text is also that of a row that stays.

    Whole rows are written once with their digests; only digests go through the merge, and rows are picked by number.
    Columns of any name come back as they were.
    """
    packed = df.select(whole_row(df), F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("_id"))
    rows = staged(with_digest(packed, "_text").drop("_text"), "rows")
    kept = mark(rows.select(*DIGEST, "_row", "_id"), keep).filter("_kept").select("_row")
    return rows.join(shuffled(kept), "_row", "left_semi").select("_whole.*")


def duplicate_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per row of ``df``: its id, the id that stays, the size of its group, whether it stays, its digest."""
    digests = with_digest(ids_and_texts(df, id_col, text_col)).drop("text").withColumnRenamed("doc_id", "_id")
    marked = mark(staged(digests, "digests"), keep)
    return marked.select(
        F.col("_id").alias("doc_id"),
        F.col("_keep_id").alias("keep_id"),
        F.col("_group_size").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
