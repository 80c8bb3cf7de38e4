"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has two segments of 32 bits. Two fingerprints that differ in at most two bits differ in at most one
bit of the first segment, or not at all in the second. So each fingerprint looks up the Hamming ball of radius one
around its first segment (33 keys) and its second segment itself, and every candidate is verified on all 64 bits.

Work is on distinct fingerprints: copies collapse before anything is joined, and one fingerprint has at most 2,080
others within two bits, so links stay in proportion to fingerprints. A bucket with more than ``HOT_BUCKET``
fingerprints isn't compared pair by pair: whoever meets it looks up every completion of the other segment within the
bits left, as whole fingerprints. Both ways find the same links; none is dropped.

Defined results: a null or blank text has fingerprint zero and is linked like any other; a null id takes part, the
component id is the smallest id that isn't null; repeated rows are rows like others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from forcemap.llm.common import whole_row
from forcemap.llm.components import components
from forcemap.session import shuffled, staged

DISTANCE = 2
HOT_BUCKET = 512
SEGMENT_BITS = 32


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    import numpy as np
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(ends + 1) - 1
    k = min(words, len(found))
    starts = np.concatenate(([0], ends[: len(found) - k] + 1))
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    stops = ends[k - 1 :]
    for at in range(0, n, 1 << 16):
        some = zip(starts[at : at + (1 << 16)].tolist(), stops[at : at + (1 << 16)].tolist(), strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in some], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import numpy as np

    for batch in texts:
        yield pd.Series(np.array([simhash(t) for t in batch], np.uint64).view(np.int64))


def _masks(bits: int, radius: int) -> Column:
    """Array of (mask, e): all masks with at most ``radius`` of the low ``bits`` bits set, e how many; radius up to two."""
    inner = f"sequence({'0' if radius > 1 else 'i'}, i)"
    some = f"transform({inner}, j -> named_struct('mask', shiftleft(1L, i) | shiftleft(1L, j), 'e', if(i = j, 1, 2)))"
    return F.expr(f"concat(array(named_struct('mask', 0L, 'e', 0)), flatten(transform(sequence(0, {bits - 1}), i -> {some})))")


def links(prints: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """Pairs (u, v), u < v, of the distinct fingerprints ``prints`` (fp) that differ in one or two bits."""
    low = F.lit((1 << SEGMENT_BITS) - 1).cast("long")
    first, second = F.shiftrightunsigned("fp", SEGMENT_BITS), F.col("fp").bitwiseAND(low)
    shelf = prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), first.alias("key")), F.struct(F.lit(1).alias("seg"), second.alias("key")))).alias("s")).select("fp", "s.*")
    near = prints.select("fp", F.explode(_masks(SEGMENT_BITS, 1)).alias("b")).select("fp", F.lit(0).alias("seg"), first.bitwiseXOR(F.col("b.mask")).alias("key"), F.col("b.e").alias("e"))
    same = prints.select("fp", F.lit(1).alias("seg"), second.alias("key"), F.lit(0).alias("e"))
    sizes = shelf.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n"))
    # A fingerprint alone in its own bucket meets nobody there.
    hits = staged(near.union(same).join(shuffled(sizes), ["seg", "key"]).filter("e > 0 OR n > 1"), "hits")

    cold = hits.filter(F.col("n") <= hot).join(shuffled(shelf.select("seg", "key", F.col("fp").alias("other"))), ["seg", "key"]).select("fp", "other")

    def completed(seg: int, e: int) -> DataFrame:
        some = hits.filter((F.col("n") > hot) & (F.col("seg") == seg) & (F.col("e") == e)).select("fp", "key", F.explode(_masks(SEGMENT_BITS, DISTANCE - e)).alias("b"))
        if seg == 0:
            other = F.shiftleft("key", SEGMENT_BITS).bitwiseOR(second.bitwiseXOR(F.col("b.mask")))
        else:
            other = F.shiftleft(first.bitwiseXOR(F.col("b.mask")), SEGMENT_BITS).bitwiseOR(F.col("key"))
        return some.select("fp", other.alias("other")).filter("fp < other")

    wanted = completed(0, 0).union(completed(0, 1)).union(completed(1, 0))
    exact = wanted.join(shuffled(prints.select(F.col("fp").alias("other"))), "other").select("fp", "other")
    close = (F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE)
    return cold.union(exact).filter(close).select(F.col("fp").alias("u"), F.col("other").alias("v")).distinct()


def group(rows: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """(fp, component_id, keep_row) for every fingerprint of the written table ``rows`` (_row, doc_id, fp)."""
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "_row")).alias("first")), "prints")
    roots = components(links(prints.select("fp"), hot))
    labelled = prints.join(shuffled(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tops = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("_first"))
    return labelled.select("fp", "root").join(shuffled(tops), "root").select("fp", "component_id", F.col("_first._row").alias("keep_row"))


def row_links(rows: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """Pairs (u, v) of rows of the written table ``rows`` (_row, fp), whose components are those of ``group``.

    A row is linked to the first one of its fingerprint, and the first ones of linked fingerprints to each other.
    """
    prints = staged(rows.groupBy("fp").agg(F.min("_row").alias("first")), "prints")
    same = rows.join(shuffled(prints), "fp").select(F.col("_row").alias("u"), F.col("first").alias("v")).filter("u <> v")
    one, other = (prints.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}")) for c in ("u", "v"))
    return same.union(links(prints.select("fp"), hot).join(shuffled(one), "u").join(shuffled(other), "v").select("_u", "_v"))


def near_duplicate_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per row of ``df``."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col).cast("string")).alias("fp"))
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    found = rows.join(shuffled(group(rows).select("fp", "component_id")), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row per component: that of the smallest id (of the first row, where ids repeat)."""
    packed = df.select(whole_row(df), F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col).cast("string")).alias("fp"))
    rows = staged(packed.withColumn("_row", F.monotonically_increasing_id()), "rows")
    kept = group(rows.select("_row", "doc_id", "fp")).select(F.col("keep_row").alias("_row")).distinct()
    return rows.join(shuffled(kept), "_row", "left_semi").select("_whole.*")
