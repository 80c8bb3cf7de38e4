"""Awkward small tables that every text operator has to take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Aber und the of que " * 6000 + "mail a.b@mail1.example.com or +1 (559) 555-3817 tail"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], SCHEMA)


def awkward(spark):
    """Nulls, empty, blank and very long texts, repeated rows, ties, and extra columns with names used inside."""
    rows = [(1, "one two three four five six"), (2, None), (3, ""), (None, "one two three four five six"), (4, LONG), (5, "  \n\t "), (6, "one two three four five six"), (6, "one two three four five six"), (None, None), (7, "x")]
    df = documents(spark, rows)
    for name in ("_row", "_run", "_digest", "fp", "u", "v", "chunk", "guest", "h", "kept", "score", "start", "length", "label", "quality"):
        df = df.selectExpr("*", f"'{name}' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
