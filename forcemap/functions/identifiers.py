"""Deterministic record identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forcemap.functions.columns import col

# Fixed value: the public OID namespace of UUID version 5.
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = OID_NAMESPACE) -> Column:
    """RFC 4122 version 5 UUID of a text column."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def iso_utc(ts) -> Column:
    """ISO text with offset; microseconds appear only when present."""
    plain = F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(col(ts)) % 1_000_000
    fraction = F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(plain, fraction, F.lit("+00:00"))


def observation_id(expert, symbol, ts, price, side) -> Column:
    return uuid5(F.concat(col(expert), col(symbol), iso_utc(ts), col(price).cast("string"), col(side)))


def slice_id(expert, symbol, side, distance, confidence, regime=None) -> Column:
    parts = [col(expert), col(symbol), col(side), col(distance), col(confidence)]
    return F.concat_ws(":", *parts, F.lit("none") if regime is None else col(regime))
