"""Secret scan in DataFrame functions only: three fixed kinds, and strings of high windowed entropy.

Positions come without a UDF: the gaps between matches (``split``) and the matches themselves (``regexp_extract_all``)
alternate, so running totals of their lengths are starts, in code points.

Entropy: candidates are runs of token characters. A window of ``WINDOW`` characters slides over each; symbol counts of the
candidate's character class are kept in an array and changed by one character in and one out, and the sum of
c * log2(c) with them. The highest window decides. Allow-listed shapes (plain words, plain numbers, UUIDs, rules of
one repeated character) are suppressed. Entropy spans that touch a span of the fixed kinds are left out.

Defined results: a null text is empty and has no span; ids may be null or repeat, each row stands for itself; spans
of one kind never overlap; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forcemap.llm.common import ids_and_texts, let, running_starts

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Class: (all characters, needed characters, alphabet, least entropy in bits of the best window).
CLASSES = {
    "hex": ("^[0-9a-fA-F]+$", "^(?=.*[0-9])(?=.*[a-fA-F])", "0123456789abcdefABCDEF", 2.9),
    "lower": ("^[0-9a-z]+$", "^(?=.*[0-9])(?=.*[a-z])", "0123456789abcdefghijklmnopqrstuvwxyz", 3.5),
    "token": ("^.+$", "^(?=.*[0-9])(?=.*[A-Za-z])", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3.7),
}
ALLOWED = [
    "^[A-Za-z_/+=-]+$",
    "^[0-9_/+=-]+$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(.)\1*$",
]


def _matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """Array of (start, end, value) of all leftmost matches; value is group ``group`` or the match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def placed(ms: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(ms))
        sizes = F.zip_with(gaps, ms, lambda g, m: F.struct(F.length(g).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("len")))

        def spans(zs: Column) -> Column:
            begins = running_starts(F.transform(zs, lambda z: z["gap"] + z["len"]))
            at = F.zip_with(begins, zs, lambda b, z: F.struct((b + z["gap"]).alias("start"), (b + z["gap"] + z["len"]).alias("end")))
            return F.zip_with(at, ms if group is None else value, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))

        return let(sizes, spans)

    return let(whole, lambda ms: F.when(F.size(ms) == 0, none).otherwise(placed(ms)))


def _spans(found: Column, kind: str, holds) -> Column:
    order = KINDS.index(kind)
    kept = F.filter(found, holds)
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end")))


def _xlogx(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def window_entropy(value: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits, of any ``window`` consecutive characters of ``value`` (at least as long)."""
    symbols = len(alphabet)

    def over(codes: Column) -> Column:
        zero = F.array_repeat(F.lit(0), symbols)
        state = F.struct(F.lit(0).alias("i"), zero.alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

        def step(a: Column, code: Column) -> Column:
            gone = F.when(a["i"] >= window, codes[a["i"] - window]).otherwise(F.lit(-1))
            moved = F.struct(gone.alias("out"), code.alias("in"))

            def change(m: Column) -> Column:
                same = m["out"] == m["in"]
                c_in = a["counts"][m["in"]]
                c_out = F.when(m["out"] >= 0, a["counts"][m["out"]]).otherwise(F.lit(0))
                grown = a["s"] + _xlogx(c_in + 1) - _xlogx(c_in)
                s = F.when(same, a["s"]).when(m["out"] >= 0, grown + _xlogx(c_out - 1) - _xlogx(c_out)).otherwise(grown)
                counts = F.when(same, a["counts"]).otherwise(
                    F.transform(a["counts"], lambda c, k: c + F.when(k == m["in"], 1).when(k == m["out"], -1).otherwise(0))
                )

                def after(t: Column) -> Column:
                    full = a["i"] + 1 >= window
                    bits = F.lit(window).cast("double")
                    best = F.when(full, F.greatest(a["best"], F.log2(bits) - t / bits)).otherwise(a["best"])
                    return F.struct((a["i"] + 1).alias("i"), counts.alias("counts"), t.alias("s"), best.alias("best"))

                return let(s, after)

            return let(moved, change)

        return F.aggregate(codes, state, step, lambda a: a["best"])

    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return let(codes, over)


def _secret_like(value: Column, allowed: list[str]) -> Column:
    suppressed = F.lit(False)
    for pattern in allowed:
        suppressed = suppressed | F.rlike(value, F.lit(pattern))
    verdict = F.lit(False)
    for all_of, some_of, alphabet, least in reversed(CLASSES.values()):
        own = F.rlike(value, F.lit(some_of)) & (window_entropy(value, alphabet) >= least)
        verdict = F.when(F.rlike(value, F.lit(all_of)), own).otherwise(verdict)
    return F.when(suppressed, F.lit(False)).otherwise(verdict)


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["order"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: list[str] | None = None) -> DataFrame:
    """doc_id, counts per fixed kind, digest of the fixed spans, and all spans as ``kind:start:end``, comma-joined."""
    allowed = ALLOWED if allowed is None else allowed
    rows = ids_and_texts(df, id_col, text_col)
    text = F.col("text")
    found = F.struct(
        _spans(_matches(text, ASSIGN, 2), "assign", lambda m: F.length(m["value"]) >= 12).alias("assign"),
        _spans(_matches(text, ACCESS), "access", lambda m: F.length(m["value"]) >= 18).alias("access"),
        _spans(_matches(text, HEX.replace("+", "{16,}")), "hex", lambda m: F.lit(True)).alias("hex"),
        _spans(_matches(text, CANDIDATE), "entropy", lambda m: _secret_like(m["value"], allowed)).alias("entropy"),
    )

    def result(f: Column) -> Column:
        fixed = F.array_sort(F.concat(f["assign"], f["access"], f["hex"]))

        def joined(b: Column) -> Column:
            free = F.filter(f["entropy"], lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))
            return F.struct(
                F.size(f["assign"]).cast("long").alias("n_assign"),
                F.size(f["access"]).cast("long").alias("n_access"),
                F.size(f["hex"]).cast("long").alias("n_hex"),
                F.sha2(_named(b), 256).alias("base_sha256"),
                _named(F.array_sort(F.concat(b, free))).alias("spans"),
            )

        return let(fixed, joined)

    # A generator is a barrier: the optimizer can't copy the scan into each of the columns taken from it.
    return rows.select("doc_id", F.inline(F.array(let(found, result))))
