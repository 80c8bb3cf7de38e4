"""URL filter: fixed host and path rules, and a character language-model ratio for what no rule decides.

Two variable-order Markov models, of accepted and of rejected URLs, predict each character of host and path from up to
``ORDER`` characters before it. Orders are blended by Witten-Bell weights: a context seen with few different successors
counts for more, an unseen one falls back to the shorter. The score is the difference of the log-likelihoods per
character; a threshold calibrated on labelled URLs that the models haven't seen turns it into a verdict.

Labelled URLs are a parameter. Without them, URLs with a word of ``SEEDS`` among the words of their host are rejected, all
others of the table accepted, and the seeds in made-up hosts join the rejected. (The rules say nothing about the kind of site:
learning from them would only learn their top-level domains and languages.) At most ``SAMPLE_URLS`` of each side, by the
order of a hash, enter the fit; contexts seen once are pruned beyond order two, so the models are of bounded size.

Defined results: a null URL, or one without ``://``, has empty host and path, and no rule fits it; it's judged by the
models like any other (an empty text scores zero and is allowed); without labels of both sides all that no rule
decides is allowed; ids may be null or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 5
SAMPLE_URLS = 20_000
LONGEST = 2_048
#: Fixed values: (verdict, host, path prefix).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Words in the hosts of gambling, drug, adult, spam and tracking sites.
SEEDS = (
    "adult ads adserver bet bets betting bonus casino cheap click clicks dating deals escort free gambling jackpot loans"
    " lottery pharma pills poker popup porn replica sex slots spam track tracker viagra win winner xxx"
).split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with host and path columns."""
    u = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr("substring(_u, instr(_u, '://') + 3)")).otherwise(F.lit(""))
    return (
        df.withColumn("_u", u)
        .withColumn("_rest", rest)
        .withColumn("host", F.translate(F.regexp_extract("_rest", "^[^/?#]*", 0), UPPER, LOWER))
        .withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(host) + 1)"), "^[^?#]*", 0))
        .drop("_u", "_rest")
    )


def rule_of(rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does.

    Longest is by host and path together; a rule fits its host and all subdomains.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def train_model(texts: list[str], order: int = ORDER) -> dict[str, tuple[dict[str, int], int]]:
    """context -> (successor counts, total); contexts of more than two characters that were seen once are pruned."""
    counts: dict[str, dict[str, int]] = {}
    for t in texts:
        padded = "\x02" * order + t + "\x03"
        for i in range(order, len(padded)):
            for k in range(order + 1):
                own = counts.setdefault(padded[i - k : i], {})
                own[padded[i]] = own.get(padded[i], 0) + 1
    return {c: (own, n) for c, own in counts.items() if (n := sum(own.values())) > 1 or len(c) <= 2}


def log_likelihood(text: str, model: dict, order: int = ORDER, alphabet: int = 256) -> float:
    """Sum of the natural logs of the blended probabilities of all characters and the end."""
    padded, total = "\x02" * order + text + "\x03", 0.0
    for i in range(order, len(padded)):
        p, c = 1.0 / alphabet, padded[i]
        for k in range(order + 1):
            own = model.get(padded[i - k : i])
            if own is None:
                break
            counts, n = own
            kinds = len(counts)
            p = (counts.get(c, 0) + kinds * p) / (n + kinds)
        total += math.log(p)
    return total


def ratio(text: str, accepted: dict, rejected: dict, order: int = ORDER) -> float:
    """Difference of log-likelihood per character; above zero the accepted model explains the text better."""
    if not text:
        return 0.0
    return (log_likelihood(text, accepted, order) - log_likelihood(text, rejected, order)) / (len(text) + 1)


def calibrate(scores: list[float], accepted: list[bool]) -> float:
    """The threshold with the best mean of the two sides' accuracies, between two scores."""
    pairs = sorted(zip(scores, accepted, strict=True))
    good, bad = max(1, sum(accepted)), max(1, len(accepted) - sum(accepted))
    best, at, kept, caught = -1.0, 0.0, sum(accepted) / good, 0.0
    for i, (score, ok) in enumerate(pairs):
        low = pairs[i - 1][0] if i else score - 1e-9
        if (not i or low < score) and kept + caught > best + 1e-12:
            best, at = kept + caught, (low + score) / 2
        kept, caught = kept - ok / good, caught + (not ok) / bad
    return at if kept + caught <= best else pairs[-1][0] + 1e-9


def seed_labels(rows: DataFrame, seeds: list[str] = SEEDS) -> DataFrame:
    """(text, accepted) of rows with host and path, by the seeds, and made-up rejected hosts from pairs of seeds."""
    words = F.split("host", "[.-]")
    known = rows.select(F.concat("host", "path").alias("text"), (~F.arrays_overlap(words, F.array(*[F.lit(w) for w in seeds]))).alias("accepted"))
    pairs = [(f"{a}-{b}.example.{end}/", False) for i, a in enumerate(seeds) for j, b in enumerate(seeds) if a != b and (i + j) % 4 == 0 for end in ("com", "net", "org")]
    return known.union(rows.sparkSession.createDataFrame(pairs, "text string, accepted boolean"))


def fit(labelled: DataFrame, most: int = SAMPLE_URLS, order: int = ORDER) -> dict | None:
    """Models and threshold from (text, accepted); every fifth text by hash is for the threshold only.

    At most ``most`` texts a side of at most ``LONGEST`` characters are learned from; texts of any length are judged whole.
    """
    rows = labelled.select(F.col("text").cast("string"), F.col("accepted").cast("boolean")).filter("text IS NOT NULL AND accepted IS NOT NULL AND text <> ''")
    rows = rows.filter(F.length("text") <= LONGEST)
    rows = rows.withColumn("h", F.xxhash64("text"))
    side = lambda ok: rows.filter(F.col("accepted") == ok).orderBy("h", "text").limit(most)
    sample = side(True).union(side(False)).collect()  # two bounded samples
    held, used = [r for r in sample if r["h"] % 5 == 0], [r for r in sample if r["h"] % 5]
    good, bad = [r["text"] for r in used if r["accepted"]], [r["text"] for r in used if not r["accepted"]]
    if not good or not bad:
        return None
    model = {"accepted": train_model(good, order), "rejected": train_model(bad, order), "order": order, "threshold": 0.0}
    if held:
        scores = [ratio(r["text"], model["accepted"], model["rejected"], order) for r in held]
        model["threshold"] = calibrate(scores, [r["accepted"] for r in held])
        model["held_out"] = list(zip(scores, [r["accepted"] for r in held], strict=True))
    return model


def scorer(model: dict):
    accepted, rejected, order = model["accepted"], model["rejected"], model["order"]

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([ratio(t or "", accepted, rejected, order) for t in batch], dtype="float64")

    return score


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides)."""
    rule, verdict = rule_of(rules)
    rows = split_url(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")))
    rows = rows.withColumn("rule", rule).withColumn("_verdict", verdict).withColumn("_text", F.concat("host", "path"))
    if labelled is None:
        labelled = seed_labels(rows)
    model = fit(labelled)
    if model is None:
        score = F.lit(None).cast("double")
        free = F.lit("allow")
    else:
        # Only URLs that no rule decides go to the models.
        score = F.when(F.col("rule").isNull(), scorer(model)(F.when(F.col("rule").isNull(), F.col("_text"))))
        free = F.when((F.col("_text") != "") & (F.col("score") < model["threshold"]), "block").otherwise("allow")
    rows = rows.withColumn("score", score)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_verdict", free).alias("verdict"), "score")
