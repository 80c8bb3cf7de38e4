"""Importance resampling against brute force and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from forcemap.llm import importance
from tests.llm.shapes import LONG, awkward, documents, empty

TARGET = "item_id long, text string"


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, target, runs, buckets, percent=10, least=20, seed="2024"):
    """(n_features, weight, score) of every row, and the ids of the drawn ones in order."""

    def features(text):
        w = plain_words(text)
        return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(w) - k + 1)), len(w)

    s, t = Counter(), Counter()
    found = [(i, *features(x)) for i, x in rows]
    for _, f, _ in found:
        s.update(f)
    for x in target:
        t.update(features(x)[0])
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.total() + buckets) / ((s[k] + 1) * (t.total() + buckets)))) for k in range(buckets)]
    out = []
    for i, f, n in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] * m for k, m in f.items())
        out.append((i, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    long = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = [r[0] for r in long[: percent * len(long) // 100]]
    return [r[:4] for r in out], drawn


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_equals_brute_force(spark, runs, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 64)  # Runs across the cuts of a text.
    texts = ["The cat sat, on the mat", "é ü the CAT 99 sat", "x", "", None, "cat sat " * 40, LONG[:3000], "a" * 300, "one two three four five " * 8]
    rows = [(i, texts[i % len(texts)]) for i in range(60)]
    target = ["the cat sat", "four five one two", None]
    got = importance.resample(documents(spark, rows), spark.createDataFrame(list(enumerate(target)), TARGET), runs=runs, buckets=97, percent=25, least_words=5).collect()
    want, drawn = plain(rows, target, runs, 97, 25, 5)
    assert order(tuple(r)[:4] for r in got) == order(want)
    assert [r["doc_id"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_head_and_tail_give_the_same_totals(spark, monkeypatch):
    rows = [(i, "the cat sat on the mat " * (i % 5) + f"w{i} w{i % 7}") for i in range(200)]
    target = spark.createDataFrame([(1, "the cat w3")], TARGET)
    results = []
    for least, held in ((1, 1 << 20), (16, 20), (10**9, 1 << 20)):
        # Workers import the module anew, so the bounds go in by closure: in one process here.
        monkeypatch.setattr(importance, "TASK_LEAST", least)
        monkeypatch.setattr(importance, "HELD", held)
        gathered = importance.gather(documents(spark, rows), target, "text", "text", 2, 50)
        results.append(importance.gains(gathered, 50))
    assert results[0] == results[1] == results[2]


def test_known_states_and_pairs_hash_like_plain_crc():
    counts = importance.run_counts(b"a b c a b", 3)[1]
    plain_hasher = importance.Hasher(1000)
    known = importance.Hasher(1000, {b"a": zlib.crc32(b"a")}, {(b"b", b"c"): zlib.crc32(b"b c") % 1000})
    want = Counter(zlib.crc32(b" ".join(x)) % 1000 for x in [(b"a",), (b"b",), (b"c",), (b"a",), (b"b",), (b"a", b"b"), (b"b", b"c"), (b"c", b"a"), (b"a", b"b"), (b"a", b"b", b"c"), (b"b", b"c", b"a"), (b"c", b"a", b"b")])
    for h in (plain_hasher, known):
        got = Counter()
        for bucket, n in h.totals(counts):
            got[bucket] += n
        assert got == want


def test_words_cover_pieces():
    text = ("Aé b9 " * 50 + "c" * 500 + " d").encode()
    old = importance.PIECE
    try:
        importance.PIECE = 7
        assert [w for some in importance.words(text) for w in some] == text.lower().split()
    finally:
        importance.PIECE = old


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    target = spark.createDataFrame([(1, "one two three")], TARGET)
    got = importance.resample(docs, target, percent=100, least_words=1).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, drawn = plain(rows, ["one two three"], 1, 10_000, 100, 1)
    assert order(tuple(r)[:4] for r in got) == order(want)
    assert [r["doc_id"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert importance.resample(empty(spark), target).count() == 0
    none = importance.resample(docs, target.limit(0), percent=100, least_words=1).collect()
    assert len(none) == len(rows) and sum(r["rank"] is not None for r in none) == len(drawn)


def test_a_third_of_equal_rows_is_ranked_over_several_ranges(spark, monkeypatch):
    rows = documents(spark, [(None if i % 3 else i, "same text of words") for i in range(900)])
    monkeypatch.setattr(importance, "RANGE_ROWS", 100)
    got = importance.resample(rows, spark.createDataFrame([], TARGET), percent=100, least_words=1)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 901))


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.execute(entry.oracle_sql()["op11_importance"])
    columns = [c[0] for c in want.description]
    got = entry.queries()["op11_importance"](spark, sf).select(*columns).collect()
    assert order(tuple(r) for r in got) == order(want.fetchall())
