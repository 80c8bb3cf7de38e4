"""Packing, byte-level BPE and the pipeline against brute force."""

import base64
import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from forcemap.llm import bpe, packing, pii, quality
from tests.llm.shapes import awkward, empty
from tests.llm.test_exact_and_near import clashing
from tests.llm.test_nearcopies import slow_groups

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.TextCodec(bpe.load_ranks(RANKS))


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    odd = ["", " ", "  a", "a  b", "a \nb", "x y ", "日本 語 text", "it's I'll 'tis", "emoji 😀 x", "\x1c a \x1c", "<|endoftext|> a", "a\u00a0b \u2003 c", "ǅ ᾳ x"]
    odd += ["".join(rng.choice(" \n\tab'slé.,1²日😀\u00a0\u3000_") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    return odd + ["a" * 3000, "ab" * 2000, "é" * 1500, " " * 2000, "\n" * 900 + "x", "0123456789" * 300] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(1, 500))) for _ in range(200)]


def sample_texts():
    return [r[0] for r in duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]


def test_packing_tokens_equal_the_library(tokenizer):
    encode = packing.Encoder(JSON)
    for t in odd_texts() + sample_texts():
        assert encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def check_pieces(rows, texts, tokenizer):
    """Pieces cover each document once, sequences are gapless, digests hold; returns tokens and padded length."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    padded = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048
        padded += at if at & (at - 1) == 0 else 2048
    return sum(r["length"] for r in rows), padded


def test_pieces_of_all_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    tokens, padded = check_pieces(packing.pack(docs, JSON).collect(), texts, tokenizer)
    assert padded < 1.02 * tokens + 2048 * docs.rdd.getNumPartitions()


def test_small_blocks_and_awkward_rows(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_pieces(packing.pack(docs, JSON, block_tokens=10_000).collect(), texts, tokenizer)
    rows = packing.pack(awkward(spark), JSON).collect()
    lengths = Counter()
    for r in rows:
        lengths[r["doc_id"]] += r["length"]
    assert lengths[2] == 1 == lengths[3] and lengths[6] == 2 * lengths[1]
    assert packing.pack(empty(spark), JSON).count() == 0


def test_spelled_tokens_get_the_ids_of_the_plain_call(spark):
    plain = Tokenizer.from_file(JSON)
    texts = odd_texts()[:300] + ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x <|endoftext|", "<|endoftext|>  日本 é", "  <|endoftext|> \n"]
    encode = packing.Encoder(JSON, added_tokens=True)
    for t in texts:
        assert encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    rows = dict(enumerate(texts[-5:]))
    got = packing.pack(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), JSON).collect()
    check_pieces(got, rows, plain)
    assert next(r["doc_tokens"] for r in got if r["doc_id"] == 0) == 5  # 64, 220, 50256, 275 and the end


def test_least_squares_uses_the_histogram():
    rng = random.Random(8)
    lengths = [rng.randint(1, 2047) for _ in range(4000)]
    windows = packing.pack_block(lengths)
    used = Counter()
    for w in windows:
        assert sum(n for _, _, n in w) <= 2048
        for i, _, n in w:
            used[i] += n
    assert dict(used) == dict(enumerate(lengths))
    exact = sum(all(n == lengths[i] for i, _, n in w) and sum(n for _, _, n in w) == 2048 for w in windows)
    assert exact > 0.3 * len(windows)  # whole rests that fill a window
    assert sum(sum(n for _, _, n in w) < 2048 for w in windows) <= 1


def test_solver_finds_an_exact_solution():
    patterns = np.array([[0, 1, -1], [2, 2, -1], [0, 0, 2]])
    x = packing.solve_counts(patterns, np.array([11.0, 5.0, 9.0]), 3000)
    assert np.allclose(x, [5, 3, 3], atol=0.05)


def test_equal_lengths_are_cut_not_padded():
    windows = packing.pack_block([1500] * 1000)
    assert len(windows) == -(-1500 * 1000 // 2048)


def test_bpe_equals_the_library(codec, library):
    for t in odd_texts() + sample_texts()[:300]:
        want = library.encode_ordinary(t)
        parts = codec.parts(t)
        assert codec.encode(t) == want
        assert b"".join(p[1] for p in parts)[1:].decode() == ",".join(map(str, want))
        assert b"".join(p[2] for p in parts) == t.encode() == codec.codec.decode(want)


@pytest.mark.parametrize("leaf", [1, 2, 7])
def test_tree_of_any_leaf_size(library, leaf):
    rng = random.Random(leaf)
    c = bpe.Codec(bpe.load_ranks(RANKS), leaf=leaf)
    for _ in range(150):
        data = bytes(rng.choice(b"abetino rs\xc3\xa9") for _ in range(rng.randint(1, 300)))
        want = [library.decode_single_token_bytes(i) for i in library._encode_single_piece(data)]
        assert c.tree(data) == want == c._long(data)


def test_joining_is_associative(codec):
    c, rng = codec.codec, random.Random(5)
    for _ in range(200):
        a, b, d = (bytes(rng.choice(b"abetinors") for _ in range(rng.randint(0, 40))) for _ in range(3))
        x, y, z = (c.tree(s) if s else [] for s in (a, b, d))
        assert c.join(c.join(x, y), z) == c.join(x, c.join(y, z)) == (c.tree(a + b + d) if a + b + d else [])


def test_bounded_tables_change_nothing(library):
    small = bpe.TextCodec(bpe.load_ranks(RANKS), table=50)
    for t in sample_texts()[:40]:
        assert small.encode(t) == library.encode_ordinary(t)


def test_bpe_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, RANKS).collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"])
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(ids)
        assert own["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    rows = bpe.encode_decode(awkward(spark), RANKS).collect()
    assert len(rows) == 10 and {r["ids_sha256"] for r in rows if r["n_tokens"] == 0} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encode_decode(empty(spark), RANKS).count() == 0
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(docs, RANKS).collect()}
    assert all(ids[r["doc_id"]] == library.encode_ordinary(r["text"]) for r in docs.collect())


# Pipeline


def test_pipeline_equals_brute_force(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in quality.quality_report(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if scores[r["doc_id"]]}
    last = {}
    for d in sorted(texts):
        last[texts[d]] = d
    texts = {d: t for t, d in last.items()}
    near = slow_groups(texts)
    texts = {d: t for d, t in texts.items() if near[d] == d}
    model = pii.default_model()
    texts = {d: pii.masked(t, spans) for (d, t), (_, spans) in zip(texts.items(), pii.all_spans(list(texts.values()), model), strict=True)}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    check_pieces(rows, texts, tokenizer)


def test_stages_keep_columns_and_take_awkward_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    for docs in (clashing(spark), empty(spark)):
        before = {tuple(v for c, v in r.asDict().items() if c not in ("text", "n_chars")) for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, sf)
            assert kept.columns == docs.columns, name
            # Only the masking stage changes the text and its length; nothing else changes at all.
            assert {tuple(v for c, v in r.asDict().items() if c not in ("text", "n_chars")) for r in kept.collect()} <= before, name
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


def test_queries_are_registered():
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] == ["op1_pii", "op2_simhash", "op3_secrets", "op4_winnowing", "op5_exact_dedup", "op6_quality", "op7_urls", "op8_html", "op9_packing", "op10_bpe", "op11_importance", "op12_mixing", "op13_negatives"]
    assert "pipeline" in names


def test_exact_dedup_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = entry.queries()["op5_exact_dedup"](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.execute(entry.oracle_sql()["op5_exact_dedup"]).df().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want[got.columns])


def test_rest_doesnt_import_this_package():
    root = Path(entry.__file__).parent
    for f in (root / "forcemap").rglob("*.py"):
        if "llm" not in f.parts:
            assert "forcemap.llm" not in f.read_text(), f


def test_stages_leave_no_shuffle_files(spark):
    """Shuffle files of a written step go when it ends, so those of many steps don't add up on disk."""
    from forcemap.session import staged

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(1 for d in manager.localDirsString() for f in Path(d).rglob("shuffle_*") if f.is_file())
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(200)], "doc_id long, text string")
    before = files()
    # Grouping is by a shuffle; its result is written and its files aren't read again.
    kept = staged(corpus_pipeline.without_copies(spark, docs, ""), "kept")
    assert kept.count() == 7
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
