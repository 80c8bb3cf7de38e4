"""Registered queries of the text operators, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forcemap.llm import bpe, exact_dedup, htmltext, importance, lmscore, negatives, packing, pii, quality, secrets, simhash, urls, winnow
from forcemap.llm.common import bounded_batches, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _on(name: str, operator: Callable[..., DataFrame], **parameters) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(bounded_batches(spark), sf_dir, name), **parameters)


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": _on("documents", pii.find_personal_data),
    "op2_simhash": _on("documents", simhash.near_duplicate_report),
    "op3_secrets": _on("documents", secrets.scan_secrets),
    "op4_winnowing": _on("documents", winnow.fingerprints),
    "op5_exact_dedup": _on("documents", exact_dedup.duplicate_report),
    "op6_quality": _quality,
    "op7_urls": _on("pages", urls.judge),
    "op8_html": _on("pages", htmltext.extract),
    "op9_packing": lambda spark, sf_dir: packing.pack(table(bounded_batches(spark), sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")),
    "op10_bpe": lambda spark, sf_dir: bpe.encode_decode(table(bounded_batches(spark), sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken")),
    "op11_importance": lambda spark, sf_dir: importance.resample(table(bounded_batches(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op12_mixing": _on("documents", lmscore.language_scores),
    "op13_negatives": _on("embeddings", negatives.mine),
}


def _secrets_sql() -> str:
    """The scan in SQL: positions from the gaps between matches; entropy of every window by counting its characters."""
    kinds = [("assign", secrets.ASSIGN, 2, 12), ("access", secrets.ACCESS, 0, 18), ("hex", secrets.HEX.replace("+", "{16,}"), 0, 16), ("entropy", secrets.CANDIDATE, 0, 0)]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS ord, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, p, 0) AS whole, regexp_extract_all(t, p, {group}) AS val, string_split_regex(t, p) AS gaps"
        f" FROM (SELECT *, '{pattern.replace(chr(39), chr(39) * 2)}' AS p FROM d) WHERE regexp_matches(t, p)"
        for i, (kind, pattern, group, least) in enumerate(kinds)
    )
    bits = f"""list_max(list_transform(range(1, length(val) - {secrets.WINDOW - 2}), lambda i: list_sum(list_transform(list_distinct(string_split(val[i:i + {secrets.WINDOW - 1}], '')),
               lambda c: -len(list_filter(string_split(val[i:i + {secrets.WINDOW - 1}], ''), lambda x: x = c)) / {secrets.WINDOW}e0 * log2(len(list_filter(string_split(val[i:i + {secrets.WINDOW - 1}], ''), lambda x: x = c)) / {secrets.WINDOW}e0)))))"""
    uuid = secrets.ALLOWED[2]
    least = {k: v[3] for k, v in secrets.CLASSES.items()}
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        f AS ({found}),
        u AS (SELECT doc_id, ord, kind, least, unnest(list_transform(range(1, len(whole) + 1), lambda i: {{'i': i, 'val': val[i], 'n': length(whole[i]), 'gap': length(gaps[i])}})) AS x FROM f),
        s AS MATERIALIZED (SELECT doc_id, ord, kind, least, x.val AS val, x.n AS n, sum(x.gap + x.n) OVER (PARTITION BY doc_id, ord ORDER BY x.i) AS stop FROM u),
        b AS (SELECT doc_id, ord, kind, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM s WHERE ord < 3 AND length(val) >= least),
        e AS (SELECT doc_id, ord, kind, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM s
              WHERE ord = 3 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND NOT regexp_matches(val, '{uuid}')
                AND CASE WHEN regexp_matches(val, '^[0-9a-fA-F]+$') THEN {bits} >= {least["hex"]} WHEN regexp_matches(val, '^[0-9a-z]+$') THEN {bits} >= {least["lower"]} ELSE {bits} >= {least["token"]} END),
        a AS (SELECT * FROM b UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = e.doc_id AND b.start < e.stop AND e.start < b.stop)),
        g AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
                     string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM a GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (doc_id)"""


#: CRC-32 of the different words by the table of the reflected polynomial, over the bytes of their hexadecimal form.
_IMPORTANCE_SQL = """
    WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
    side AS (SELECT 0 AS target, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark),
    words AS MATERIALIZED (SELECT target, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM side),
    bytes AS (SELECT word, list_transform(range(0, length(hex(word)) // 2), lambda i: ('0x' || hex(word)[2 * i + 1:2 * i + 2])::BIGINT) AS b FROM (SELECT DISTINCT word FROM words)),
    hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM bytes, crc),
    found AS MATERIALIZED (SELECT target, doc_id, bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY ALL),
    totals AS (SELECT bucket, coalesce(sum(n) FILTER (target = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target = 1), 0)::DOUBLE AS t FROM found GROUP BY bucket),
    gains AS (SELECT bucket, floor(1000e0 * ln((t + 1) * ((SELECT sum(s) FROM totals) + 10000) / ((s + 1) * ((SELECT sum(t) FROM totals) + 10000))))::BIGINT AS gain FROM totals),
    weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM found JOIN gains USING (bucket) WHERE target = 0 GROUP BY doc_id),
    scored AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                      (coalesce(weight, 0) + floor(-1000e0 * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT + 0.5e0) / 4294967296e0))))::BIGINT AS score FROM documents d LEFT JOIN weights USING (doc_id)),
    placed AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS place FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM placed"""


#: Every anchor with every row; the registered query searches trees instead.
_NEGATIVES_SQL = """
    WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256e0 * x::DOUBLE)) AS v
          FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same, list_inner_product(a.v, o.v)::BIGINT AS score FROM r a JOIN r o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
    SELECT anchor_id, p.other AS positive_id, row_number() OVER w::INTEGER AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
    WINDOW w AS (PARTITION BY anchor_id, p.other ORDER BY s.score DESC, s.other) QUALIFY row_number() OVER w <= 3"""


ORACLES: dict[str, str] = {
    "op13_negatives": _NEGATIVES_SQL,
    "op11_importance": _IMPORTANCE_SQL,
    "op3_secrets": _secrets_sql(),
    "op5_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
