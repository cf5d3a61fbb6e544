"""Each operator over its whole table, with production parameters, and SQL for the results that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import encode_texts
from .common import table
from .html_text import extract_text
from .license_scan import scan_licenses
from .ngram_join import ngram_jaccard_classes
from .packing import pack_documents
from .quality_model import quality_classes
from .quality_rules import MEASURES, PRIOR, QUANTILES, SPREAD, Z, quality_rules
from .syncmers import fingerprint_pairs
from .url_rules import judge_urls
from .warc_zstd import archive_round_trip

BYTE_BPE, WORD_BPE = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_classes(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, with_ids=False)


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id", "source", "lang"])


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ngram_jaccard, op2_license_scan, op3_quality_rules, op4_warc_dictionary, op5_byte_bpe, op6_vector_packing, op7_quality_classifier, op8_html_extraction, op9_syncmer_fingerprints, op10_url_rules]
    return {f.__name__: f for f in found}


def _quality_rules_sql() -> str:
    less = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"  # noqa: E731
    counts = {
        "_n_lines": "len(ls)",
        "_n_stutter": "len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))",
        "_n_capitals": less("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "_n_marks": less("!?;:_=+/" + chr(92) + "~^@{}[]"),
        "n_words": "len(w)",
        "word_chars": "len(array_to_string(w, ''))",
        "n_symbols": less("#*$%&|<>"),
        "n_dup_lines": "len(ls) - len(list_distinct(ls))",
    }
    columns = ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in counts.items())
    rows = " UNION ALL ".join(f"SELECT doc_id, l, s, '{m}' AS m, {c} AS c, {n} AS n, {k} AS k FROM c" for m, (c, n, k) in MEASURES.items())
    mid, top = (f"min(v) FILTER (upto >= total * {p}::DOUBLE)" for p in QUANTILES)
    over = "CAST(v.k * v.c - v.n * e.fence AS DOUBLE)"
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, chr(0)) AS l, coalesce(source, chr(0)) AS s FROM documents),
        x AS (SELECT *, list_filter(regexp_split_to_array(t, '[ 	-]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS ls FROM d),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM x)),
        r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
        c AS (SELECT x.doc_id, l, s, {columns}, coalesce(r.n, 0) AS n_repeat_words FROM x LEFT JOIN r USING (doc_id)),
        v AS (SELECT *, least(1000, k * c // greatest(n, 1)) AS v FROM ({rows})),
        q AS (SELECT 0 AS level, l, s, m, v FROM v UNION ALL SELECT 1, l, '', m, v FROM v UNION ALL SELECT 2, '', '', m, v FROM v),
        u AS (SELECT *, sum(n) OVER (PARTITION BY level, l, s, m ORDER BY v) AS upto, sum(n) OVER (PARTITION BY level, l, s, m) AS total FROM (SELECT level, l, s, m, v, count(*) AS n FROM q GROUP BY ALL)),
        f AS (SELECT level, l, s, m, CAST(max(total) AS BIGINT) AS n, CAST({top} + {SPREAD} * ({top} - {mid}) AS BIGINT) AS raw FROM u GROUP BY level, l, s, m),
        e AS (SELECT a.l, a.s, a.m, (a.n * a.raw + {PRIOR} * ((b.n * b.raw + {PRIOR} * o.raw) // (b.n + {PRIOR}))) // (a.n + {PRIOR}) AS fence
              FROM f a JOIN f b ON b.level = 1 AND b.l = a.l AND b.m = a.m JOIN f o ON o.level = 2 AND o.m = a.m WHERE a.level = 0),
        k AS (SELECT doc_id, bool_or({over} > 0 AND {over} * {over} > {Z * Z} * CAST(v.k * (v.n * e.fence + v.k) AS DOUBLE)) AS outside FROM v JOIN e ON e.l = v.l AND e.s = v.s AND e.m = v.m GROUP BY doc_id),
        z AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
        SELECT z.*, NOT base_failed AND NOT outside AS kept FROM z JOIN k USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": _quality_rules_sql(),
        "op4_warc_dictionary": """
            WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
            m AS (SELECT payload_digest, max(page_id) AS first_id, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
            SELECT p.page_id, p.payload_bytes, p.payload_digest,
                   CASE WHEN m.n > 1 AND p.page_id <> m.first_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN m.n > 1 AND p.page_id <> m.first_id THEN m.first_id END AS refers_to
            FROM p LEFT JOIN m ON m.payload_digest = p.payload_digest AND p.payload_bytes >= 1000""",
        "op10_url_rules": """
            WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
            s AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
            r(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                                        ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
            f AS (SELECT s.page_id, s.host, s.path, r.rule_host || r.rule_path AS rule, r.verdict,
                         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule_host || r.rule_path) DESC) AS k
                  FROM s LEFT JOIN r ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path))
            SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1""",
    }
