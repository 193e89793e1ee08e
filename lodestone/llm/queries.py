"""The queries of this subpackage and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.bpe import round_trip
from lodestone.llm.common import table
from lodestone.llm.embedding_dedup import near_vectors
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.funnel import count_funnels
from lodestone.llm.html_extract import extract_pages
from lodestone.llm.jaccard import jaccard_groups
from lodestone.llm.langid import identify
from lodestone.llm.line_dedup import line_report
from lodestone.llm.packing import best_fit_pack
from lodestone.llm.private_data import find_private, private_digest
from lodestone.llm.secrets import find_secrets, span_digest
from lodestone.llm.substring_dedup import passage_report
from lodestone.llm.whitening import whiten

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(find_secrets(table(spark, sf_dir, "documents")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_digest(find_private(table(spark, sf_dir, "documents")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_funnels(table(spark, sf_dir, "clicks"))


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_language_id": op4_language_id,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_bpe": op6_bpe,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_line_dedup": op8_line_dedup,
        "op10_html_extraction": op10_html_extraction,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op11_private_data": op11_private_data,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_funnel_counts": op13_funnel_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": r"""
            WITH d AS (
                SELECT doc_id, length(coalesce(text, '')) AS n,
                       regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
                FROM documents)
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
        """,
        "op8_line_dedup": r"""
            WITH l AS (
                SELECT doc_id, unnest(string_split(text, chr(10))) AS words, generate_subscripts(string_split(text, chr(10)), 1) AS line
                FROM documents),
            f AS (
                SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS nth,
                       len(regexp_extract_all(words, '[^\x20\x09-\x0D]+')) >= 50 AS wordy
                FROM l WHERE regexp_matches(words, '[^\x20\x09-\x0D]')),
            p AS (SELECT *, lead(words) OVER (PARTITION BY doc_id ORDER BY nth) AS follows FROM f),
            b AS (
                SELECT doc_id, nth, 2 AS size, row_number() OVER (PARTITION BY words, follows ORDER BY doc_id, nth) AS copy
                FROM p WHERE follows IS NOT NULL
                UNION ALL
                SELECT doc_id, nth, 1, row_number() OVER (PARTITION BY words ORDER BY doc_id, nth) FROM f WHERE wordy),
            gone AS (SELECT DISTINCT doc_id, nth + d AS nth FROM b, (VALUES (0), (1)) AS s(d) WHERE copy > 1 AND d < size),
            j AS (
                SELECT gone.doc_id, gone.nth, b.nth IS NULL AS opens
                FROM gone LEFT JOIN b ON b.doc_id = gone.doc_id AND b.nth = gone.nth - 1 AND b.size = 2 AND b.copy > 1),
            r AS (SELECT doc_id, nth, sum(opens::int) OVER (PARTITION BY doc_id ORDER BY nth) AS run FROM j),
            t AS (SELECT doc_id, count(*) AS lines FROM r GROUP BY doc_id, run),
            m AS (SELECT doc_id, sum(lines) AS n_removed, count(*) AS n_runs, max(lines) AS longest_run FROM t GROUP BY doc_id),
            k AS (
                SELECT l.doc_id, count(f.nth) AS n_lines, string_agg(l.words, chr(10) ORDER BY l.line) FILTER (WHERE r.nth IS NULL) AS kept
                FROM l LEFT JOIN f ON f.doc_id = l.doc_id AND f.line = l.line LEFT JOIN r ON r.doc_id = f.doc_id AND r.nth = f.nth
                GROUP BY l.doc_id)
            SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(m.n_removed, 0)::bigint AS n_removed, coalesce(m.n_runs, 0) AS n_runs,
                   coalesce(m.longest_run, 0) AS longest_run, sha256(coalesce(k.kept, '')) AS kept_sha256
            FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
        """,
        "op13_funnel_counts": """
            WITH e AS (SELECT DISTINCT client_id, kind, ts FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL),
            f(funnel, s1, s2, s3, s4, ex) AS (VALUES ('A', 'view', 'click', 'view', 'purchase', 'error'),
                ('B', 'signup', 'view', 'click', 'purchase', 'error'), ('C', 'click', 'click', 'purchase', 'view', 'signup')),
            a1 AS (SELECT f.*, e.client_id, e.ts AS t1 FROM f JOIN e ON e.kind = f.s1),
            b2 AS (SELECT a.*, e.ts AS t2 FROM a1 a ASOF JOIN e ON e.client_id = a.client_id AND e.kind = a.s2 AND e.ts > a.t1),
            c2 AS (SELECT b.*, e.ts AS x FROM b2 b ASOF LEFT JOIN e ON e.client_id = b.client_id AND e.kind = b.ex AND e.ts > b.t1),
            a2 AS (SELECT * EXCLUDE (x) FROM c2 WHERE t2 <= t1 + INTERVAL 60 MINUTE AND (x IS NULL OR x > t2)),
            b3 AS (SELECT a.*, e.ts AS t3 FROM a2 a ASOF JOIN e ON e.client_id = a.client_id AND e.kind = a.s3 AND e.ts > a.t2),
            c3 AS (SELECT b.*, e.ts AS x FROM b3 b ASOF LEFT JOIN e ON e.client_id = b.client_id AND e.kind = b.ex AND e.ts > b.t2),
            a3 AS (SELECT * EXCLUDE (x) FROM c3 WHERE t3 <= t2 + INTERVAL 60 MINUTE AND (x IS NULL OR x > t3)),
            b4 AS (SELECT a.*, e.ts AS t4 FROM a3 a ASOF JOIN e ON e.client_id = a.client_id AND e.kind = a.s4 AND e.ts > a.t3),
            c4 AS (SELECT b.*, e.ts AS x FROM b4 b ASOF LEFT JOIN e ON e.client_id = b.client_id AND e.kind = b.ex AND e.ts > b.t3),
            a4 AS (SELECT * EXCLUDE (x) FROM c4 WHERE t4 <= t3 + INTERVAL 60 MINUTE AND (x IS NULL OR x > t4)),
            s AS (SELECT funnel, client_id, 1 AS step, NULL::BIGINT AS took FROM a1
                UNION ALL SELECT funnel, client_id, 2, epoch_us(t2) - epoch_us(t1) FROM a2
                UNION ALL SELECT funnel, client_id, 3, epoch_us(t3) - epoch_us(t2) FROM a3
                UNION ALL SELECT funnel, client_id, 4, epoch_us(t4) - epoch_us(t3) FROM a4),
            g AS (SELECT funnel, client_id, count(*) FILTER (step = 1) AS n1, count(*) FILTER (step = 2) AS n2, count(*) FILTER (step = 3) AS n3,
                    count(*) FILTER (step = 4) AS n4, max(step)::INT AS deepest, list_sort(list(took) FILTER (step = 2)) AS l2,
                    list_sort(list(took) FILTER (step = 3)) AS l3, list_sort(list(took) FILTER (step = 4)) AS l4
                FROM s GROUP BY funnel, client_id)
            SELECT funnel, client_id, n1, n2, n3, n4, deepest, l2[(90 * n2 + 99) // 100] AS t2, l3[(90 * n3 + 99) // 100] AS t3,
                   l4[(90 * n4 + 99) // 100] AS t4, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth
            FROM g
        """,
    }
