"""Queries over the labels of texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import domains
from lodestone.plans.registry import query, table


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents),
               t AS (SELECT doc_id, quality, ws FROM w JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
               u AS (SELECT quality, unnest(ws) AS word FROM t),
               c AS (SELECT word, count(*) FILTER (WHERE quality = 0) AS n0, count(*) FILTER (WHERE quality = 1) AS n1 FROM u GROUP BY word),
               s AS (SELECT sum(n0) AS t0, sum(n1) AS t1, count(*) AS v FROM c),
               p AS (SELECT ln(count(*) FILTER (WHERE quality = 0)::DOUBLE / count(*)) AS p0, ln(count(*) FILTER (WHERE quality = 1)::DOUBLE / count(*)) AS p1 FROM t),
               m AS (SELECT word, ln((n0 + 1) / (t0 + v)::DOUBLE) AS w0, ln((n1 + 1) / (t1 + v)::DOUBLE) AS w1 FROM c, s),
               x AS (SELECT doc_id, unnest(ws) AS word FROM w),
               f AS (SELECT doc_id, sum(w0) AS f0, sum(w1) AS f1, count(*) AS n_known FROM x JOIN m USING (word) GROUP BY doc_id),
               y AS (SELECT doc_id, coalesce(f0, 0) + p0 AS s0, coalesce(f1, 0) + p1 AS s1, coalesce(n_known, 0) AS n_known FROM documents LEFT JOIN f USING (doc_id), p)
          SELECT doc_id, CASE WHEN s0 >= s1 THEN '0' ELSE '1' END AS label, round(1 / (exp(s0 - greatest(s0, s1)) + exp(s1 - greatest(s0, s1))), 6) AS p, n_known FROM y""")
def document_domains(spark, d):
    docs = table(spark, d, "documents")
    model = domains.learn(docs.join(table(spark, d, "labels"), "doc_id"), "quality", "text")
    return domains.classify(docs, "doc_id", "text", model).withColumn("p", F.round("p", 6))
