"""The queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, html_text, language_id, line_dedup, minhash, packing, substring_dedup, token_store, toxicity
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_exact_dedup, op2_html_text, op3_substring_dedup, op4_line_dedup, op5_decontaminate, op6_token_store, op7_minhash, op8_language_id, op9_packing, op10_toxicity, pipeline]
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY plain) AS group_size, first_value(doc_id) OVER best AS keep_id, row_number() OVER best AS place
  FROM texts WINDOW best AS (PARTITION BY plain ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(plain) AS text_sha256 FROM ranked
"""

OP5 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS place, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), items AS (
  SELECT item_id, {_WORDS.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, ws[i : i + least(13, len(ws)) - 1] AS gram
  FROM items, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0
), sizes AS (
  SELECT DISTINCT len(gram) AS k FROM windows
), grams AS (
  SELECT place, i, k, ws[i : i + k - 1] AS gram FROM docs, sizes, unnest(range(1, len(ws) - k + 2)) AS t(i)
), hits AS (
  SELECT place, i, k, item_id FROM grams JOIN windows USING (gram)
), words AS (
  SELECT place, count(DISTINCT word) AS n_hit FROM (SELECT place, unnest(range(i, i + k)) AS word FROM (SELECT DISTINCT place, i, k FROM hits)) GROUP BY place
), names AS (
  SELECT place, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT place, CAST(item_id AS VARCHAR) AS name FROM hits WHERE item_id IS NOT NULL) GROUP BY place
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN words USING (place) LEFT JOIN names USING (place)
"""

OP3 = """
WITH docs AS (
  SELECT row_number() OVER () AS place, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), every AS MATERIALIZED (
  SELECT place, doc_id, unnest(range(0, len(x) // 2 - 49)) AS i, unnest(list_transform(range(0, len(x) // 2 - 49), lambda i: hash(substr(x, 2 * i + 1, 100)))) AS h FROM docs
), twice AS (
  SELECT h FROM every GROUP BY h HAVING min(doc_id) < max(doc_id)
), starts AS MATERIALIZED (
  SELECT place, every.doc_id, i, substr(x, 2 * i + 1, 100) AS w FROM every JOIN twice USING (h) JOIN docs USING (place)
), firsts AS (
  SELECT w, min(doc_id) AS first_id FROM starts GROUP BY w
), hits AS (
  SELECT place, i FROM starts JOIN firsts USING (w) WHERE first_id < doc_id
), jumps AS (
  SELECT place, i, lag(i) OVER (PARTITION BY place ORDER BY i) AS before FROM hits
), spans AS (
  SELECT place, min(i) AS a, max(i) + 50 AS b FROM (
    SELECT place, i, sum(CASE WHEN before IS NULL OR i - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY place ORDER BY i) AS run FROM jumps
  ) GROUP BY place, run
), gaps AS (
  SELECT place, a, b, lag(b, 1, 0) OVER (PARTITION BY place ORDER BY a) AS before FROM spans
), cuts AS (
  SELECT place, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM gaps JOIN docs USING (place) GROUP BY place
)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cuts USING (place)
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can tell the whole result; the other queries are tested against plain versions."""
    return {"op1_exact_dedup": OP1, "op3_substring_dedup": OP3, "op5_decontaminate": OP5}
