"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, flac, flac_encode, licenses, line_dedup, mixing, ngram_join, quality, quotes, style_tree, token_output


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_token_ids(spark, sf_dir):
    return token_output.encode(table(spark, sf_dir, "documents"))[0]


def op3_license_scan(spark, sf_dir):
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op4_flac_blocks(spark, sf_dir):
    """The PCM blocks of the documents' media; the PCM in base64, so that SQL can be held against it."""
    return flac.pcm_blocks(flac_encode.text_media(table(spark, sf_dir, "documents"))).withColumn("pcm", F.translate(F.base64("pcm"), "\r\n", ""))


def op5_quality_classifier(spark, sf_dir):
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op7_site_style_tree(spark, sf_dir):
    return style_tree.extract(table(spark, sf_dir, "pages"))


def op8_source_mixing(spark, sf_dir):
    return mixing.curriculum(table(spark, sf_dir, "documents"))


def op9_quotation_linking(spark, sf_dir):
    return quotes.linked_conversations(table(spark, sf_dir, "conversations"))


def op10_benchmark_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


#: The media are the texts' bytes as 16-bit samples, so the blocks are pieces of the texts.
OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(text)) h, strlen(text) n FROM documents WHERE text <> ''),
s AS (SELECT doc_id, CASE WHEN n % 2 = 1 THEN h || '00' ELSE h END h, CASE WHEN n % 4 = 0 THEN 2 ELSE 1 END channels, (n + n % 2) // 2 samples FROM d),
b AS (SELECT *, samples // channels each, UNNEST(range((samples // channels + 4095) // 4096)) k FROM s)
SELECT doc_id, k::INTEGER block_no, (k * 4096)::BIGINT first_sample, least(4096, each - k * 4096)::INTEGER n_samples, channels::INTEGER channels,
    16000 sample_rate, 16 bits, to_base64(unhex(substring(h, k * 16384 * channels + 1, 16384 * channels))) pcm, NULL::VARCHAR error
FROM b
"""


#: Sets of word pairs by brute force: all sets that share a gram are counted together, then connected by repeated steps.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS s FROM w WHERE len(w) > 0),
c AS (SELECT s, min(doc_id) AS least, count(*) - 1 AS copies, row_number() OVER () AS id FROM s GROUP BY s),
g AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS gram FROM c),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id AND least(a.n, b.n) >= 0.65 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.65 * (a.n + b.n - count(*)) - 1e-9),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT id, id AS other FROM c UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a),
k AS (SELECT r.id, min(c.least) AS class FROM r JOIN c ON c.id = r.other GROUP BY r.id),
n AS (SELECT a AS id, count(*) AS links FROM l GROUP BY a)
SELECT s.doc_id, k.class, c.copies, coalesce(n.links, 0) AS links FROM s JOIN c USING (s) JOIN k USING (id) LEFT JOIN n USING (id) WHERE c.copies > 0 OR n.links > 0
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_flac_blocks": OP4_SQL, "op6_ngram_jaccard_join": OP6_SQL}
