"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline

from . import (
    bpe, decontamination, exact_dedup, fill_middle, html_text, line_dedup, passage_dedup, periodic_runs,
    personal_data, quality, simhash_dedup, token_counts, vector_dedup)
from .common import read_table

QUERIES, CHECKS = {}, {}


def query(make):
    QUERIES[make.__name__] = make
    return make


@query
def op8_personal_data(spark, sf_dir):
    return personal_data.personal_data_digests(
        personal_data.find_personal_data(read_table(spark, sf_dir, "documents")))


@query
def op9_token_counts(spark, sf_dir):
    counted = token_counts.count_tokens(
        read_table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op1_simhash_dedup(spark, sf_dir):
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op5_line_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_STRIPPED = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), " \
            "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CHECKS["op5_line_dedup"] = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS place
    FROM documents),
keys AS (SELECT *, {_STRIPPED} AS key FROM lines),
common AS (
    SELECT key, max(doc_id) AS keeper FROM keys WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
    SELECT keys.*, common.keeper IS NULL OR common.keeper = doc_id AS stays
    FROM keys LEFT JOIN common USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE NOT stays))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op2_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.round_trip_digests(coded, path)


@query
def op3_quality_classifier(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, quality.fit(docs)).select("doc_id", "quality_score", "kept")


@query
def op10_benchmark_decontamination(spark, sf_dir):
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op6_html_extraction(spark, sf_dir):
    return html_text.extract_text(read_table(spark, sf_dir, "pages"))


@query
def op7_substring_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return passage_dedup.drop_repeated_passages(docs).drop("text")


@query
def op4_vector_dedup(spark, sf_dir):
    return vector_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"))


CHECKS["op4_vector_dedup"] = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component USING (vec_id) LEFT JOIN degree USING (vec_id)
"""


@query
def op11_fill_middle(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    moved = fill_middle.fill_middle(docs).drop("text")
    return fill_middle.restore(moved).select(
        "doc_id", F.col("n_units").alias("n"), F.col("fim_form").alias("form"), "prefix_chars", "middle_chars",
        F.sha2("fim_text", 256).alias("output_sha256"), F.sha2("restored_text", 256).alias("restored_sha256"))


CHECKS["op11_fill_middle"] = """
WITH lines AS (
    SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts,
           sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS code FROM documents),
drawn AS (
    SELECT doc_id, text, parts, len(parts) - (parts[-1] = '')::INT AS n,
           [('0x' || substr(code, 8 * i + 1, 8))::BIGINT for i in range(4)] AS h FROM lines),
cuts AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS z FROM drawn),
heads AS (
    SELECT *, [CASE WHEN k = 0 THEN '' WHEN k = n THEN text ELSE array_to_string(parts[1:k], chr(10)) || chr(10) END
               for k in [a, z]] AS head FROM cuts),
pieces AS (
    SELECT doc_id, n, text, h, head[1] AS pre, substr(head[2], length(head[1]) + 1) AS mid,
           substr(text, length(head[2]) + 1) AS suf,
           text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS is_plain FROM heads),
formed AS (
    SELECT *, CASE WHEN is_plain THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM pieces)
SELECT doc_id, n::BIGINT AS n, form,
       (CASE WHEN form <> 'plain' THEN length(pre) END)::BIGINT AS prefix_chars,
       (CASE WHEN form <> 'plain' THEN length(mid) END)::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
              ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM formed
"""


@query
def op12_periodic_runs(spark, sf_dir):
    docs = periodic_runs.with_periodic_tails(read_table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.find_runs(docs))


@query
def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_copies(read_table(spark, sf_dir, "documents"), carry=["doc_id"])


CHECKS["op13_exact_dedup"] = r"""
WITH texts AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
copies AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY norm)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
       sha256(norm) AS text_sha256
FROM texts JOIN copies USING (norm)
"""


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
