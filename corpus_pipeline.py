"""From raw documents to token digests: five corpus operators in a row.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and
returns the columns of ``docs``, the last one the digests of the encoded documents. The
quality model, the line counts, the groups of copies and the n-gram frequencies are taken
from the stage's own input.

Defined cases are those of the operators: null and empty texts pass all filters, a row with a null id is
never counted as a copy, extra columns pass through to the last stage, and an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from spreadloom.llm import bpe, decontamination, line_dedup, quality, simhash_dedup
from spreadloom.llm.common import bound_batches, own_name, read_table
from spreadloom.staging import stage

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    bound_batches(spark)
    return quality.score_quality(docs, quality.fit(docs), only_kept=True)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of five documents or more stay in the last one only; n_chars follows the text."""
    bound_batches(spark)
    cut = line_dedup.drop_repeated_lines(docs)
    kept, dropped = own_name(docs, "kept_text"), own_name(docs, "n_dropped")
    new = {"text": F.when(F.col(dropped) > 0, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(dropped) > 0, F.char_length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a shingle similarity of 0.8 or more, the one of the smallest id stays.

    Found by SimHash fingerprints in pigeonring chains, and by minima where fingerprints differ too much; exact sets decide.
    """
    bound_batches(spark)
    return simhash_dedup.drop_similar(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document left."""
    bound_batches(spark)
    return bpe.round_trip_digests(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("line dedup", drop_common_lines),
    ("SimHash near-dedup", keep_one_of_similar),
    ("benchmark decontamination", drop_benchmark_copies),
    ("byte-level BPE", encode_and_decode),
]

ORACLE_SQL = None  # EM, fingerprints, alignment and BPE have no SQL form; tests/llm/test_pipeline.py has brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
