"""Token counts against the library on whole texts."""

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from spreadloom.llm.entries import op9_token_counts
from spreadloom.llm.token_counts import Counter, count_tokens, splice

PATH = P.path("byte_bpe_50k.json")
TEXTS = [
    "", None, "x", "  \n\n  ", "a" * 700, " " * 900, "It's  the end. " * 60, "wörter für 12345 " * 40,
    "漢字かな交じり文 " * 50, "ab<|endoftext|>cd " * 50, "<|endoftext|>" * 80, "tail   " + "é" * 333 + "\x1c\x85 x",
    "no border at all" + "z" * 5_000 + " then words again " * 30,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("chunk, overlap", [(100, 40), (64, 64), (257, 90)])
def test_spliced_chunks_equal_the_library(spark, library, chunk, overlap):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in
           count_tokens(docs, PATH, P.PATTERN, chunk_chars=chunk, overlap=overlap).collect()}
    for i, t in enumerate(TEXTS):
        t = t or ""
        assert got[i] == (len(t.encode()), len(library.encode(t, add_special_tokens=False))), repr(t[:30])


def test_all_vocabularies_equal_their_library(spark):
    import sentencepiece

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    piece = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, P.path("piece_bpe_32k.model"), P.PATTERN).collect()}
    assert got == {i: len(piece.encode(t or "")) for i, t in enumerate(TEXTS)}
    ranks = Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r.doc_id: r.n_tokens for r in count_tokens(
        docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk_chars=120, overlap=50).collect()}
    assert got == {i: len(ranks.library.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)}


def test_splice_needs_a_common_border():
    assert splice(([0, 4, 9], [0, 1, 3]), ([5, 9, 11], [0, 2, 3]), 5, 10) == (3, 2)
    assert splice(([0, 4], [0, 1]), ([5, 9], [0, 2]), 0, 10) is None


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (8, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(docs, PATH, P.PATTERN).collect()) == [
        (0, 2), (7, 2), (7, 2), (8, 0)]
    assert count_tokens(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_query_against_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op9_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
