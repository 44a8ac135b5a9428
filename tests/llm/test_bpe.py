"""BPE over a table against the library, and the round trip."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from spreadloom.llm.bpe import decode, encode, encoding, pack, pack_words, unpack, unpack_words
from spreadloom.llm.entries import op2_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "x", " \n\n  a", "It's  the end. " * 30, "wörter 12345 " * 20, "漢字かな ١٢٣  文" * 9,
         "<|endoftext|> as plain text", "tail \x1c\x85  x \U0001f600", "same text", "same text"]


@pytest.mark.parametrize("chunk", [1, 200, 1 << 20])
def test_ids_equal_the_library_and_decode_to_the_text(spark, chunk):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, chunk int")
    coded = encode(docs, PATH, P.PATTERN, chunk_bytes=chunk)
    code = encoding(PATH, P.PATTERN)
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: code.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r.doc_id: bytes(r.bytes).decode() for r in decode(coded, PATH).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (8, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in encode(docs, PATH, P.PATTERN).collect()) == [(0, 2), (7, 2), (7, 2), (8, 0)]
    assert encode(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_packs_come_back():
    arrays = [np.array([0, 1, 70_000, 2**32 - 1]), np.array([], np.int64)]
    assert all((a == b).all() for a, b in zip(arrays, unpack(pack(*arrays))))
    words = [b"", b"a", "é".encode(), b"\0\n"]
    assert unpack_words(pack_words(words)) == words and unpack_words(pack_words([])) == []


def test_query_against_the_library(spark, sf_dir):
    code = encoding(PATH, P.PATTERN)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = code.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
