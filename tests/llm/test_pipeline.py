"""The pipeline, stage by stage, against brute force on each stage's own input."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from spreadloom.llm.bpe import encoding
from spreadloom.llm.decontamination import align, words_of
from spreadloom.llm.simhash_dedup import shingle_hashes
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_simhash_dedup import roots

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        step(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay_until_the_last_stage(stages):
    for before, after in stages[:-1]:
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in before.schema]
        assert after.count() <= before.count()


def test_quality_stage_rejects_junk_and_keeps_good(spark, stages):
    before, after = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = texts(after)
    assert all(kept[i] == t for i, t in texts(before).items() if i in kept)
    good = [i in kept for i, q in labels.items() if q == 1]
    bad = [i in kept for i, q in labels.items() if q == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.06


def test_line_stage_equals_brute_force(stages):
    before, after = stages[1]
    assert texts(after) == {i: t for i, _, _, t in plain_lines(list(texts(before).items()))}
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_similar_stage_keeps_one_of_each_group(stages):
    before, after = stages[2]
    given, kept = texts(before), set(texts(after))
    ids = sorted(given)
    shingles = {i: set(shingle_hashes(given[i], 5).tolist()) for i in ids}
    holders = {}
    for i in ids:
        for s in shingles[i]:
            holders.setdefault(s, []).append(i)
    pairs = {(a, b) for h in holders.values() if len(h) < 300 for a in h for b in h if a < b}
    score = {(a, b): len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) for a, b in pairs}
    similar = [p for p, s in score.items() if s >= 0.8]
    missed = [p for p in similar if p[0] in kept and p[1] in kept]
    assert similar and len(missed) <= 0.02 * len(similar)
    loose = roots(ids, [p for p, s in score.items() if s >= 0.6])
    empty = [i for i in ids if not shingles[i]]
    for i in ids:  # nothing goes without a similar document of smaller id
        assert i in kept or loose[i] != i or i in empty[1:]


def test_benchmark_stage_drops_every_copy(spark, stages):
    before, after = stages[3]
    given, kept = texts(before), set(texts(after))
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    number: dict[str, int] = {}
    coded = [np.array([number.setdefault(x, len(number) + 1) for x in w], np.int64) for w in items]
    for i, text in given.items():
        own = np.array([number.get(x, 0) for x in words_of(text)], np.int64)
        best = max((align(w, own)[0] / (2 * len(w)) for w in coded
                    if len(own) and np.isin(own, w).sum() >= 0.3 * len(w)), default=0)
        assert i in kept if best < 0.4 else i not in kept or best < 0.6, (i, best)


def test_last_stage_equals_the_library(stages):
    before, after = stages[4]
    code, given = encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), texts(before)
    rows = after.collect()
    assert len(rows) == len(given)
    for r in rows:
        ids = code.encode_ordinary(given[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_odd_rows_pass(spark):
    odd = spark.createDataFrame(
        [(None, None, 1, 5), (1, "", 2, 6), (1, "", 2, 6), (2, None, 3, 7)], "doc_id long, text string, n_lines int, kept_text int")
    docs = odd
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns == odd.columns
    # The empty texts are copies of each other, a row without id is none.
    assert sorted((r.doc_id or 0, r.n_tokens) for r in corpus_pipeline.encode_and_decode(spark, docs, SF).collect()) == [(0, 0), (1, 0), (1, 0)]
    empty = odd.limit(0)
    for _, step in corpus_pipeline.STAGES:
        empty = step(spark, empty, SF)
    assert empty.count() == 0
