"""The quality classifier: label model, scorer, and accuracy on labels it never saw."""

import numpy as np
from pyspark.sql import functions as F

from spreadloom.llm.entries import op3_quality_classifier
from spreadloom.llm.quality import VOTERS, fit, fit_label_model, fit_scorer, pattern, sample_shares, score_quality, votes


def test_em_finds_the_voters_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(40_000) < 0.8
    right = np.linspace(0.7, 0.95, len(VOTERS))
    cast = np.where(rng.random((len(good), len(VOTERS))) < right, good[:, None], ~good[:, None]).astype(int) * 2 - 1
    cast[rng.random(cast.shape) < 0.2] = 0
    patterns, counts = np.unique([pattern(c) for c in cast.tolist()], return_counts=True)
    model = fit_label_model(patterns, counts.astype(float))
    assert abs(model.good - 0.8) < 0.02
    assert np.abs(model.says[1, :, 2] / (model.says[1, :, 0] + model.says[1, :, 2]) - right).max() < 0.03
    belief = model.posterior(np.array([pattern(c) for c in cast.tolist()]))
    assert ((belief > 0.5) == good).mean() > 0.97


def test_votes_of_plain_and_broken_texts():
    clean = "It was a calm day. The men of the town went to see the river, and most of them came home late. " * 4
    assert min(votes(clean + "Nothing else was said about that for years. Some say it was better so.")) >= 0 < sum(votes(clean))
    for junk in ("word%%% other&&& thing*** " * 30, "home | about | login | cart | " * 30, "BUY NOW!! CHEAP!! " * 30, "la " * 99):
        assert sum(votes(junk)) < sum(votes(clean)) and min(votes(junk)) == -1
    assert votes(None) == votes("") == votes("too short") == [0] * len(VOTERS)


def test_scorer_without_rows_or_without_bad_rows_keeps_all():
    for rows in ([], [([1], [1.0], 1.0)]):
        weights, base = fit_scorer(rows)
        assert base > 0 and not weights.any()


def test_defined_cases(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs)
    odd = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "x%%% y&&& " * 20_000, "c"), (3, "Fine.", "d")],
                                "doc_id long, text string, kept string")
    got = score_quality(odd, model)
    assert got.columns == ["doc_id", "text", "kept", "quality_score", "kept_1"]
    assert sorted((r.doc_id or 0, r.kept_1) for r in got.collect()) == [(0, True), (1, True), (1, True), (2, False), (3, True)]
    assert score_quality(odd, model, only_kept=True).columns == odd.columns
    assert score_quality(odd, model, only_kept=True).count() == 4
    empty = odd.limit(0)
    assert score_quality(empty, fit(empty)).count() == 0


def test_accuracy_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = op3_quality_classifier(spark, sf_dir).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.01 * (n[(1, True)] + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.06 * (n[(0, False)] + n.get((0, True), 0))
    assert op3_quality_classifier(spark, sf_dir).select(F.countDistinct("doc_id")).first()[0] == 1000


CLEAN = "It was a calm day number {0}. The men of the town went to see river {0}, and most of them came home late. " * 4
JUNK = "word%%% other&&& thing*** {0} " * 30


def test_rare_junk_is_in_a_small_sample(spark):
    docs = [(i, CLEAN.format(i)) for i in range(300)] + [(400 + i, "") for i in range(5)] + [(500 + i, JUNK.format(i)) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for train_rows in (10_000, 30):
        got = {r.doc_id: r.kept for r in score_quality(df, fit(df, train_rows=train_rows)).collect()}
        assert [i for i, kept in got.items() if not kept] == [500, 501, 502]


def test_empty_texts_stay_where_most_is_bad(spark):
    docs = [(i, CLEAN.format(i)) for i in range(20)] + [(100 + i, JUNK.format(i)) for i in range(60)] + [(200, ""), (201, None), (202, " "), (203, "Fine.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = fit(df)
    assert model.labels.good < 0.5
    kept = {r.doc_id for r in score_quality(df, model).collect() if r.kept}
    assert {200, 201, 202, 203} <= kept and kept >= set(range(20)) and not kept & set(range(100, 160))


def test_sample_is_bounded_and_holds_every_pattern():
    counts = np.array([1, 3, 10, 10 ** 6, 10 ** 9])
    shares = sample_shares(counts, 1000)
    assert (shares * counts).sum() <= 2 * 1000 + 1e-6 and (shares[:3] == 1).all() and (shares > 0).all()


def test_em_on_counts_equals_em_on_documents():
    """Expectation and maximisation by loops over single documents, votes and classes."""
    rng = np.random.default_rng(8)
    cast = [[int(v) for v in rng.choice([-1, 0, 1], len(VOTERS), p=p)] for p in ([0.1, 0.2, 0.7], [0.6, 0.2, 0.2]) for _ in range(60)]
    patterns, counts = np.unique([pattern(c) for c in cast], return_counts=True)
    got = fit_label_model(patterns, counts.astype(float), rounds=5, stop=0.0)
    belief = [0.9 if -1 not in c else 0.6 if sum(c) > 4 else 0.1 for c in cast]
    for _ in range(5):
        says = [[[0.5] * 3 for _ in VOTERS] for _ in (0, 1)]
        for c, b in zip(cast, belief):
            for v, vote in enumerate(c):
                says[0][v][vote + 1] += 1 - b
                says[1][v][vote + 1] += b
        says = [[[x / sum(three) for x in three] for three in label] for label in says]
        share = (sum(belief) + 1) / (len(cast) + 2)
        belief = []
        for c in cast:
            one, zero = share, 1 - share
            for v, vote in enumerate(c):
                one *= says[1][v][vote + 1]
                zero *= says[0][v][vote + 1]
            belief.append(one / (one + zero))
    assert abs(got.good - share) < 1e-9 and np.allclose(got.says, says, atol=1e-9)
    assert np.allclose(got.posterior(np.array([pattern(c) for c in cast])), belief, atol=1e-9)
