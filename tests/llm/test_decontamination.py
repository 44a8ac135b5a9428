"""Decontamination: alignment, seeds and the whole search against brute force."""

import random

import numpy as np
import pytest

from spreadloom.llm.decontamination import (
    GAP, MATCH, OTHER, align, contaminated, drop_contaminated, words_of)
from spreadloom.llm.entries import op10_benchmark_decontamination


def plain_score(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (MATCH if x == y else OTHER), above[j + 1] + GAP, row[j] + GAP))
        best, above = max(best, *row), row
    return best


def test_alignment_equals_the_plain_recurrence():
    rng = random.Random(3)
    for _ in range(150):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        b = [rng.randrange(4) for _ in range(rng.randrange(0, 20))]
        score, start, end = align(np.array(a), np.array(b, np.int64))
        assert score == plain_score(a, b)
        if score:
            assert plain_score(a, b[start:end]) == score


ITEM = "The quick brown fox jumps over the lazy dog while seven wise owls watch from a crooked pine tree"


@pytest.fixture(scope="module")
def filler():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "a", "over"] * 30
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


def test_exact_edited_hot_and_clean(spark, filler):
    w = ITEM.split()
    edited = " ".join("other" if i % 4 == 3 else x for i, x in enumerate(w))
    moved = " ".join(w[:6] + ["really", "truly"] + w[6:12] + w[13:])
    docs = [(i, filler(60) + " " + ITEM.upper() + ". " + filler(30)) for i in range(40)]  # a third copies it
    docs += [(100, filler(50) + "\n" + edited), (101, moved + " " + filler(80)), (102, " ".join(w[:5]) + " " + filler(90))]
    docs += [(200 + i, filler(100)) for i in range(60)] + [(300, None), (301, ""), (302, "one"), (None, ITEM), (0, ITEM)]
    items = [(1, ITEM), (2, None), (3, ""), (4, filler(25)), (5, "one"), (None, "nobody says this thing")]
    d = spark.createDataFrame([(a, b, 0.5) for a, b in docs], "doc_id long, text string, score double")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    rows = contaminated(d, b).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in rows)
    assert got == sorted([(-1, 1), (0, 1), (302, 5)] + [(i, 1) for i in [*range(40), 100, 101]])
    whole = next(r for r in rows if r.doc_id == 3)
    assert whole.score == 1.0 and docs[3][1][whole.start:whole.end] == ITEM.upper()
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [102, *range(200, 260), 300, 301]
    in_blocks = contaminated(d, b, block_chars=60).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in in_blocks) == sorted((r.doc_id or 0, r.item_id) for r in rows)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert contaminated(d.limit(0), b).count() == 0
    assert contaminated(d, b.limit(0)).count() == 0
    assert drop_contaminated(d, b.limit(0)).count() == 1


def test_query_against_brute_force(spark, sf_dir):
    items = {r.item_id: words_of(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.score for r in op10_benchmark_decontamination(spark, sf_dir).collect()}
    want = {}
    number: dict[str, int] = {}
    coded = {i: np.array([number.setdefault(x, len(number) + 1) for x in w], np.int64) for i, w in items.items()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        own = np.array([number.get(x, 0) for x in words_of(r.text)], np.int64)
        for i, w in coded.items():
            # An alignment of score s needs s / 2 words in common; only these are aligned.
            if len(own) and np.isin(own, w).sum() >= 0.4 * len(w) and (s := align(w, own)[0] / (2 * len(w))) >= 0.4:
                want[(r.doc_id, i)] = s
    strong = {k: v for k, v in want.items() if v >= 0.6}
    assert strong and {k: got.get(k) for k in strong} == strong
    assert all(k in want and got[k] <= want[k] for k in got)


def test_passages_of_long_items_and_moved_parts(spark, filler):
    rng = random.Random(8)
    long, short = ([f"{c}{rng.randrange(900)}" for _ in range(n)] for c, n in (("l", 300), ("s", 30)))
    docs = {1: long[50:150], 2: long[211:231], 3: long[211:229], 4: short[20:] + filler(90).split() + short[10:20] + filler(70).split() + short[:10],
            5: sum([long[i:i + 11] + filler(300).split() for i in (250, 100, 40)], []), 6: sum([long[i:i + 5] + filler(300).split() for i in (9, 90, 200)], []),
            7: short[:9], 8: long[100:200] + filler(150).split() + long[200:] + filler(150).split() + long[:100], 9: short[3:12] + filler(60).split() + short[3:12]}
    d = spark.createDataFrame([(i, filler(40) + " " + " ".join(w) + " " + filler(40)) for i, w in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(d, b).collect()}
    assert got.keys() == {(1, 1), (2, 1), (4, 2), (5, 1), (8, 1)}
    assert got[1, 1] == pytest.approx(1 / 3, abs=0.01) and got[4, 2] == pytest.approx(1, abs=0.01)
    assert sorted(r.doc_id for r in drop_contaminated(d, b).collect()) == [3, 6, 7, 9]


def test_a_common_passage_of_a_rare_item_is_found(spark, filler):
    item = [f"r{i}" for i in range(200)]
    docs = [(i, filler(20) + " " + " ".join(item[60:82]) + " " + filler(20)) for i in range(50)]
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert contaminated(spark.createDataFrame(docs, "doc_id long, text string"), b).count() == 50
