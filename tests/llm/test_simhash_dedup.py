"""SimHash fingerprints, chain search and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spreadloom.llm.components import Forest, connected_components
from spreadloom.llm.entries import op1_simhash_dedup
from spreadloom.llm.jaccard_links import keyed
from spreadloom.llm.simhash_dedup import (
    EXACT, GROUP_ROWS, WIDE, Ring, drop_similar, fingerprint, near_duplicates, near_links, search, similar_documents)
from spreadloom.llm import simhash_dedup


def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBé \n\x1c\x85", max_size=40))
def test_fingerprint_equals_its_definition(text):
    assert fingerprint(text) == plain_print(text)


def spread(seed, centres, copies, flips):
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.integers(0, 1 << 63, centres, dtype=np.uint64):
        for _ in range(copies):
            v = int(c)
            for b in rng.choice(64, rng.integers(0, flips + 1), replace=False):
                v ^= 1 << int(b)
            out.append(v)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("ring", [EXACT, WIDE, Ring(2, 3, 1), Ring(6, 7, 3)])
def test_chains_lose_no_pair(ring):
    for seed, shape in enumerate([(60, 12, 4), (1, 300, 3), (400, 2, 4), (3, 100, 9)]):
        values = spread(seed, *shape)
        forest = Forest(len(values))
        for start in range(ring.n):
            search(start, values, forest, np.arange(len(values)), ring)
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= ring.distance
        want = roots(range(len(values)), [tuple(x) for x in np.argwhere(near)])
        got = roots(range(len(values)), forest.links)
        assert got == want
        assert all(near[a, b] for a, b in forest.links)
        assert len(forest.links) < len(values)


@pytest.mark.parametrize("most", [GROUP_ROWS, 50])
def test_links_of_a_large_group_stay_a_forest(spark, monkeypatch, most):
    monkeypatch.setattr(simhash_dedup, "GROUP_ROWS", most)
    values = spread(7, 2, 900, 2).view(np.int64)
    prints = spark.createDataFrame([(int(v), int(v)) for v in values], "node long, print long")
    links = [(r.a, r.b) for r in near_links(prints).collect()]
    got = roots(values.tolist(), links)
    unsigned = values.view(np.uint64)
    near = np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= 4
    assert got == roots(values.tolist(), [(int(values[a]), int(values[b])) for a, b in np.argwhere(near)])


def test_components_of_chains_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 300)] + [(5, 5), (100, 101)] + [(-4, 900)]
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(links + [(None, 3)], "a long, b long")).collect()}
    assert got == roots({x for link in links for x in link}, links)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nulls_repeats_clashing_columns_and_empty(spark):
    docs = spark.createDataFrame(
        [(5, "", 1), (3, None, 2), (9, " \n ", 3), (4, "one two three four five", 4), (4, "one two three four five", 5),
         (None, "One  two three FOUR five", 6), (8, "quite another text of some words", 7)],
        "doc_id long, text string, print long")
    rows = sorted((r.doc_id or -1, r.component_id) for r in near_duplicates(docs).collect())
    assert rows == [(-1, 4), (3, 3), (4, 4), (4, 4), (5, 3), (8, 8), (9, 3)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(texts)
    prints = np.array([plain_print(texts[i]) for i in ids], np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4, 1))
    want = roots(ids, [(ids[a], ids[b]) for a, b in near])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash_dedup(spark, sf_dir).collect()}
    assert got == {i: (f"{int(p):016x}", want[i]) for i, p in zip(ids, prints)}


def test_similar_documents_are_grouped_and_others_left(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(3000)] + ["the", "of", "and"] * 400
    docs, want = [], {}
    for g in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(120, 400))]
        for c in range(5 if g < 20 else 1):
            copy = list(base)
            for _ in range(c * len(base) // 350):  # each edit changes five shingles: similarity stays over 0.88
                copy[rng.randrange(len(copy))] = "edited"
            want[len(docs)] = len(docs) - c
            docs.append((len(docs), " ".join(copy), "x"))
    df = spark.createDataFrame(docs + [(None, "alone", "y"), (900, "", "z"), (901, None, "z")], "doc_id long, text string, print string")
    got = {r.doc_id: r.component_id for r in similar_documents(df).collect()}
    assert got == {**want, 900: 900, 901: 900}
    kept = drop_similar(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {*want.values(), None, 900}
    assert drop_similar(df.limit(0)).count() == 0


def jaccard(a, b):
    x, y = (set(simhash_dedup.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_cut_pasted_and_replaced_copies_of_similarity_08_are_linked(spark):
    rng, docs, want = random.Random(9), [], {}
    filler = " ".join(f"f{i}" for i in range(30)) + " "
    for g in range(240):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.randrange(120, 600))]
        n, share = len(base), rng.uniform(0.02, 0.3)
        at, k = rng.randrange(n // 2), int(n * share)
        copy = [base[:n - k], base[:at] + (filler * 20).split()[:k] + base[at:], base[:at] + (filler * 20).split()[:k] + base[at + k:]][g % 3]
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g + (jaccard(docs[-1][1], docs[-2][1]) < 0.8)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_documents(df).collect()} == want
    assert 60 < sum(i == c for i, c in want.items()) - 240 < 180


def test_chains_that_no_star_joins(spark):
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[12 * i:12 * i + 150])) for i in range(20)]  # neighbours 0.85, next but one 0.72
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(20), 0)


def test_fingerprints_alone_propose_and_sets_decide(spark, monkeypatch):
    """Without any key of minima, the near fingerprints of the sets still link what the sets confirm."""
    base = [f"w{i}" for i in range(900)]
    docs = [(0, " ".join(base)), (1, " ".join(base[:-2])), (2, " ".join(["x"] + base)), (3, " ".join(f"v{i}" for i in range(300)))]
    sets = [np.unique(simhash_dedup.shingle_hashes(t, 5)) for _, t in docs]
    assert all((simhash_dedup.print_of(sets[0]) ^ simhash_dedup.print_of(x)).bit_count() <= 4 for x in sets[:3])
    monkeypatch.setattr(simhash_dedup, "keyed", lambda *given: keyed(*given).withColumn("keys", F.array().cast("array<bigint>")))
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}
