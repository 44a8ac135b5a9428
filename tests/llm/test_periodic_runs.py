"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings, strategies as st

from spreadloom.llm.entries import op12_periodic_runs
from spreadloom.llm.periodic_runs import find_runs, runs_of_texts, suffix_order


def plain_runs(words, least=24, exponent=3):
    n = len(words)
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.array([numbers[w] for w in words], np.int64)
    found = []
    for q in range(1, n // exponent + 1):
        same = np.concatenate(([0], (codes[q:] == codes[:-q]).astype(int), [0]))
        begins, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for a, z in zip(begins.tolist(), ends.tolist()):
            length = z - a + q
            part = words[a:a + length]
            if length >= max(least, exponent * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, words):
    runs = plain_runs(words)
    lost = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    text = " ".join(w for i, w in enumerate(words) if i not in lost)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, text)))


def query_words(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


TEXTS = [
    None, "", " \n\t", "one", "w " * 23, "w " * 24, "w " * 25 + "x " * 24, "a b " * 12, "a b " * 11 + "a", "a b c d e f g h i " * 3,
    "a b c d e f g h " * 3, "a b c d e f g h " * 3 + "a", "x " + "a b c d e f g h " * 3 + "y", ("a " * 7 + "b ") * 4,
    "a a b " * 20 + "c " + "a a b " * 20, ("p q " * 13 + "r ") * 5, "é x ü " * 30, "A a " * 12, "\x1c \x85 " * 24,
    " ".join(f"w{i % 41}" for i in range(41 * 4 + 5)), "the same " * 30_000, " ".join(f"{i}" for i in range(3000)),
    ("a " * 30 + "b ") * 3, ("a " * 30 + "b ") * 2 + "a " * 30, "ab " * 24 + "a b " * 24]


def test_defined_cases(spark):
    df = spark.createDataFrame([(i, t, [1], "s") for i, t in enumerate(TEXTS)] + [(3, TEXTS[7], [2], "s")] * 2,
                               "doc_id long, text string, run_starts array<int>, n_words string")
    got = find_runs(df.repartition(3))
    assert got.columns == ["doc_id", "text", "run_starts", "n_words", "n_words_1", "run_starts_1", "run_lengths", "run_periods", "collapsed_text"]
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        words = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        runs = plain_runs(words) if len(words) < 5000 else [(0, 60_000, 2)]
        assert list(zip(r.run_starts_1, r.run_lengths, r.run_periods)) == runs and r.n_words_1 == len(words)
        lost = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.collapsed_text == " ".join(w for i, w in enumerate(words) if i not in lost)
    assert find_runs(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10 ** 9), st.integers(1, 4), st.sampled_from([(24, 3), (6, 3), (4, 2), (12, 5)]))
def test_many_small_texts(seed, letters, limits):
    rnd = random.Random(seed)
    texts = []
    for _ in range(5):
        text = []
        while len(text) < rnd.randrange(1, 120):
            part = [rnd.choice("abcd"[:letters]) for _ in range(rnd.randrange(1, 12))]
            text += part * rnd.choice((1, 1, 2, 5, 9)) + part[:rnd.randrange(len(part) + 1)]
        texts.append([w.encode() for w in text])
    assert runs_of_texts(texts, *limits) == [plain_runs(t, *limits) for t in texts]


def test_suffix_order():
    rnd = np.random.default_rng(5)
    for n, letters in ((1, 1), (2, 1), (50, 1), (300, 2), (300, 40)):
        codes = rnd.integers(0, letters, n)
        order, shared = suffix_order(codes)
        suffixes = [codes[i:].tolist() for i in range(n)]
        assert order.tolist() == sorted(range(n), key=suffixes.__getitem__)
        for a, z, lcp in zip(order, order[1:], shared):
            assert suffixes[a][:lcp] == suffixes[z][:lcp] and suffixes[a][lcp:lcp + 1] != suffixes[z][lcp:lcp + 1]


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op12_periodic_runs(spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(plain_row(i, query_words(i, t)) for i, t in docs)
    assert sum(r[1] > 0 for r in rows) > 5
