"""Periodic run detection: stretches of words that repeat with a period, found by descending LCP.

A run is a stretch of consecutive words with smallest period q, at least ``least_words``
and ``least_exponent`` periods long, that neither neighbour extends.

Within a batch of texts, words are numbered anew in each text, so no two texts share a
word and all are treated as one sequence:

1. Hashes of ``SEED_WORDS`` words in a row are compared; a text in which none comes twice
   has no run and is done. (A hash that two stretches share by chance only costs time.)
2. Suffixes of the rest are ordered by doubling: ranks of 1, 2, 4 … words, until all differ.
   The ranks give the exact longest common prefix (LCP) of neighbours.
3. Neighbours are united by decreasing LCP, as Kruskal's algorithm takes edges, in a
   union-find whose classes are ordered sets of positions. The smaller set goes into the
   larger, position by position. Two positions that become neighbours in a set have
   exactly the current LCP; at a distance d within it they repeat with period d, and no
   smaller period, since a smaller one would have put a position between them earlier.
   Those that the word before does not continue are the starts of runs.

Memory is the batch and, for texts with repeats, 8 bytes per word and doubling: log2 of the
longest repeat. Nothing shuffles; no text meets another.

Defined cases: a null or empty text has no words and no runs; words are what stands
between ASCII white space, compared as bytes; rows that repeat an id are each a text of
their own; extra columns pass through, a name already taken gets a number; an empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import extend_rows, own_name

LEAST_WORDS, LEAST_EXPONENT = 24, 3


def seed_words(least_words: int, least_exponent: int) -> int:
    """Words that the two suffixes at a run's start share at the least: the run without its first period."""
    return least_words - least_words // least_exponent


def repeats_somewhere(codes: np.ndarray, words: int) -> np.ndarray:
    """Positions whose next ``words`` codes are, by hash, also found elsewhere."""
    n = len(codes) - words + 1
    if n < 2:
        return np.empty(0, np.int64)
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    # Binary parts of ``words``: blocks of 1, 2, 4 … codes, each hashed from two halves.
    block, width, hashes, done = mixed, 1, np.zeros(n, np.uint64), 0
    while done < words:
        if words & width:
            hashes = hashes * np.uint64(0x94D049BB133111EB) + block[done:done + n]
            hashes ^= hashes >> np.uint64(31)
            done += width
        if done < words:
            block = block[:-width] * np.uint64(0xD6E8FEB86659FD93) + block[width:]
            block ^= block >> np.uint64(32)
            width *= 2
    order = np.argsort(hashes)
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    return order[np.concatenate((same, [False])) | np.concatenate(([False], same))]


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the keys from 1, equal for equal keys, and the order."""
    order = np.argsort(keys)
    ordered = keys[order]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ranks, order


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the LCP of each with the next one."""
    n = len(codes)
    ranks, order = _dense(codes)
    levels, width = [ranks], 1
    while ranks[order[-1]] < n:
        behind = np.zeros(n, np.int64)
        if width < n:
            behind[:-width] = ranks[width:]
        ranks, order = _dense(ranks * (n + 1) + behind)
        levels.append(ranks)
        width *= 2
    a, z = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    for level in reversed(range(len(levels))):
        ranks, width = levels[level], 1 << level
        inside = (a < n) & (z < n)
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[a[inside]] == ranks[z[inside]]
        a[same] += width
        z[same] += width
        shared[same] += width
    return order, shared


def run_seeds(codes: np.ndarray, least_words: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """(start, period, LCP of the two suffixes) of every run of the sequence."""
    if len(codes) < least_words:
        return []
    order, shared = suffix_order(codes)
    edges = np.flatnonzero(shared >= seed_words(least_words, least_exponent))
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    parent: dict[int, int] = {}
    held: dict[int, list[int]] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    seeds = []
    word = codes.tolist()

    def new_neighbours(s: int, t: int, lcp: int) -> None:
        d = t - s
        if d <= lcp and d + lcp >= max(least_words, least_exponent * d) and (s == 0 or word[s - 1] != word[t - 1]):
            seeds.append((s, d, lcp))

    for a, z, lcp in zip(order[edges].tolist(), order[edges + 1].tolist(), shared[edges].tolist()):
        x, y = root(a), root(z)
        large, small = held.get(x) or [x], held.get(y) or [y]
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        parent[y] = x
        held[x] = large
        held.pop(y, None)
        # Only pairs of the two sets are new neighbours, not those that stood together in the smaller one.
        at = [bisect_left(large, p) for p in small]
        for p, k, ahead, behind in zip(small, at, [-1, *at], [*at[1:], -1]):
            if k != ahead and k:
                new_neighbours(large[k - 1], p, lcp)
            if k != behind and k < len(large):
                new_neighbours(p, large[k], lcp)
        for p, k in zip(reversed(small), reversed(at)):
            large.insert(k, p)
    return seeds


def runs_of_texts(words: list[list[bytes]], least_words: int = LEAST_WORDS,
                  least_exponent: int = LEAST_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    number = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.empty(int(sizes.sum()), np.int64)
    ends = np.cumsum(sizes)
    for w, a, z in zip(words, (ends - sizes).tolist(), ends.tolist()):
        codes[a:z] = np.fromiter(map(number.__getitem__, w), np.int64, z - a)
    text_of = np.repeat(np.arange(len(words)), sizes)
    codes += text_of * len(number)
    doubtful = np.unique(text_of[repeats_somewhere(codes, seed_words(least_words, least_exponent))])
    if len(doubtful):
        chosen = np.isin(text_of, doubtful)
        place = np.flatnonzero(chosen)
        for start, period, lcp in run_seeds(codes[chosen], least_words, least_exponent):
            text = int(text_of[place[start]])
            found[text].append((int(place[start] - ends[text] + sizes[text]), period + lcp, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: all of it behind its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, text_column: str = "text", least_words: int = LEAST_WORDS,
              least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """All columns of ``docs`` with n_words, run_starts, run_lengths, run_periods and collapsed_text."""

    def work(values):
        words = [(t or "").encode().split() for t in values[0]]  # bytes.split knows ASCII white space only
        runs = runs_of_texts(words, least_words, least_exponent)
        return None, [[len(w) for w in words], *[[[r[i] for r in own] for own in runs] for i in range(3)],
                      [b" ".join(collapsed(w, own)).decode() for w, own in zip(words, runs)]]

    names = [own_name(docs, x) for x in ("n_words", "run_starts", "run_lengths", "run_periods", "collapsed_text")]
    types = ("bigint", "bigint[]", "bigint[]", "bigint[]", "string")
    return extend_rows(docs, ", ".join(map(" ".join, zip(names, types))), [text_column], work)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the one with the greatest length for its period, and digests of runs and collapsed text."""
    runs = F.arrays_zip("run_starts", "run_lengths", "run_periods")
    best = F.get(F.array_sort(runs, lambda x, y: (
        F.when(x.run_lengths * y.run_periods != y.run_lengths * x.run_periods, F.signum(y.run_lengths * x.run_periods - x.run_lengths * y.run_periods))
        .when(x.run_starts != y.run_starts, F.signum(x.run_starts - y.run_starts))
        .otherwise(F.signum(x.run_periods - y.run_periods)).cast("int"))), F.lit(0))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r.run_starts.cast("string"), r.run_lengths.cast("string"), r.run_periods.cast("string")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("run_starts").cast("bigint").alias("n_runs"), F.col("best.run_starts").alias("start"),
        F.col("best.run_lengths").alias("length"), F.col("best.run_periods").alias("period"),
        F.expr("1000 * best.run_lengths div best.run_periods").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth text, chosen by its id's checksum, gets a tail that repeats with a period.

    From word a on, word i becomes word a + (i - a) % p of the same text; the other texts stay as they are.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    tail = """CASE WHEN h % 10 = 0 AND size(words) > 0 THEN array_join(transform(sequence(0, size(words) - 1), i ->
              words[cast(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (size(words) - a) div (3 + g % 8)) END AS int)]), ' ') ELSE text END"""
    return (docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
            .withColumn("g", F.expr("h div 10"))
            .withColumn("words", F.when(F.col("h") % 10 == 0, words))
            .withColumn("a", F.expr("CASE WHEN size(words) > 0 THEN g % size(words) END"))
            .select("doc_id", F.expr(tail).alias("text")))
