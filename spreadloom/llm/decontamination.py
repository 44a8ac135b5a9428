"""Benchmark decontamination: rare word pairs seed, Smith-Waterman alignment decides.

Words are runs of word characters, lower-cased. The seeds are the benchmark's n-grams of
``SEED_WORDS`` words, and one pass over all documents counts how many hold each. An item keeps the seeds
that are rare in the corpus, and in any case the rarer half of its own and of each ``STRETCH`` of them in a row: an
item that a third of all documents copy has no rare seed, yet keeps half of them, and so does any passage of it.

A second pass looks up the kept seeds in every document. Where enough different seeds of
an item lie near one diagonal (place in the document minus place in the item), the passage
around is aligned with the item's words: match 2, other word -1, gap -1. The score is
divided by twice the item's words, so 1 is a whole copy. Pairs of at least ``least`` are the result, and those
whose aligned part counts ``PASSAGE_WORDS`` words whatever the item's length (an edit takes off half a word), with
the aligned words' offsets in the text. Where one part is too little, disjoint parts of the item at disjoint places of
the document are added up, each of a fifth of the item, but four words at least and eight are enough; the offsets then reach from the first to the last.

The benchmark is read in blocks of at most ``BLOCK_CHARS`` characters, each broadcast to
both passes: the bound holds whatever the benchmark's size, and all blocks are worked on. Documents are never shuffled.

Defined cases: a null, empty or wordless text of either side has no pair; an item shorter
than a seed is compared as one seed of all its words; rows that repeat an id, on either
side, give a pair each; null ids stay null in the result; extra columns are ignored;
an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import batch, columns, extend_rows

SEED_WORDS, LEAST_SCORE = 2, 0.4
#: Seeds in at most this share of the documents are rare. Near a diagonal: within this many words, or a third of the item.
RARE_SHARE, NEAR_WORDS = 1e-3, 8
#: Words of a passage that is reported by itself; places of seeds of which half are kept; fewest and most words of a part that is added.
PASSAGE_WORDS, STRETCH, PART_WORDS = 20, 4, (4, 8)
BLOCK_CHARS = 8 << 20
MATCH, OTHER, GAP = 2, -1, -1

WORD = re.compile(r"\w+")
FREQUENCIES = columns("seed bigint, docs bigint")
PAIRS = columns("doc_id bigint, item_id bigint, score double, start bigint, end bigint")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class Block:
    """A block of items: words as numbers from 1 on, seeds as sorted codes, and where each seed occurs."""

    items: list[tuple[int | None, np.ndarray]]
    number: dict[str, int]
    codes: np.ndarray
    places: list[list[tuple[int, int]]] = field(repr=False)  # of each code: (item, place in it)

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Block:
        number: dict[str, int] = defaultdict(lambda: len(number) + 1)
        items, found = [], defaultdict(list)
        for item_id, text in rows:
            words = np.array([number[w] for w in words_of(text)], np.int64)
            if len(words):
                items.append((item_id, words))
        base = len(number) + 1
        for i, (_, words) in enumerate(items):
            for place, code in enumerate(seed_codes(words, base).tolist()):
                if code:
                    found[code].append((i, place))
        codes = np.array(sorted(found), np.int64)
        return cls(items, dict(number), codes, [found[c] for c in codes.tolist()])

    def coded(self, words: list[str]) -> np.ndarray:
        """Words as numbers, 0 for those no item has."""
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))

    def hits(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document at which a seed begins, and the seeds."""
        codes = seed_codes(coded, len(self.number) + 1)
        where = np.flatnonzero(codes)
        if not len(where) or not len(self.codes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        seed = np.searchsorted(self.codes, codes[where])
        good = self.codes[np.minimum(seed, len(self.codes) - 1)] == codes[where]
        return where[good], seed[good]


def seed_codes(words: np.ndarray, base: int) -> np.ndarray:
    """A number for the pair of words that begins at each place; 0 if a word is unknown. A lone word pairs with nothing."""
    if not len(words):
        return words
    if len(words) == 1:
        return words * base
    code = words[:-1] * base + words[1:]
    return np.where((words[:-1] > 0) & (words[1:] > 0), code, 0)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, first word of the passage, word behind the last)."""
    score, end = _best(item, passage)
    if score <= 0:
        return 0, 0, 0
    # The alignment turned round, over what ends there, finds where it begins.
    again, length = _best(item[::-1], passage[:end][::-1])
    return score, end - length, end


def _best(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    n = len(passage)
    row, slope = np.zeros(n + 1, np.int64), GAP * np.arange(n + 1)
    best, end = 0, 0
    for word in item.tolist():
        step = np.zeros(n + 1, np.int64)
        step[1:] = np.maximum(row[:-1] + np.where(passage == word, MATCH, OTHER), row[1:] + GAP)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step - slope) + slope  # gaps along the passage
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def kept_seeds(block: Block, frequency: np.ndarray, rare: float) -> np.ndarray:
    """For each seed whether an item keeps it: rare in the corpus, or in the rarer half of an item's or of a stretch's."""
    keep = frequency <= rare
    own = defaultdict(list)
    for seed, places in enumerate(block.places):
        for item, place in places:
            own[item].append((place, seed))
    for found in own.values():
        row = np.array([seed for _, seed in sorted(found)])
        each = np.unique(row)
        keep[each[frequency[each] <= np.median(frequency[each])]] = True
        if len(row) >= STRETCH:
            stretches = np.concatenate([row[:len(row) // STRETCH * STRETCH], row[-STRETCH:]]).reshape(-1, STRETCH)
            counts = frequency[stretches]
            keep[stretches[counts <= np.sort(counts, axis=1)[:, [STRETCH // 2 - 1]]]] = True
    return keep


def near_diagonals(found: list[tuple[int, int]], slack: int, needed: int):
    """(first, last) diagonal of each run of ``found`` (diagonal, seed) without a gap over ``slack`` that has enough seeds."""
    found.sort()
    i = 0
    while i < len(found):
        j = i
        while j + 1 < len(found) and found[j + 1][0] - found[j][0] <= slack:
            j += 1
        if len({seed for _, seed in found[i:j + 1]}) >= needed:
            yield found[i][0], found[j][0]
        i = j + 1


def added_parts(block: Block, item: int, coded: np.ndarray, where: np.ndarray, seeds: np.ndarray, slack: int,
                part: int) -> tuple[int, int, int]:
    """(score, first word, word behind the last) of disjoint parts of an item of ``part`` words or more, by all its seeds."""
    own, coded = block.items[item][1].copy(), coded.copy()
    mine = {seed: [place for i, place in block.places[seed] if i == item]
            for seed in np.unique(block.hits(own)[1]).tolist()}
    hit = np.isin(seeds, list(mine))
    found = [(at - place, seed) for at, seed in zip(where[hit].tolist(), seeds[hit].tolist()) for place in mine[seed]]
    total, first, last = 0, len(coded), 0
    for low, high in list(near_diagonals(found, slack, 2)):
        low, high = max(0, low - slack), min(len(coded), max(0, high) + len(own) + slack)
        while True:
            score, a, z = align(own, coded[low:high])
            if score < MATCH * part:
                break
            _, begin, end = align(coded[low + a:low + z], own)
            own[begin:end], coded[low + a:low + z] = -1, -2  # neither meets anything again
            total, first, last = total + score, min(first, low + a), max(last, low + z)
    return total, first, last


def matches(block: Block, keep: np.ndarray, text: str | None, least: float) -> list[tuple[int | None, float, int, int]]:
    """(item id, score, start, end) of each item the text holds; offsets in code points of the lower-cased text."""
    words = words_of(text)
    coded = block.coded(words)
    where, seeds = block.hits(coded)
    good = keep[seeds] if len(seeds) else np.empty(0, bool)
    near = defaultdict(list)
    for at, seed in zip(where[good].tolist(), seeds[good].tolist()):
        for item, place in block.places[seed]:
            near[item].append((at - place, seed))
    out = []
    for item, found in near.items():
        item_id, own = block.items[item]
        slack = max(NEAR_WORDS, len(own) // 3)
        # A copy whose alignment reaches ``least`` keeps pairs of neighbours; two must be seen, or all a short item has.
        needed = min(2, max(1, len(own) // 6))
        wanted = min(least * MATCH * len(own), MATCH * PASSAGE_WORDS)
        best = 0, 0, 0
        for low, high in near_diagonals(found, slack, needed):
            low, high = max(0, low - slack), min(len(words), max(0, high) + len(own) + slack)
            score, a, z = align(own, coded[low:high])
            if score > best[0]:
                best = score, low + a, low + z
        part = min(PART_WORDS[1], max(PART_WORDS[0], len(own) // 5))
        if MATCH * part <= best[0] < wanted and MATCH * np.isin(own, coded).sum() >= wanted:
            best = max(best, added_parts(block, item, coded, where, seeds, slack, part))
        if best[0] > 0 and best[0] >= wanted:
            out.append((item_id, best[0] / (MATCH * len(own)), *best[1:]))
    if out:
        spans = [m.span() for m in WORD.finditer(text.lower())]
        out = [(item_id, score, spans[a][0], spans[z - 1][1]) for item_id, score, a, z in out]
    return out


def benchmark_blocks(items: DataFrame, id_column: str, text_column: str, block_chars: int = BLOCK_CHARS):
    """The items in blocks of about ``block_chars`` characters, one on the driver at a time."""
    size = F.coalesce(F.char_length(text_column), F.lit(0)) + 16
    given = items.select(F.col(id_column).cast("bigint").alias("item_id"), F.col(text_column).alias("text"))
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = -(-2 * total // block_chars) if total > block_chars else 1
    for k in range(n):
        rows = given if n == 1 else given.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        held, chars = [], 0
        for r in rows.toLocalIterator():
            held.append((r.item_id, r.text))
            chars += len(r.text or "")
            if chars >= block_chars:
                yield Block.of(held)
                held, chars = [], 0
        if held:
            yield Block.of(held)


def _prepared(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, text_column: str, block_chars: int):
    """Each block with its kept seeds, as broadcasts."""
    context, texts = docs.sparkSession.sparkContext, docs.select(text_column)
    for block in benchmark_blocks(items, item_id, item_text, block_chars):
        if not block.items:
            continue
        shared = context.broadcast(block)

        def count(batches, shared=shared):
            block, rows = shared.value, 0
            seen = np.zeros(len(block.codes), np.int64)
            for b in batches:
                for text in b.column(0).to_pylist():
                    rows += 1
                    seen[np.unique(block.hits(block.coded(words_of(text)))[1])] += 1
            some = np.flatnonzero(seen)
            # Row -1 counts the documents.
            yield batch(FREQUENCIES, [np.append(some, -1), np.append(seen[some], rows)])

        frequency, n_docs = np.zeros(len(block.codes), np.int64), 0
        for r in texts.mapInArrow(count, FREQUENCIES).groupBy("seed").agg(F.sum("docs").alias("docs")).collect():
            if r.seed < 0:
                n_docs = r.docs
            else:
                frequency[r.seed] = r.docs
        yield shared, context.broadcast(kept_seeds(block, frequency, max(1.0, RARE_SHARE * n_docs)))


def contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 item_id: str = "item_id", item_text: str = "text", least: float = LEAST_SCORE,
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, score, start, end): every document and item that share a passage."""
    given = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    found = None
    for block, keep in _prepared(docs, items, item_id, item_text, text_column, block_chars):
        def search(batches, block=block, keep=keep):
            for b in batches:
                rows = [(doc_id, *m) for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                        for m in matches(block.value, keep.value, text, least)]
                if rows:
                    yield batch(PAIRS, list(zip(*rows)))

        part = given.mapInArrow(search, PAIRS)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], PAIRS) if found is None else found


def drop_contaminated(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id",
                      item_text: str = "text", least: float = LEAST_SCORE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all their columns, that share no passage with any item."""
    for block, keep in _prepared(docs, items, item_id, item_text, text_column, block_chars):
        def work(values, block=block, keep=keep):
            return [i for i, t in enumerate(values[0]) if not matches(block.value, keep.value, t, least)], []

        docs = extend_rows(docs, "", [text_column], work)
    return docs
