"""Substring dedup by hashed paragraphs: repeated passages go, their first occurrence stays.

A text is cut in units: a unit begins at each line's first word, behind a sentence mark, at
a word with a capital letter, and at every word whose hash is the smallest of some ``WINDOW``
words in a row. The last are the same words wherever a passage stands, with or without
marks. From each border a paragraph of whole units is taken until it has
``PARAGRAPH_WORDS`` words, and to each line's end the shortest such one that ends there.
Its lower-cased words are hashed to 64 bits: word hashes are
summed with the powers of an odd base, so a whole batch is hashed from one running sum.

1. All digests are grouped globally, with partial least and greatest document ids in every task;
   those of two documents and more are a table of their own.
2. A Bloom filter of these (16 bits each, 32 MiB at most, broadcast) lets a second pass
   emit only the digests that are most likely repeated. They are joined with the table,
   in a join that adaptive execution can split where a digest is hot.
3. Each document gets the digests it loses, those whose least document is another one, and
   those it holds twice itself. It is parsed again, neighbouring or overlapping repeats are
   joined to passages, and those of ``least_words`` words or more go. Offsets are those of
   the original text.

Two different paragraphs share a digest with a chance of 2^-64; one alone can remove
nothing, since a passage of ``least_words`` takes several in a row.

Defined cases: a null or empty text, or one of fewer words, loses nothing (kept_text is
then the text, empty for null); a row with a null id has no rank, so it keeps all and
counts for nothing; rows that repeat an id are cut by the same digests, and the same row
twice is one occurrence; a passage twice in one document goes the second time; extra
columns pass through, and a name already taken gets a number; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from .bloom import places, suspected
from .common import batch, columns, extend_rows, own_name

PARAGRAPH_WORDS, LEAST_WORDS, WINDOW = 12, 25, 8
BITS_PER_DIGEST, MOST_WORDS_LOG2 = 16, 22

_WORD = re.compile(r"\S+")
_MARKS, _CLOSING = ".!?", "\"')]}»”’"
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Distinct words whose hashes a task keeps.
_KNOWN = 1 << 20

HELD = columns("digest bigint, doc_id bigint")
SUSPECTS = columns("digest bigint, doc_id bigint, twice boolean")
CELLS = columns("word bigint, bits bigint")


class _WordCodes(dict):
    """A word's hash, without its case, in the upper 62 bits; then whether a sentence ends with it, and its capital letter."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        ends = word[-1] in _MARKS or word[-1] in _CLOSING and word[-2:-1] in (*_MARKS,)
        self[word] = code = xxhash.xxh64_intdigest(word.lower()) & ~3 | ends << 1 | word[0].isupper()
        return code


_word_codes = _WordCodes()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def paragraphs(texts: list[str | None], size: int = PARAGRAPH_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, word behind the last, digest) of every paragraph, texts and words counted from 0."""
    words: list[str] = []
    firsts, begins = [], [0]
    for text in texts:
        for line in (text or "").split("\n"):
            if own := line.split():
                firsts.append(len(words))
                words += own
        begins.append(len(words))
    n, begins = len(words), np.array(begins, np.int64)
    codes = np.fromiter(map(_word_codes.__getitem__, words), np.uint64, n)
    hashes = codes >> np.uint64(2)
    border = np.zeros(n + 1, bool)
    border[firsts] = True
    border[begins] = True
    border[:-1] |= (codes & np.uint64(1)).astype(bool)
    border[1:] |= (codes & np.uint64(2)).astype(bool)
    if n >= WINDOW:
        windows = np.lib.stride_tricks.sliding_window_view(hashes[::-1], WINDOW)[::-1]
        chosen = np.arange(len(windows)) + WINDOW - 1 - windows.argmin(axis=1)  # of equal words the last
        inside = np.repeat(begins[1:], np.diff(begins))[:len(windows)] >= np.arange(len(windows)) + WINDOW
        border[chosen[inside]] = True
    at = np.flatnonzero(border)
    starts = at[at < n]
    starts = starts[starts + size <= begins[np.searchsorted(begins, starts, "right")]]
    ends = at[np.searchsorted(at, starts + size)]
    closes = np.unique(np.append(np.array(firsts, np.int64), begins))
    opens = at[np.maximum(np.searchsorted(at, closes - size, "right") - 1, 0)]
    whole = (closes >= size) & (opens >= begins[np.maximum(np.searchsorted(begins, closes, "left") - 1, 0)]) & (closes > opens)
    # A paragraph that either way gives is one.
    codes_of = np.unique(np.append(starts, opens[whole]) * (n + 1) + np.append(ends, closes[whole]))
    starts, ends = codes_of // (n + 1), codes_of % (n + 1)
    text_of = np.searchsorted(begins, starts, "right") - 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(_BASE, n)[:n], out=sums[1:])
    digests = (sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts]
    digests ^= digests >> np.uint64(32)
    return text_of, starts - begins[text_of], ends - begins[text_of], (digests * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _repeat_filter(repeated: DataFrame) -> np.ndarray:
    """The digests of ``repeated`` as a Bloom filter, its size set by their number up to a fixed bound."""
    words = max(1, repeated.count() * BITS_PER_DIGEST // 64)
    log2 = min(MOST_WORDS_LOG2, max(10, (words - 1).bit_length()))

    def fill(batches):
        for b in batches:
            word, bits = places(b.column(0).to_numpy().view(np.uint64), log2)
            yield batch(CELLS, [word, bits.view(np.int64)])

    cells = repeated.select("digest").mapInArrow(fill, CELLS).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << log2, np.uint64)
    table[cells.column(0).to_numpy()] = cells.column(1).to_numpy().view(np.uint64)
    return table


def repeated_paragraphs(docs: DataFrame, size: int = PARAGRAPH_WORDS) -> DataFrame:
    """(doc_id, lost, twice): the digests each document loses to another one, and those it
    keeps but holds more than once. ``docs`` has doc_id and text."""
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")

    def emit(batches):
        for b in batches:
            text_of, _, _, digests = paragraphs(b.column(1).to_pylist(), size)
            yield batch(HELD, [digests, b.column(0).to_numpy()[text_of]])

    repeated = stage(docs.mapInArrow(emit, HELD).groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                     .filter("first < last").drop("last"), "repeated-paragraphs")
    known = docs.sparkSession.sparkContext.broadcast(_repeat_filter(repeated))

    def suspects(batches):
        for b in batches:
            text_of, _, _, digests = paragraphs(b.column(1).to_pylist(), size)
            order = np.lexsort((digests, text_of))
            text_of, digests = text_of[order], digests[order]
            new = np.ones(len(order), bool)
            new[1:] = (text_of[1:] != text_of[:-1]) | (digests[1:] != digests[:-1])
            counts = np.diff(np.append(np.flatnonzero(new), len(order)))
            text_of, digests = text_of[new], digests[new]
            wanted = (counts > 1) | suspected(known.value, digests.view(np.uint64))
            yield batch(SUSPECTS, [digests[wanted], b.column(0).to_numpy()[text_of[wanted]], counts[wanted] > 1])

    joined = docs.mapInArrow(suspects, SUSPECTS).join(repeated, "digest", "left")
    lost = F.coalesce(F.col("first") != F.col("doc_id"), F.lit(False))
    return (joined.withColumn("lost", lost).filter("lost OR twice").groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("lost"), F.col("digest"))).alias("lost"),
        F.collect_set(F.when(~F.col("lost"), F.col("digest"))).alias("twice")))


def passages(text: str, lost: list[int], twice: list[int], size: int = PARAGRAPH_WORDS,
             least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Offsets of the passages that the repeated paragraphs make up."""
    _, starts, ends, digests = paragraphs([text], size)
    gone = np.isin(digests, np.array(lost, np.int64))
    again = np.isin(digests, np.array(twice, np.int64))
    first = np.zeros(len(digests), bool)
    first[np.unique(digests, return_index=True)[1]] = True
    runs: list[list[int]] = []
    for i in np.flatnonzero(gone | (again & ~first)).tolist():
        a, z = int(starts[i]), int(ends[i])
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], z)
        else:
            runs.append([a, z])
    runs = [r for r in runs if r[1] - r[0] >= least_words]
    spans = [m.span() for m in _WORD.finditer(text)] if runs else []
    return [(spans[a][0], spans[z - 1][1]) for a, z in runs]


def without(text: str, cut: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, z in cut:
        kept.append(text[at:a])
        at = z
    return "".join(kept) + text[at:]


def drop_repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                           size: int = PARAGRAPH_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """All columns of ``docs`` with kept_text, n_removed and the removed passages' starts and ends."""
    repeats = repeated_paragraphs(
        docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")), size)
    key, lost, twice = (own_name(docs, n) for n in ("repeat_id", "repeat_lost", "repeat_twice"))
    repeats = repeats.toDF(key, lost, twice)
    joined = docs.join(repeats, docs[id_column].cast("bigint") == repeats[key], "left").drop(key)

    def cut(values):
        each = [passages(t, d, w, size, least_words) if t and (d or w) else [] for t, d, w in zip(*values)]
        return None, [[without(t or "", c) for t, c in zip(values[0], each)], [len(c) for c in each],
                      [[a for a, _ in c] for c in each], [[z for _, z in c] for c in each]]

    names = [own_name(docs, n) for n in ("kept_text", "n_removed", "removed_starts", "removed_ends")]
    added = ", ".join(f"{n} {t}" for n, t in zip(names, ("string", "bigint", "bigint[]", "bigint[]")))
    return extend_rows(joined, added, [text_column, lost, twice], cut).drop(lost, twice)
