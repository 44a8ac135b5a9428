"""A pair of Bloom filters of fixed size: what was seen once, and what was seen again.

Both filters are tables of 64-bit words. A hash sets ``BITS`` bits of one word, so a
filter is a sparse table (word, bits): tasks fill their own, equal words are merged by OR,
and a bit that two tasks have set moves to the second filter. No value seen twice is ever
missed; a value seen once is suspected as seldom as the size allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import batch, columns, partitions

BITS = 4
#: 2**21 words are 16 MiB: the bound of what is gathered and broadcast, whatever the corpus.
WORDS_LOG2 = 21
#: Hashes a task gathers before it empties them in the sparse table.
HELD = 1 << 20

CELLS = columns("word bigint, once bigint, again bigint")


def places(hashes: np.ndarray, words_log2: int = WORDS_LOG2) -> tuple[np.ndarray, np.ndarray]:
    """The word of each hash, and its bits there."""
    word = hashes >> np.uint64(64 - words_log2)
    bits = np.zeros(len(hashes), np.uint64)
    for i in range(BITS):
        bits |= np.uint64(1) << (hashes >> np.uint64(6 * i)) % np.uint64(64)
    return word.astype(np.int64), bits


def merge(word: np.ndarray, once: np.ndarray, again: np.ndarray):
    """Rows of equal words as one each; bits set by two of them are set again."""
    order = np.argsort(word, kind="stable")
    word, once, again = word[order], once[order], again[order]
    while len(word) and (same := word[1:] == word[:-1]).any():
        # Neighbours at an even place of their run take in the one behind them.
        begins = np.flatnonzero(np.concatenate(([True], ~same)))
        place = np.arange(len(word)) - np.repeat(begins, np.diff(np.append(begins, len(word))))
        left = np.flatnonzero((place[:-1] % 2 == 0) & same)
        again[left] |= again[left + 1] | (once[left] & once[left + 1])
        once[left] |= once[left + 1]
        keep = np.ones(len(word), bool)
        keep[left + 1] = False
        word, once, again = word[keep], once[keep], again[keep]
    return word, once, again


class Sketch:
    """The filters of one task. Hashes of one ``add`` call are those of one document, each once."""

    def __init__(self, words_log2: int = WORDS_LOG2):
        self.log2, self.parts, self.size = words_log2, [], 0
        self.cells = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))

    def add(self, hashes: np.ndarray) -> None:
        self.parts.append(hashes)
        self.size += len(hashes)
        if self.size >= HELD:
            self.settle()

    def settle(self) -> None:
        if self.parts:
            word, bits = places(np.concatenate(self.parts), self.log2)
            own = merge(word, bits, np.zeros(len(bits), np.uint64))
            self.cells = merge(*(np.concatenate(pair) for pair in zip(self.cells, own)))
            self.parts, self.size = [], 0


def sketch_cells(docs: DataFrame, hashes_of, words_log2: int = WORDS_LOG2) -> DataFrame:
    """The merged filters of all rows as a sparse table; ``hashes_of``: an Arrow batch to hash arrays."""

    def fill(batches):
        sketch = Sketch(words_log2)
        for b in batches:
            for hashes in hashes_of(b):
                sketch.add(hashes)
        sketch.settle()
        word, once, again = sketch.cells
        for i in range(0, len(word), 1 << 17):
            yield batch(CELLS, [word[i:i + (1 << 17)], *(x[i:i + (1 << 17)].view(np.int64) for x in (once, again))])

    def join(batches):
        cells, held, size = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)), [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), *(b.column(i).to_numpy().view(np.uint64) for i in (1, 2))))
            size += b.num_rows
            if size >= HELD:
                cells, held, size = merge(*(np.concatenate(x) for x in zip(cells, *held))), [], 0
        word, once, again = merge(*(np.concatenate(x) for x in zip(cells, *held)))
        kept = again != 0
        yield batch(CELLS, [word[kept], once[kept].view(np.int64), again[kept].view(np.int64)])

    return (docs.mapInArrow(fill, CELLS).repartition(partitions(docs), "word").mapInArrow(join, CELLS))


def second_filter(cells: DataFrame, words_log2: int = WORDS_LOG2) -> np.ndarray:
    """The second filter as words. Its size is fixed by ``words_log2``, not by the data."""
    out = np.zeros(1 << words_log2, np.uint64)
    rows = cells.select("word", "again").toArrow()
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out


def suspected(again: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    word, bits = places(hashes, len(again).bit_length() - 1)
    return (again[word] & bits) == bits
