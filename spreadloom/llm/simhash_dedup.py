"""Near-duplicates by SimHash fingerprints, candidates by pigeonring chains.

A fingerprint has 64 bits, cut in a ring of ``segments``. Two fingerprints that differ in at most
``distance`` bits do not exceed a ring of equal budgets (distance / segments) in total, so
from some segment on every chain stays in budget: with five segments and four bits no difference in
the first, at most one in the first two, two in three, three in four, four in all. Only such
chains are looked for:

1. each distinct fingerprint goes to the groups (first segment, its bits), one row for each
   segment, whatever the number of copies;
2. in a group, fingerprints whose next segments stay in budget are met by binary search
   among the sorted values, one search for each way to differ, never by trying all pairs;
3. the remaining chain sums prune, the full Hamming distance confirms;
4. pairs that are already connected inside the task are passed over, so a task returns at
   most one link per fingerprint it holds: a forest, from which alternating stars make the components.

A group holds distinct fingerprints only, so a group of copies, however large, is one row.
A group of more than ``GROUP_ROWS`` is cut in blocks, and each two blocks meet in a task of their own.

``near_duplicates`` links by the fingerprint alone. ``similar_documents`` is for a similarity of word shingles:
the same chains of the fingerprints of the shingle sets come first, and the exact sets decide on what they find. At a similarity of 0.8
two fingerprints often differ in more bits than chains can search, so ``jaccard_links`` adds what minima find, decided in the same way.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and
is linked like any other; a row with a null id gets a fingerprint and the component of
its group, whose id is the smallest id that is not null; repeated ids and rows are rows
of their own; extra columns are ignored; an empty table gives no rows. ``drop_similar`` keeps all
columns; a row with a null id stays, and rows that repeat an id stay or go together.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from .common import batch, columns, partitions
from .components import Forest, connected_components
from .jaccard_links import keyed, similar_links

SEED = 42
#: Pairs held at once while a group is searched, rows at which complete groups are searched, most rows of a group.
PAIR_BLOCK, ROW_BLOCK, GROUP_ROWS = 1 << 17, 1 << 16, 1 << 20

PRINTS = columns("doc_id bigint, print bigint")
LINKS = columns("a bigint, b bigint")


class Ring:
    """Segments of 64 bits, their budgets, and how many of a chain are looked up at once."""

    def __init__(self, distance: int, segments: int, looked_up: int):
        assert distance < segments  # the first segment of a chain then has no difference
        self.distance, self.n = distance, segments
        cuts = [64 * i // segments for i in range(segments + 1)]
        self.widths = [b - a for a, b in zip(cuts, cuts[1:])]
        self.lows = [64 - b for b in cuts[1:]]
        self.budgets = [length * distance // segments for length in range(1, segments + 1)]
        self.looked_up = looked_up

    def chain(self, start: int) -> list[tuple[int, int]]:
        """(lowest bit, width) of the segments from ``start`` on."""
        at = [(start + i) % self.n for i in range(self.n)]
        return [(self.lows[i], self.widths[i]) for i in at]

    def ways(self, start: int) -> list[int]:
        """Every difference of the looked up part that stays in budget, as bits of the part's key."""
        found = [(0, 0)]
        for (_, width), budget in list(zip(self.chain(start), self.budgets))[1:self.looked_up]:
            single = [0] + [sum(1 << b for b in bits) for k in range(1, budget + 1) for bits in combinations(range(width), k)]
            found = [(way << width | x, used + x.bit_count()) for way, used in found for x in single if used + x.bit_count() <= budget]
        return [way for way, _ in found]


EXACT = Ring(4, 5, 2)
WIDE = Ring(8, 10, 3)
FINE_BITS, FINE_DISTANCE = 256, 50


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, repeats included; of the whole sequence if it is shorter."""
    # bytes.lower touches A-Z only, bytes.split cuts at \x20 and \x09-\x0D only.
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(parts), len(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, n)
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:z], SEED)
                        for a, z in zip(starts[:n - k + 1].tolist(), ends[k - 1:].tolist())), np.uint64, n - k + 1)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half the hashes, as 64-bit words; ``hashes`` has a row each."""
    rows = hashes.reshape(len(hashes), -1).astype("<u8")
    ones = np.zeros(64 * rows.shape[1], np.int64)
    for i in range(0, len(rows), 1 << 14):
        part = np.unpackbits(rows[i:i + (1 << 14)].view(np.uint8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return np.packbits((2 * ones > len(rows)).astype(np.uint8), bitorder="little").view("<u8")


def fingerprint(text: str | None, words: int = 4) -> int:
    hashes = shingle_hashes(text, words)
    return int(majority(hashes)[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, print): the fingerprint of each whole text as a signed long. No shuffle."""

    def run(batches):
        for b in batches:
            values = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield batch(PRINTS, [b.column(0).cast("int64"), values.view(np.int64)])

    return docs.select(id_column, text_column).mapInArrow(run, PRINTS)


def search(start: int, prints: np.ndarray, forest: Forest, rows: np.ndarray, ring: Ring, fine: np.ndarray | None = None) -> None:
    """Chains that begin at segment ``start``, among fingerprints of any groups of that segment.

    ``rows`` are the fingerprints' numbers in the forest, ``fine`` their confirming bits by row number.
    """
    chain = ring.chain(start)
    key = np.zeros(len(prints), np.uint64)
    for low, width in chain[:ring.looked_up]:
        key = key << np.uint64(width) | (prints >> np.uint64(low)) & np.uint64((1 << width) - 1)
    masks = [np.uint64(((1 << width) - 1) << low) for low, width in chain]
    order = np.argsort(key, kind="stable")
    prints, rows = prints[order], rows[order]
    keys, begins, counts = np.unique(key[order], return_index=True, return_counts=True)
    for way in ring.ways(start):
        if way == 0:
            one = two = np.flatnonzero(counts > 1)
        else:
            one = np.flatnonzero(keys ^ np.uint64(way) > keys)  # each two keys once
            other = keys[one] ^ np.uint64(way)
            two = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
            met = keys[two] == other
            one, two = one[met], two[met]
        total = np.concatenate(([0], np.cumsum(counts[one] * counts[two])))
        for at in range(0, int(total[-1]), PAIR_BLOCK):
            stop = min(at + PAIR_BLOCK, int(total[-1]))
            i, j = np.searchsorted(total, [at, stop - 1], "right") - 1
            pair = np.repeat(np.arange(i, j + 1), np.minimum(total[i + 1:j + 2], stop) - np.maximum(total[i:j + 1], at))
            nth, wide = np.arange(at, stop) - total[pair], counts[two[pair]]
            a, b = begins[one[pair]] + nth // wide, begins[two[pair]] + nth % wide
            if way == 0:
                a, b = a[a < b], b[a < b]
            apart = forest.label[rows[a]] != forest.label[rows[b]]
            a, b = a[apart], b[apart]
            differs, so_far = prints[a] ^ prints[b], np.zeros(len(a), np.int64)
            for mask, budget in zip(masks, ring.budgets):
                so_far += np.bitwise_count(differs & mask)
                good = so_far <= budget
                if not good.all():
                    a, b, differs, so_far = a[good], b[good], differs[good], so_far[good]
            if fine is not None and len(a):
                good = np.bitwise_count(fine[rows[a]] ^ fine[rows[b]]).sum(axis=1) <= FINE_DISTANCE
                a, b = a[good], b[good]
            if len(a):
                forest.add(rows[a], rows[b])


def _links(ring: Ring, with_fine: bool):
    """Forest links of sorted (group, print, node[, fine]) rows; groups are kept whole."""
    def flush(blocks):
        group, prints, node = (np.concatenate(x) for x in list(zip(*blocks))[:3])
        fine = np.concatenate([b[3] for b in blocks]) if with_fine else None
        forest = Forest(len(node))
        prints = prints.view(np.uint64)
        # Equal numbers of a segment stand together; blocks of one group are searched apart.
        segment = (group >> 32) // (1 << 16)
        part = group & 0xFFFFFFFF
        for start, own in np.unique(np.stack([segment, part], axis=1), axis=0).tolist():
            rows = np.flatnonzero((segment == start) & (part == own))
            search(start, prints[rows], forest, rows, ring, fine)
        if forest.links:
            ends = np.array(forest.links)
            return batch(LINKS, [node[ends[:, 0]], node[ends[:, 1]]])

    def run(batches):
        held, size = [], 0
        for b in batches:
            row = [b.column(i).to_numpy() for i in range(3)]
            if with_fine:
                row.append(np.frombuffer(b"".join(b.column(3).to_pylist()), "<u8").reshape(-1, FINE_BITS // 64))
            held.append(row)
            size += b.num_rows
            if size >= ROW_BLOCK:
                whole = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))
                if cut and (links := flush([[x[:cut] for x in whole]])) is not None:
                    yield links
                held = [[x[cut:] for x in whole]]
                size = 0 if cut else -len(whole[0])  # a large group waits for its end
        if held and sum(len(x[0]) for x in held) and (links := flush(held)) is not None:
            yield links

    return run


def near_links(prints: DataFrame, ring: Ring = EXACT) -> DataFrame:
    """Links (a, b) between nodes of near fingerprints, enough to connect all that are linked.

    ``prints``: columns node and print, no pair of nodes with all bits alike, and fine if that must agree too.
    """
    with_fine = ["fine"] if "fine" in prints.columns else []
    groups = F.array(*[
        F.lit(i << 16) + F.shiftrightunsigned("print", ring.lows[i]).bitwiseAND(F.lit((1 << ring.widths[i]) - 1))
        for i in range(ring.n)])
    rows = prints.filter("node IS NOT NULL").select(F.explode(groups).alias("chain"), "print", "node", *with_fine)
    sizes = rows.groupBy("chain").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other))
    dealt = rows.join(sizes, "chain").select("chain", F.explode(meets).alias("part"), "print", "node", *with_fine).withColumn(
        "group", F.shiftleft(F.col("chain").cast("bigint"), 32) + F.col("part")).select("group", "print", "node", *with_fine)
    return (dealt.repartition(partitions(prints), "group").sortWithinPartitions("group")
            .mapInArrow(_links(ring, bool(with_fine)), LINKS))


def near_duplicates(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row of ``docs``."""
    prints = stage(fingerprints(docs, words, id_column, text_column), "prints")
    kinds = stage(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    groups = connected_components(near_links(kinds.select(F.col("print").alias("node"), "print")))
    label = F.coalesce("component", "print")
    kinds = kinds.join(groups.withColumnRenamed("node", "print"), "print", "left").select("print", "first_id", label.alias("label"))
    least = kinds.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_print = kinds.join(least, "label").select("print", "component_id")
    return prints.join(of_print, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def print_of(hashes: np.ndarray) -> int:
    return int(majority(hashes).view(np.int64)[0]) if len(hashes) else 0


def near_sets(kinds: DataFrame) -> DataFrame:
    """Links (a, b) of nodes whose prints are equal or near. ``kinds``: (node, print), each node once.

    Nodes of one print are joined to the least of them, and that one stands for the print in the search.
    """
    heads = stage(kinds.groupBy("print").agg(F.min("node").alias("head")), "print-heads")
    equal = kinds.join(heads, "print").filter("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return equal.unionByName(near_links(heads.select(F.col("head").alias("node"), "print"))).distinct()


def similar_documents(docs: DataFrame, words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, component_id): documents whose sets of shingles of ``words`` words have a similarity of 0.8 or more, by components."""
    def shingle_set(text):
        return np.unique(shingle_hashes(text, words))

    given = docs.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    prints = stage(keyed(given, shingle_set, print_of), "prints")
    kinds = stage(prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("print", "size", "keys", "minima")]),
                  "distinct-sets")
    groups = connected_components(similar_links(given, kinds, shingle_set, near_sets(kinds)))
    labels = stage(kinds.join(groups, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("label")), "labels")
    least = labels.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_node = labels.join(least, "label").select("node", "component_id")
    return prints.join(of_node, "node").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, without those that a smaller id of their component stands for."""
    extra = (similar_documents(docs, words, id_column, text_column).filter("doc_id != component_id")
             .select(F.col("doc_id").alias("copied_id")).distinct())
    return docs.join(extra, docs[id_column].cast("bigint") == extra.copied_id, "left_anti")
