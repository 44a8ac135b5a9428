"""Links between texts whose sets of word shingles have a Jaccard similarity of ``LEAST`` or more.

Equal sets are one node, named by the hash of its set. A node has ``BANDS`` keys, each of ``DEEP`` minima of its
shingles under that many hash functions. Two sets of similarity s share a key with chance
1 - (1 - s ** DEEP) ** BANDS, which is 0.99993 at 0.8, whatever the kind of edit. Only nodes with a shared key go on:

1. the least and the greatest node of each key are compared with all that have it, which is linear
   in the number of nodes, however large a group of copies is;
2. where that leaves a key with nodes of several components, the sets of its nodes meet, and pairs of different
   components are compared whose minima do not rule out ``LEAST`` (``CLOSE_MINIMA`` is over five deviations below it).
   What is found similar is one component from there on, so a key gives fewer links than it has nodes, and no pair is
   written. A key of more than ``KEY_ROWS`` such nodes is cut in blocks, and each two blocks meet in a task of their own.

Fingerprints (``simhash_dedup``) and minima only propose. Each proposed pair is decided by the exact similarity of the two sets, so no link is below ``LEAST``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from .common import batch, columns, numbers, partitions, sorted_groups
from .components import connected_components

LEAST = 0.8
BANDS, DEEP = 24, 5
CLOSE_MINIMA, KEY_ROWS = 0.6, 2048
#: Hashes whose minima are taken at once.
HELD = 1 << 12

SETS = columns("node bigint, shingles binary")
KEYS = columns("doc_id bigint, node bigint, print bigint, size bigint, keys bigint[], minima binary")
PAIRS = columns("a bigint, b bigint")

_mixers = np.random.default_rng(42)
_SHIFTS = _mixers.integers(0, 1 << 32, (BANDS * DEEP, 1), dtype=np.uint32)
_FACTORS = _mixers.integers(0, 1 << 32, (BANDS * DEEP, 1), dtype=np.uint32) | np.uint32(1)


def node_of(shingles: np.ndarray) -> int:
    """The name of a set, a signed long; ``shingles`` are its sorted distinct hashes."""
    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >> 63 else value


def minima_of(shingles: np.ndarray) -> np.ndarray:
    low, least = shingles.astype(np.uint32), np.full(BANDS * DEEP, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), HELD):
        x = (low[i:i + HELD] ^ _SHIFTS) * _FACTORS
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def keys_of(minima: np.ndarray) -> np.ndarray:
    """A signed long for each band: its number and its minima, mixed."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in minima.reshape(BANDS, DEEP).T.astype(np.uint64):
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``LEAST`` or more."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= LEAST * (len(both) - shared)


def keyed(docs: DataFrame, shingle_set, print_of) -> DataFrame:
    """(doc_id, node, print, size, keys, minima) of each text; an empty set has no keys. ``docs`` has doc_id and text.

    ``print_of`` gives the fingerprint of a set, a signed long.
    """
    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shingles = shingle_set(text)
                minima = minima_of(shingles)
                rows.append((doc_id, node_of(shingles), print_of(shingles), len(shingles), keys_of(minima).tolist() if len(shingles) else [],
                             minima.astype(np.uint8).tobytes()))
            if rows:
                yield batch(KEYS, list(zip(*rows)))

    return docs.select("doc_id", "text").mapInArrow(run, KEYS)


def sets_of(docs: DataFrame, wanted: DataFrame, shingle_set) -> DataFrame:
    """(node, shingles) of the ``wanted`` (node, first_id), each once."""
    def run(batches):
        for b in batches:
            rows = []
            for text, node in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shingles = shingle_set(text)
                if node_of(shingles) == node:  # ids may repeat with other texts
                    rows.append((node, shingles.tobytes()))
            if rows:
                yield batch(SETS, list(zip(*rows)))

    texts = docs.join(wanted, F.col("doc_id") == F.col("first_id")).select("text", "node")
    return texts.mapInArrow(run, SETS).groupBy("node").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sets are similar."""
    def run(batches):
        for b in batches:
            one, two = (b.column(i).to_pylist() for i in (2, 3))
            good = [i for i, (x, y) in enumerate(zip(one, two)) if similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))]
            yield batch(PAIRS, [b.column(i).take(good) if good else [] for i in (0, 1)])

    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "a_set", "b_set").mapInArrow(run, PAIRS)


def _sizes_allow(one, two):
    return F.least(one, two) >= F.lit(LEAST) * F.greatest(one, two)


def _close_links(batches):
    """Links that join components among rows (key, part, node, size, label, minima, shingles) sorted by key and part."""
    # A part holds two blocks at most; those are random halves, but a batch bound may not cut them.
    for _, slices in sorted_groups(batches, 2, 1 << 62):
        node, size, label = (numbers(slices, i).copy() for i in (2, 3, 4))
        minima = np.frombuffer(b"".join(m for s in slices for m in s.column(5).to_pylist()), np.uint8).reshape(len(node), -1)
        sets = [np.frombuffer(x, np.uint64) for s in slices for x in s.column(6).to_pylist()]
        ties = []
        for i in range(len(node) - 1):
            other = i + 1 + np.flatnonzero(label[i + 1:] != label[i])
            other = other[np.minimum(size[other], size[i]) >= LEAST * np.maximum(size[other], size[i])]
            other = other[(minima[other] == minima[i]).mean(axis=1) >= CLOSE_MINIMA]
            for j in other.tolist():
                if label[j] != label[i] and similar(sets[i], sets[j]):
                    ties.append((min(node[i], node[j]), max(node[i], node[j])))
                    label[label == label[j]] = label[i]
        if ties:
            yield batch(PAIRS, list(zip(*ties)))


def similar_links(docs: DataFrame, kinds: DataFrame, shingle_set, near: DataFrame) -> DataFrame:
    """Links (a, b) that connect all similar nodes. ``kinds``: (node, first_id, size, keys, minima), each node once.

    ``near`` (a, b): pairs of nodes with near fingerprints, confirmed with the first stars.
    """
    held = kinds.select(F.explode("keys").alias("key"), "node", "size")
    ends = stage(held.groupBy("key").agg(F.min(F.struct("node", "size")).alias("low"), F.max(F.struct("node", "size")).alias("high"))
                 .filter("low.node != high.node"), "shared-keys")
    members = stage(held.join(ends, "key"), "key-members")
    ends_of = [kinds.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size")) for side in "ab"]
    near = stage(near.join(ends_of[0], "a").join(ends_of[1], "b").filter(_sizes_allow(F.col("a_size"), F.col("b_size")))
                 .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "near-prints")
    compared = members.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node")))
    wanted = compared.distinct().join(kinds.select("node", "first_id"), "node")
    sets = stage(sets_of(docs, stage(wanted, "compared"), shingle_set), "shingle-sets")

    stars = [members.filter(F.col(f"{end}.node") != F.col("node")).filter(_sizes_allow(F.col(f"{end}.size"), F.col("size")))
             .select(F.least(f"{end}.node", "node").alias("a"), F.greatest(f"{end}.node", "node").alias("b")) for end in ("low", "high")]
    stars = stage(near.unionByName(stars[0]).unionByName(stars[1]).distinct(), "star-pairs")
    links = stage(confirmed(stars, sets), "star-links")

    labels = members.select("key", "node", "size").join(connected_components(links), "node", "left").select(
        "key", "node", "size", F.coalesce("component", "node").alias("label"))
    labels = stage(labels, "key-labels")
    mixed = (labels.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
             .filter("low != high").select("key", F.ceil(F.col("n") / KEY_ROWS).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other))
    dealt = (labels.join(mixed, "key").join(kinds.select("node", "minima"), "node").join(sets, "node")
             .select("key", F.explode(meets).alias("part"), "node", "size", "label", "minima", "shingles"))
    close = (dealt.repartition(partitions(kinds), "key", "part").sortWithinPartitions("key", "part")
             .mapInArrow(_close_links, PAIRS).distinct())
    return links.unionByName(stage(close, "close-links"))
