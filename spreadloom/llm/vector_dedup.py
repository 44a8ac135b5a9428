"""Embedding near-dedup by NN-descent, with exact counts where lists are saturated.

Vectors are compared only inside a label, by cosine in double precision.

1. Equal vectors of a label are one class, with its number of copies: a group of copies,
   however large, is one row from here on.
2. The first neighbour graph comes from random hyperplane trees: vectors of one leaf are
   compared in a block, each keeps its ``k`` nearest.
3. NN-descent: the neighbours and reverse neighbours of each vector are joined with their
   vectors and compared with each other; whoever is nearer than a list's last enters the
   list. This is repeated until fewer than ``still`` of the entries change. Very popular
   vectors have their reverse neighbours dealt over several groups.
4. Every block also returns a forest of its pairs at or above the threshold, so what is
   connected there stays connected although lists are short.
5. A list is saturated if its last entry still reaches the threshold. Such a list is
   enlarged to the vector's whole component: blocks of the component are compared, and
   each returns a count per vector, never the pairs.
6. Audit: a bounded sample of vectors is compared with all vectors of their labels by brute force. If
   less than ``recall`` of their links are found, new trees and another descent follow, the graph so far being kept.
   If that does not help ``MOST_AUDITS`` times, the labels of which links are missing are finished exactly: all
   pairs of blocks of such a label are compared, and each returns counts and a forest.

Defined cases: a vector that is null, empty or zero, or holds a null or a number that is not finite, or whose
label or id is null, links with nothing: n_links 0, its own component (null, and not kept,
for a null id). Vectors of different length are not compared. Rows that repeat an id are
rows of their own: equal ones link with each other. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..staging import stage
from .common import batch, bound_batches, columns, numbers, partitions, sorted_groups, vectors
from .components import Forest, connected_components

LEAST_COSINE = 0.93
NEIGHBOURS, TREES, LEAF, MOST_BITS = 10, 4, 256, 24
#: Rows compared in one block; rows of a component block; reverse neighbours in one group.
BLOCK, COMPONENT_BLOCK, POPULAR = 4096, 256, 256
MOST_DESCENTS, STILL = 4, 0.02
AUDIT_ROWS, RECALL, MOST_AUDITS = 1000, 0.995, 4

EDGES = columns("src bigint, dst bigint, cosine double, forest boolean")


def usable(vector: str = "embedding", label: str = "label", key: str = "vec_id"):
    v = F.col(vector)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.col(key).isNotNull() & F.col(label).isNotNull() & F.forall(v, number) & F.exists(v, lambda x: x != 0),
                      F.lit(False))


def _compare(ids: np.ndarray, unit: np.ndarray, k: int, least: float, bar: np.ndarray | None = None):
    """Each row's ``k`` nearest others that beat its bar, and a forest of the pairs at or above ``least``."""
    n = len(ids)
    forest, found = Forest(n), []
    if n < 2:
        return None
    for a in range(0, n, 512):
        cosine = unit[a:a + 512] @ unit.T
        rows = np.arange(len(cosine))
        cosine[rows, rows + a] = -2
        i, j = np.nonzero(cosine >= least)
        apart = forest.label[i + a] != forest.label[j]
        if apart.any():
            forest.add(i[apart] + a, j[apart])
        m = min(k, n - 1)
        best = np.argpartition(-cosine, m - 1, axis=1)[:, :m]
        value = np.take_along_axis(cosine, best, axis=1)
        good = np.ones(value.shape, bool) if bar is None else value > bar[a:a + 512, None]
        found.append((np.repeat(rows + a, m).reshape(-1, m)[good], best[good], value[good]))
    src, dst, cosine = (np.concatenate(x) for x in zip(*found))
    tied = np.array(forest.links, np.int64).reshape(-1, 2)
    src, dst = np.concatenate((ids[src], ids[tied[:, 0]])), np.concatenate((ids[dst], ids[tied[:, 1]]))
    cosine = np.concatenate((cosine, (unit[tied[:, 0]] * unit[tied[:, 1]]).sum(axis=1)))
    return batch(EDGES, [src, dst, cosine, np.arange(len(src)) >= len(src) - len(tied)])


def _tree_edges(kinds: DataFrame, first_tree: int, trees: int, k: int, least: float) -> DataFrame:
    """Edges among the vectors of equal leaves. A leaf's depth follows the number of vectors of its label."""
    size = kinds.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    bits = F.least(F.lit(MOST_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF)))).cast("int")
    deep = kinds.join(size, ["label", "dim"]).select("label", "dim", bits.alias("bits"), "rep", "embedding")
    leaves = columns("label bigint, tree int, leaf bigint, rep bigint, embedding double[]")

    def plant(batches):
        planes = {}
        for b in batches:
            label, dim, bits, rep = (b.column(i).to_numpy() for i in range(4))
            for d in np.unique(dim).tolist():
                own = np.flatnonzero(dim == d)
                unit = vectors([b.take(own)], 4)
                for tree in range(first_tree, first_tree + trees):
                    if (tree, d) not in planes:
                        planes[tree, d] = np.random.default_rng([42, tree, d]).standard_normal((MOST_BITS, d))
                    sides = (unit @ planes[tree, d].T > 0) & (np.arange(MOST_BITS) < bits[own, None])
                    leaf = (sides * (1 << np.arange(MOST_BITS, dtype=np.int64))).sum(axis=1) + (d << MOST_BITS)
                    yield batch(leaves, [label[own].astype(np.int64), np.full(len(own), tree, np.int32), leaf, rep[own], list(unit)])

    def compare(batches):
        for _, slices in sorted_groups(batches, 3, BLOCK):
            if (edges := _compare(numbers(slices, 3), vectors(slices, 4), k, least)) is not None:
                yield edges

    return (deep.mapInArrow(plant, leaves).repartition(partitions(kinds), "label", "tree", "leaf")
            .sortWithinPartitions("label", "tree", "leaf").mapInArrow(compare, EDGES))


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """Each vector's ``k`` nearest of all edges given; ``old`` tells entries that were in a list before."""
    both = edges.groupBy("src", "dst").agg(F.max("cosine").alias("cosine"), F.max("old").alias("old"))
    order = Window.partitionBy("src").orderBy(F.desc("cosine"), "dst")
    return both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "cosine").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cosine"))


def _neighbour_joins(lists: DataFrame, kinds: DataFrame, k: int, least: float) -> DataFrame:
    """Edges among the neighbours and reverse neighbours of each vector."""
    popular = lists.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    backward = lists.join(popular, "dst").select(
        F.col("dst").alias("hub"), F.col("src").alias("member"),
        F.pmod(F.xxhash64("src"), F.ceil(F.col("n") / POPULAR)).cast("int").alias("part"))
    forward = lists.select(F.col("src").alias("hub"), F.col("dst").alias("member"), F.lit(0).alias("part"))
    bars = lists.groupBy("src").agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).otherwise(-2.0).alias("bar"))
    members = kinds.join(bars, kinds.rep == bars.src).select(F.col("rep").alias("member"), "bar", "embedding")
    joined = forward.unionByName(backward).distinct().join(members, "member").select("hub", "part", "member", "bar", "embedding")

    def compare(batches):
        for _, slices in sorted_groups(batches, 2, BLOCK):
            if (edges := _compare(numbers(slices, 2), vectors(slices, 4), k, least, numbers(slices, 3))) is not None:
                if edges.num_rows:
                    yield edges

    return (joined.repartition(partitions(kinds), "hub", "part").sortWithinPartitions("hub", "part").mapInArrow(compare, EDGES))


def _split(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (edges.filter("NOT forest").select("src", "dst", "cosine", F.lit(0).alias("old")),
            edges.filter("forest").select("src", "dst", "cosine"))


def _descend(kinds: DataFrame, lists: DataFrame | None, ties: DataFrame | None, first_tree: int, k: int, least: float):
    """New trees on top of what is known, then neighbour joins until little changes."""
    grown = stage(_tree_edges(kinds, first_tree, TREES, k, least), "tree-edges")
    near, new_ties = _split(grown)
    ties = new_ties if ties is None else ties.unionByName(new_ties)
    lists = stage(_lists(near if lists is None else near.unionByName(lists.withColumn("old", F.lit(1))), k), "neighbours")
    for _ in range(MOST_DESCENTS):
        step = stage(_neighbour_joins(lists, kinds, k, least), "neighbour-edges")
        near, new_ties = _split(step)
        ties = ties.unionByName(new_ties)
        lists = stage(_lists(_both_ways(near).withColumn("old", F.lit(0)).unionByName(
            lists.withColumn("old", F.lit(1))), k), "neighbours")
        changed, entries = lists.agg(F.coalesce(F.sum(1 - F.col("old")), F.lit(0)), F.count(F.lit(1))).first()
        if changed <= STILL * entries:
            break
    return lists, ties


def _degrees(kinds: DataFrame, lists: DataFrame, ties: DataFrame, k: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(rep, degree), counting copies of other classes, and (node, component)."""
    links = stage(_both_ways(lists.filter(F.col("cosine") >= least)).unionByName(_both_ways(ties))
                  .select("src", "dst").distinct(), "links")
    parts = stage(connected_components(links.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "components")
    full = stage(lists.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("last"))
                 .filter((F.col("n") >= k) & (F.col("last") >= least)).select(F.col("src").alias("rep")), "saturated")
    listed = (links.join(full, links.src == full.rep, "left_anti").join(kinds.select(F.col("rep").alias("dst"), "copies"), "dst")
              .groupBy(F.col("src").alias("rep")).agg(F.sum("copies").alias("degree")))

    where = parts.select(F.col("node").alias("rep"), "component")
    asked = where.join(full.withColumn("asks", F.lit(True)), "rep", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    sizes = asked.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("any")).filter("any").drop("any")
    held = (asked.join(sizes, "component").join(kinds.select("rep", "embedding", "copies"), "rep")
            .withColumn("blocks", F.ceil(F.col("n") / COMPONENT_BLOCK).cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asking = held.filter("asks").select("component", F.col("block").alias("i"), every.alias("j"), F.lit(1).alias("asks"), "rep", "copies", "embedding")
    answering = held.select("component", every.alias("i"), F.col("block").alias("j"), F.lit(0).alias("asks"), "rep", "copies", "embedding")
    counts = columns("rep bigint, degree bigint")

    def count(batches):
        for _, slices in sorted_groups(batches, 3, 1 << 30):  # two blocks of a component
            asks, ids, copies, unit = numbers(slices, 3), numbers(slices, 4), numbers(slices, 5), vectors(slices, 6)
            a, b = np.flatnonzero(asks == 1), np.flatnonzero(asks == 0)
            near = (unit[a] @ unit[b].T >= least) & (ids[a][:, None] != ids[b][None, :])
            yield batch(counts, [ids[a], near @ copies[b].astype(np.int64)])

    whole = (asking.unionByName(answering).repartition(partitions(kinds), "component", "i", "j")
             .sortWithinPartitions("component", "i", "j").mapInArrow(count, counts)
             .groupBy("rep").agg(F.sum("degree").alias("degree")))
    return stage(listed.unionByName(whole), "degrees"), parts


def audit(kinds: DataFrame, degrees: DataFrame, least: float, rows: int = AUDIT_ROWS, round_: int = 0) -> tuple[float, list[int]]:
    """Share of the sampled vectors' links that were found, and the labels of which some were not. The sample is of about ``rows`` classes, whatever the table."""
    total = kinds.count()
    share = min(1.0, rows / max(1, total))
    picked = kinds.filter(F.pmod(F.xxhash64("rep", F.lit(round_)), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = picked.select("rep", "label", "dim", "embedding").toArrow().to_batches()
    sample = [b for b in sample if b.num_rows]
    if not sample:
        return 1.0, []
    ids, labels, dims = (numbers(sample, i) for i in range(3))
    asked = [(int(d), np.flatnonzero(dims == d)) for d in np.unique(dims)]
    units = {d: vectors([b.filter(b.column(2).to_numpy() == d) for b in sample], 3) for d, _ in asked}
    shared = kinds.sparkSession.sparkContext.broadcast((ids, labels, asked, units))
    counts = columns("rep bigint, links bigint")

    def count(batches):
        ids, labels, asked, units = shared.value
        found = np.zeros(len(ids), np.int64)
        for b in batches:
            rep, label, dim, copies = (b.column(i).to_numpy() for i in range(4))
            for d, at in asked:
                own = np.flatnonzero(dim == d)
                if len(own):
                    near = (units[d] @ vectors([b.take(own)], 4).T >= least) & (labels[at][:, None] == label[own][None, :])
                    near &= ids[at][:, None] != rep[own][None, :]
                    found[at] += near @ copies[own].astype(np.int64)
        yield batch(counts, [ids, found])

    true = kinds.select("rep", "label", "dim", "copies", "embedding").mapInArrow(count, counts).groupBy("rep").agg(F.sum("links").alias("links"))
    label_of = dict(zip(ids.tolist(), labels.tolist()))
    # A row per sampled class.
    got = [(r.rep, r.links, min(r.links, r.degree)) for r in true.join(degrees, "rep", "left").na.fill(0, ["degree"]).collect()]
    links = sum(n for _, n, _ in got)
    return sum(m for *_, m in got) / links if links else 1.0, sorted({label_of[rep] for rep, n, m in got if m < n})


def _exact(kinds: DataFrame, labels: list[int], least: float) -> tuple[DataFrame, DataFrame]:
    """(rep, degree) of all classes of the labels and links that hold their components together, by all pairs of blocks."""
    sizes = kinds.filter(F.col("label").isin(labels)).groupBy("label", "dim").agg(
        F.ceil(F.count(F.lit(1)) / COMPONENT_BLOCK).cast("int").alias("blocks"))
    own = (kinds.filter(F.col("label").isin(labels)).join(stage(sizes, "exact-sizes"), ["label", "dim"])
           .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = own.withColumn("other", other).select(
        "label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies", "embedding")
    out = columns("rep bigint, degree bigint, a bigint, b bigint")

    def compare(batches):
        for (_, _, i, j), slices in sorted_groups(batches, 4, 1 << 30):  # two blocks of a label
            block, ids, copies, unit = numbers(slices, 4), numbers(slices, 5), numbers(slices, 6), vectors(slices, 7)
            near = unit @ unit.T >= least
            near &= ids[:, None] != ids[None, :]
            if i != j:
                near &= block[:, None] != block[None, :]
            forest = Forest(len(ids))
            forest.add(*np.nonzero(near))
            tied = np.array(forest.links, np.int64).reshape(-1, 2)
            none = [None] * len(ids)
            yield batch(out, [ids, near @ copies.astype(np.int64), none, none])
            yield batch(out, [[None] * len(tied), [None] * len(tied), ids[tied[:, 0]], ids[tied[:, 1]]])

    found = stage(paired.repartition(partitions(kinds), "label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j")
                  .mapInArrow(compare, out), "exact-pairs")
    return (found.filter("rep IS NOT NULL").groupBy("rep").agg(F.sum("degree").alias("degree")),
            found.filter("a IS NOT NULL").select("a", "b"))


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 least: float = LEAST_COSINE, k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table``."""
    bound_batches(table.sparkSession)
    given = table.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"),
                         F.col(label).cast("bigint").alias("label"))
    good = given.filter(usable())
    # A class has a number of its own, since one id may stand at different vectors; once written it stays.
    kinds = stage(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
                  .withColumn("rep", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding").cast("bigint")), "vector-kinds")
    lists = ties = None
    for round_ in range(MOST_AUDITS):
        lists, ties = _descend(kinds, lists, ties, round_ * TREES, k, least)
        degrees, parts = _degrees(kinds, lists, ties, k, least)
        share, missing = audit(kinds, degrees, least, round_=round_)
        if share >= recall:
            break
    else:
        whole, links = _exact(kinds, missing, least)
        others = kinds.filter(~F.col("label").isin(missing)).select("rep")
        degrees = stage(degrees.join(others, "rep", "left_semi").unionByName(whole), "degrees")
        parts = stage(connected_components(links.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))), "components")
    parts = parts.withColumnRenamed("node", "rep")
    names = stage(parts.join(kinds.select("rep", "first"), "rep").groupBy("component").agg(F.min("first").alias("least_id")), "component-ids")
    facts = stage(kinds.join(degrees, "rep", "left").join(parts.join(names, "component"), "rep", "left").select(
        "label", "embedding", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("least_id", "first").alias("component_id")), "vector-facts")
    linked = good.join(facts, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = given.filter(~usable()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
