"""Exact nearest-neighbour pairs of symbol vectors, per fold, with tiles that can't matter left out.

1. ``PIVOTS`` vectors of each fold, those of the least name hashes, are pivots; every
   vector learns its distance to each. Vectors nearest to one pivot are cut in shells of
   equal shares by that distance, so a tile holds vectors that are alike.
2. A tile knows the least and greatest distance of its vectors to every pivot. Two vectors
   are at least as far apart as their distances to a pivot differ, which bounds the
   distance of two tiles from below.
3. Each tile is searched by itself first. The k-th best distances found there bound what
   another tile must beat: a pair of tiles whose bound is larger is never joined.
4. The pairs left are compared exactly, one task per pair. A task returns those of each vector's
   k best in the other tile that are within its bound; the k best overall are among those.
5. Where only a fold's nearest pairs are wanted, the distance within which the tiles hold
   enough of them bounds all its vectors.

A fold is cut in about ``MOST_TILES`` tiles, more only where a tile would hold over ``TILE_VALUES``
numbers, also where many vectors are equal. So a vector is copied a few times whatever the size of the
fold, and a task holds two tiles and a block of distances. Where no bound helps, every pair of tiles is
compared, and the result is the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import NeighbourSearch
from ..functions.numeric import pair_key
from ..staging import lanes, stage

# Vectors of a tile at least, tiles of a fold, and numbers of a tile at most (64 MB).
TILE, MOST_TILES, TILE_VALUES = 256, 8, 1 << 23
PIVOTS = 8
# Vectors of each side that are compared at once; their distances take 16 MB.
BLOCK = (512, 4096)
#: Finest shares of a pivot's vectors that become shells.
SHARES = 64
# |a|^2 + |b|^2 - 2ab cancels for near-equal vectors; what remains below this is noise.
SQUARE_NOISE = 1e-12
# A found distance may be off by the root of that noise; bounds are compared with more room.
ROOM = 1e-5


def nearest(x: np.ndarray, y: np.ndarray, k: int, same: bool, limit: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row of x, row of y, distance) of the k rows of y nearest to each row of x, the first ones where distances are
    equal; with ``limit`` only those that are no farther from the row of x than that."""
    # Rows of these two have the squared distance as their product.
    left = np.hstack([x, (x * x).sum(1)[:, None], np.ones((len(x), 1))])
    right = np.hstack([-2.0 * y, np.ones((len(y), 1)), (y * y).sum(1)[:, None]])
    found = []
    for top in range(0, len(x), BLOCK[0]):
        rows = left[top:top + BLOCK[0]]
        reach = np.full(len(rows), np.inf) if limit is None else (limit[top:top + BLOCK[0]] + ROOM) ** 2
        i, j, best = np.empty(0, int), np.empty(0, int), np.empty(0)
        for at in range(0, len(y), BLOCK[1]):
            square = rows @ right[at:at + BLOCK[1]].T
            if same:
                own = np.arange(max(top, at), min(top + len(rows), at + square.shape[1]))
                square[own - top, own - at] = np.inf
            near = square < reach[:, None]
            if np.isinf(reach).any() and square.shape[1] > k:
                near &= square <= np.maximum(np.partition(square, k - 1, axis=1)[:, k - 1:k], SQUARE_NOISE)
            hit_i, hit_j = np.nonzero(near)
            if not len(hit_i):
                continue
            hit = square[hit_i, hit_j]
            hit[hit < SQUARE_NOISE] = 0.0
            i, j, best = np.append(i, hit_i), np.append(j, hit_j + at), np.append(best, hit)
            order = np.lexsort((j, best, i))
            i, j, best = i[order], j[order], best[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, best, place = (v[place < k] for v in (i, j, best, place))
            # Rows of y come in order, so a later one must be nearer than the last of k.
            reach[i[place == k - 1]] = best[place == k - 1]
        found.append((i + top, j, np.sqrt(best)))
    return tuple(np.concatenate(v) for v in zip(*found))


def pivot_tiles(vectors: DataFrame, tile: int = TILE, pivots: int = PIVOTS, most: int | None = None) -> DataFrame:
    """(fold_id, symbol, embedding, reach, tile): distances to the fold's pivots, and a tile of vectors at like distances.

    With ``most`` a tile holds that part of its fold, if this is over ``tile`` vectors.
    """
    rows = vectors.select("fold_id", "symbol", F.col("embedding").cast("array<double>").alias("embedding"))
    by_hash = W.partitionBy("fold_id").orderBy(F.xxhash64("symbol"), "symbol")
    chosen = (rows.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= pivots)
              .groupBy("fold_id").agg(F.sort_array(F.collect_list(F.struct("place", "embedding"))).alias("held"))
              .select("fold_id", F.col("held.embedding").alias("pivots")))

    def apart(pivot):
        return F.sqrt(F.aggregate(F.zip_with("embedding", pivot, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, v: t + v))

    measured = stage(rows.join(stage(chosen, "pivots"), "fold_id").withColumn("reach", F.transform("pivots", apart)).drop("pivots")
                     .withColumn("own", F.array_min("reach")).withColumn("cell", F.array_position("reach", F.col("own"))), "pivot-reach")
    shares = F.percentile_approx("own", [i / SHARES for i in range(1, SHARES)], 10_000)
    widest = F.greatest(F.lit(tile), F.floor(TILE_VALUES / F.greatest(F.max(F.size("embedding")), F.lit(1))))
    wide = F.lit(tile) if most is None else F.least(widest, F.greatest(F.lit(tile), F.ceil(F.count(F.lit(1)) / most)))
    widths = measured.groupBy("fold_id").agg(wide.alias("width"))
    cells = measured.groupBy("fold_id", "cell").agg(F.count(F.lit(1)).alias("n"), shares.alias("borders")).join(widths, "fold_id").withColumn(
        "shells", F.least(F.ceil(F.col("n") / F.col("width")), F.lit(SHARES))).drop("n")
    below = F.size(F.filter("borders", lambda b: b < F.col("own")))
    shelled = measured.join(stage(cells, "pivot-cells"), ["fold_id", "cell"]).withColumn(
        "shell", F.floor(below * F.col("shells") / SHARES)).drop("borders", "shells", "own")
    # Equal distances share a shell; one with too many vectors is split by name.
    parts = shelled.groupBy("fold_id", "cell", "shell").agg(F.ceil(F.count(F.lit(1)) / F.first("width")).alias("parts"))
    part = F.pmod(F.xxhash64("symbol"), F.col("parts"))
    return stage(shelled.join(parts, ["fold_id", "cell", "shell"]).select(
        "fold_id", "symbol", "embedding", "reach", F.format_string("%d.%d.%d", "cell", "shell", part).alias("tile")), "pivot-tiles")


FOUND = "fold_id int, symbol string, neighbour string, distance double"


def _rows_of(fold_id, a: pd.DataFrame, b: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    limit = None if same else a["kth"].to_numpy("float64")
    i, j, d = nearest(np.stack(a["embedding"].to_list()), np.stack(b["embedding"].to_list()), k, same, limit)
    return pd.DataFrame({"fold_id": fold_id, "symbol": a["symbol"].to_numpy()[i], "neighbour": b["symbol"].to_numpy()[j], "distance": d})


def inside_tiles(tiles: DataFrame, k: int) -> DataFrame:
    """Each vector's k best in its own tile."""
    def search(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("symbol")
        return _rows_of(key[0], block, block, k, True)

    return tiles.groupBy("fold_id", "tile").applyInPandas(search, FOUND)


def bounded(tiles: DataFrame, found: DataFrame, k: int, first: int | None = None) -> DataFrame:
    """``tiles`` with ``kth``, beyond which nothing is wanted of a vector: the k-th best distance ``found`` for it.

    With ``first`` only so many nearest pairs of a fold are wanted. Twice as many rows of ``found`` are that many
    pairs at least, as each vector has its own of a pair; nothing is wanted beyond them.
    """
    kth = found.groupBy("fold_id", "symbol").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("kth"))
    unbound = F.lit(float("inf"))
    rows = tiles.join(kth, ["fold_id", "symbol"], "left").withColumn("kth", F.coalesce("kth", unbound))
    if first is None:
        return rows
    by_distance = W.partitionBy("fold_id").orderBy("distance")
    leading = found.withColumn("place", F.row_number().over(by_distance)).filter(F.col("place") <= 2 * first)
    radius = leading.groupBy("fold_id").agg(F.when(F.count(F.lit(1)) >= 2 * first, F.max("distance")).alias("radius"))
    return rows.join(radius, "fold_id", "left").withColumn("kth", F.least("kth", F.coalesce("radius", unbound))).drop("radius")


def tile_pairs_in_reach(tiles: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(fold_id, tile_a, tile_b) of the pairs of tiles in which a vector may have one of its k best."""
    return bounded_pairs(bounded(tiles, found, k))


def bounded_pairs(tiles: DataFrame) -> DataFrame:
    shells = tiles.groupBy("fold_id", "tile").agg(
        F.max("kth").alias("worst"),
        F.array(*[F.min(F.get("reach", F.lit(p))) for p in range(PIVOTS)]).alias("low"),
        F.array(*[F.max(F.get("reach", F.lit(p))) for p in range(PIVOTS)]).alias("high"))
    shells = stage(shells, "pivot-shells")
    a, b = (shells.select("fold_id", *[F.col(c).alias(f"{c}_{t}") for c in ("tile", "worst", "low", "high")]) for t in "ab")
    gaps = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    return (a.join(b, "fold_id").filter(F.col("tile_a") < F.col("tile_b"))
            .filter(F.array_max(gaps) <= F.greatest("worst_a", "worst_b") + ROOM).select("fold_id", "tile_a", "tile_b"))


def nearest_neighbours(vectors: DataFrame, k: int, tile: int = TILE, first: int | None = None) -> DataFrame:
    """(fold_id, symbol, neighbour, distance, nn_rank) with nn_rank <= k.

    With ``first`` only rows that one of so many nearest pairs of a fold can come from are sure to be there.
    """
    tiles = pivot_tiles(vectors, tile, most=MOST_TILES)
    width = lanes(vectors.sparkSession)
    inside = stage(inside_tiles(tiles.repartition(width, "fold_id", "tile"), k), "tile-neighbours")
    members = stage(bounded(tiles, inside, k, first).select("fold_id", "symbol", "embedding", "reach", "tile", "kth"), "tile-members")
    pairs = stage(bounded_pairs(members), "tile-pairs")
    sides = pairs.select("fold_id", "tile_a", "tile_b", F.explode(F.array("tile_a", "tile_b")).alias("tile"))

    def compare(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("symbol")
        a, b = (block[block["tile"] == t] for t in key[1:])
        return pd.concat([_rows_of(key[0], a, b, k, False), _rows_of(key[0], b, a, k, False)])

    keys = ["fold_id", "tile_a", "tile_b"]
    across = members.drop("reach").join(sides, ["fold_id", "tile"]).repartition(width, *keys).groupBy(*keys).applyInPandas(compare, FOUND)
    if first is not None:
        kept = members.select("fold_id", "symbol", "kth")
        inside = inside.join(kept, ["fold_id", "symbol"]).filter(F.col("distance") <= F.col("kth") + ROOM).drop("kth")
    best = W.partitionBy("fold_id", "symbol").orderBy("distance", "neighbour")
    return inside.unionByName(across).withColumn("nn_rank", F.row_number().over(best)).filter(F.col("nn_rank") <= k)


def unordered_pairs(neighbours: DataFrame) -> DataFrame:
    """Each pair once, in name order, with its least distance."""
    a, b = pair_key(F.col("symbol"), F.col("neighbour"))
    return neighbours.groupBy("fold_id", a.alias("sym_a"), b.alias("sym_b")).agg(
        F.min("distance").alias("emb_distance"))


def neighbour_pairs(vectors: DataFrame, search: NeighbourSearch = NeighbourSearch(),
                    tile: int = TILE) -> DataFrame:
    """Candidate pairs (fold_id, sym_a, sym_b, emb_distance, cand_rank), nearest first."""
    pairs = unordered_pairs(nearest_neighbours(vectors, search.k, tile, first=search.cap))
    best = W.partitionBy("fold_id").orderBy("emb_distance", "sym_a", "sym_b")
    return pairs.withColumn("cand_rank", F.row_number().over(best)).filter(
        F.col("cand_rank") <= search.cap)
