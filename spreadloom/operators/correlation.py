"""Pairwise correlation inside each fold's universe.

The universe is cut in at most ``MOST_TILES`` tiles of symbols, more only where a tile would hold over
``TILE_VALUES`` returns. One task multiplies two tiles of packed returns, ``BLOCK`` by ``BLOCK`` series at a time,
and gives each block's pairs away (or keeps the best so far). So a series is copied once per tile, whatever the size of
the universe, a task holds two tiles and a block of products, and only the pairs that can still make the list leave it.

For a list, a block is first multiplied once in single precision, which gives every pair's correlation a bound from above
(``may_reach``); only pairs on or over the worst place so far are computed in full, each by itself (``pair_correlations``),
so that a value does not depend on the block it was in. Missing returns are part of the bound. The histogram takes its range
by the same bound and its bins from correlations in single precision; pairs too near to a border of a bin are computed in full.

Where a list of the best pairs is wanted, a fold has ``BOUND_FROM`` small tiles or more and few series lack a
sketch, series that are alike share a tile. Each tile is searched by itself first; what it finds is a floor under
the fold's last place. Two tiles are multiplied only if their sketches (``energy``), which
are a hundredth of the series, allow a correlation on or over that floor. Where the tiles left would copy
the series more often than all pairs of large tiles do, those are multiplied, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import CorrelationSearch
from ..functions.numeric import finite
from ..staging import lanes, stage
from .energy import ROOM, sketched_tiles

# Symbols of a tile at least, tiles of a fold, and returns of a tile at most (64 MB).
TILE, MOST_TILES, TILE_VALUES = 256, 8, 1 << 23
# Series of each side that are multiplied at once; their products take 2 MB each.
BLOCK = 512
# For each bar: room for single precision in a bound, and what it may be wrong by in a correlation whose series keep ``KEPT``
# of their squares (the product of both) on the bars they share. A sum of products of unit length is wrong by 6e-8 a bar at most.
SCREEN_ROOM, SINGLE_ERROR, KEPT = 1e-6, 2.4e-7, 0.5
# Room for the order in which products are added up.
SUM_ROOM = 1e-9
# Beyond this share of a block's pairs they are not computed one by one.
MANY = 1 / 16
# Pairs whose returns are held at once.
PAIRS_AT_ONCE = 512
# Small tiles of a fold from which bounds are asked for: sketching moves every series three times.
BOUND_FROM = 8

PAIR_SCHEMA = ("fold_id int, sym_a string, sym_b string, rank_a int, rank_b int, "
               "train_corr double, n_obs bigint")


def pair_up_tiles(rows: DataFrame) -> DataFrame:
    """Copy each row, which knows ``tile`` and ``n_tiles``, to every tile pair of its tile."""
    return (
        rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
        .withColumn("tile_a", F.least("tile", "other"))
        .withColumn("tile_b", F.greatest("tile", "other"))
        .drop("other", "n_tiles")
    )


def correlation_parts(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which returns are there, the returns centred with zeros where missing, and their squares."""
    seen = np.isfinite(m)
    centre = np.where(seen, m, 0.0).sum(1, keepdims=True) / np.maximum(seen.sum(1, keepdims=True), 1)
    centred = np.where(seen, m - centre, 0.0)
    return seen.astype(float), centred, centred * centred


def _less_means(products: np.ndarray, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    sums /= n
    products -= sums
    return products


def parts_correlation(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
    (mx, vx, qx), (my, vy, qy) = x, y
    n = mx @ my.T
    sx, sy = vx @ my.T, mx @ vy.T
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = _less_means(vx @ vy.T, sx * sy, n)
        var_y = _less_means(mx @ qy.T, np.square(sy, out=sy), n)
        deviations = _less_means(qx @ my.T, np.square(sx, out=sx), n)
        deviations *= var_y
        cov /= np.sqrt(deviations, out=deviations)
    return np.clip(cov, -1.0, 1.0, out=cov), n


def masked_correlation(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation and overlap of every row of x with every row of y, NaN = missing."""
    return parts_correlation(correlation_parts(x), correlation_parts(y))


def pair_correlations(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation and overlap of rows i of x with rows j of y; the same for y with x."""
    corr, n = np.empty(len(i)), np.empty(len(i))
    for at in range(0, len(i), PAIRS_AT_ONCE):
        to = slice(at, at + PAIRS_AT_ONCE)
        (mx, vx, qx), (my, vy, qy) = correlation_parts(x[i[to]]), correlation_parts(y[j[to]])
        n[to], sx, sy, cov, dx, dy = (np.einsum("ij,ij->i", *two) for two in ((mx, my), (vx, my), (mx, vy), (vx, vy), (qx, my), (mx, qy)))
        with np.errstate(divide="ignore", invalid="ignore"):
            corr[to] = (cov - sx * sy / n[to]) / np.sqrt((dx - sx * sx / n[to]) * (dy - sy * sy / n[to]))
    return np.clip(corr, -1.0, 1.0), n


class Side(NamedTuple):
    """The series of a tile; ``times`` tells how many series of the fold each stands for."""

    ranks: np.ndarray
    symbols: np.ndarray
    returns: np.ndarray
    times: np.ndarray


def sides_of(key: tuple, batches: Iterator[pa.RecordBatch]) -> list[Side]:
    """The two tiles of a tile pair, or the one, in the order of their ranks."""
    rows = pa.Table.from_batches(list(batches))
    tiles, ranks, symbols = (rows.column(c).to_numpy() for c in ("tile", "uni_rank", "symbol"))
    returns = rows.column("ret").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    times = rows.column("times").to_numpy() if "times" in rows.column_names else np.ones(len(rows), "int64")
    out = []
    for t in dict.fromkeys(k.as_py() for k in key[1:]):
        own = np.flatnonzero(tiles == t)
        own = own[np.argsort(ranks[own], kind="stable")]
        out.append(Side(ranks[own], symbols[own], returns[own], times[own]))
    return out


def side_of_rows(block: pd.DataFrame) -> Side:
    returns = np.stack(block["ret"].to_list()) if len(block) else np.zeros((0, 0))
    return Side(block["uni_rank"].to_numpy(), block["symbol"].to_numpy(), returns, np.ones(len(block), "int64"))


@dataclass(frozen=True)
class Block:
    """Some series of a tile: ranks and symbols, returns, and what bounds their correlations.

    In single precision: ``unit``, centred returns of unit length; ``lost`` and ``taken``, whose product over two series is what both
    lose in squares at bars that the other one misses, times 1 + k / n for k such bars and the n that are shared at least.
    ``gone`` is the most returns that a series misses.
    """

    ranks: np.ndarray
    symbols: np.ndarray
    returns: np.ndarray
    times: np.ndarray
    unit: np.ndarray
    lost: np.ndarray
    taken: np.ndarray
    gone: int


def blocks_of(sides: list[Side]) -> list[list[Block]]:
    """The series of each side in blocks, those that miss few returns first."""
    gone = [(~np.isfinite(side.returns)).sum(1) for side in sides]
    shared = max(1, sides[0].returns.shape[1] - 2 * max(int(g.max()) for g in gone))
    out = []
    for side, missed in zip(sides, gone):
        order, blocks = np.argsort(missed, kind="stable"), []
        for cut in (order[at:at + BLOCK] for at in range(0, len(order), BLOCK)):
            held = Side(*[c[cut] for c in side])
            seen, unit, squares = correlation_parts(held.returns)
            size = squares.sum(1, keepdims=True)
            size[~(size > 0)] = 1.0
            weighed, squares = (1.0 - seen) * (1.0 + missed[cut, None] / shared), squares / size
            single = (unit / np.sqrt(size), np.hstack([squares, weighed]), np.hstack([weighed, squares]))
            blocks.append(Block(*held, *(v.astype("float32") for v in single), int(missed[cut].max())))
        out.append(blocks)
    return out


class Room:
    """Memory for the products of a block, which is taken from the system once."""

    def __init__(self, products: int):
        self._held = [np.empty(BLOCK * BLOCK, "float32") for _ in range(products)]

    def of(self, x, y) -> list[np.ndarray]:
        shape = len(x.ranks), len(y.ranks)
        return [v[:shape[0] * shape[1]].reshape(shape) for v in self._held]


def may_reach(x: Block, y: Block, floor: float, room: Room, sign: int = 1, again: bool = False) -> np.ndarray:
    """Which pairs of a row of each block may have a correlation, times ``sign``, of ``floor`` or more; ``again`` if ``room`` still
    has the products of these blocks.

    Of two series of unit length, a loses the squares p at the bars that b misses (k of n shared ones), and as its sum over
    the shared bars is at most the root of k p, no more than z = p (1 + k / n) with its mean there. So the correlation is at most
    (product + h) / sqrt(1 - z), z that of both, where h = sum times sum / n is at most half of what k / n adds to z. One
    under zero is at most product + h.
    """
    bars, most = x.unit.shape[1], max(x.gone, y.gone)
    if floor == -np.inf or bars <= 2 * most:
        return np.ones((len(x.ranks), len(y.ranks)), bool)
    top, z, product, spare = room.of(x, y)
    if not again:
        np.matmul(x.lost, y.taken.T, out=z)
        np.matmul(x.unit, y.unit.T, out=product)
    share, slack = most / (bars - x.gone - y.gone), np.float32(SCREEN_ROOM * bars)
    np.multiply(z, np.float32(share / (1 + share) / 2), out=top)
    (np.add if sign > 0 else np.subtract)(top, product, out=top)
    top += slack
    if floor <= 0:
        return top >= np.float32(floor)
    np.maximum(top, np.float32(0), out=top)
    top *= top
    top += np.multiply(z, np.float32(floor ** 2), out=spare)
    return top >= np.float32(floor ** 2) - slack


def _both_ways(wanted: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.divmod(np.flatnonzero(wanted), wanted.shape[1])
    return (i[i < j], j[i < j]) if same else (i, j)


def likely_pairs(x: Block, y: Block, floor: float, overlap: int, top_k: int | None, room: Room, sign: int = 1,
                 again: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks among which are all pairs whose correlation, times ``sign``, is on or over ``floor`` and can be of
    the best ``top_k``."""
    found = _both_ways(may_reach(x, y, floor, room, sign, again), x is y)
    if len(found[0]) <= MANY * len(x.ranks) * len(y.ranks):
        return found
    corr, n = masked_correlation(x.returns, y.returns)
    corr *= sign
    wanted = (corr >= floor - SUM_ROOM) & (n >= overlap)
    i, j = _both_ways(wanted, x is y)
    if top_k is not None and len(i) > top_k:
        held = corr[i, j]
        best = held >= np.partition(held, -top_k)[-top_k] - SUM_ROOM
        i, j = i[best], j[best]
    return i, j


def tile_width(tile: int) -> Column:
    """Symbols of a tile of a fold: ``tile``, or more where that would make over ``MOST_TILES`` tiles."""
    most = F.greatest(F.lit(tile), F.floor(F.lit(TILE_VALUES) / F.greatest(F.size("ret"), F.lit(1))))
    return F.least(F.greatest(F.lit(tile), F.ceil(F.col("n_universe") / MOST_TILES)), most)


def tiled(series: DataFrame, tile: int, *more: str):
    """The packed series, with the columns ``more``, grouped by fold and tile pair."""
    rows = series.withColumn("width", tile_width(tile)).select(
        "fold_id", "symbol", "ret", "uni_rank", *more,
        F.floor((F.col("uni_rank") - 1) / F.col("width")).cast("int").alias("tile"),
        F.ceil(F.col("n_universe") / F.col("width")).cast("int").alias("n_tiles"))
    keys = ["fold_id", "tile_a", "tile_b"]
    return pair_up_tiles(rows).repartition(lanes(series.sparkSession), *keys).groupBy(*keys)


def tile_blocks(sides: list[Side]) -> Iterator[tuple]:
    """(left rows, right rows, correlation, overlap) of each block of a tile pair, each two series in one block or
    both in the same one; rows are in the order of their ranks."""
    cuts = [[Side(*[c[at:at + BLOCK] for c in side]) for at in range(0, len(side.ranks), BLOCK)] for side in sides]
    parts = [[(cut, correlation_parts(cut.returns)) for cut in side] for side in cuts]
    for at, (left, x) in enumerate(parts[0]):
        for right, y in parts[1] if len(parts) == 2 else parts[0][at:]:
            yield left, right, *parts_correlation(x, y)


def wanted_pairs(left: Side, right: Side, corr: np.ndarray, n: np.ndarray, overlap: int,
                 floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    wanted = corr >= floor  # false where there is no correlation
    wanted &= n >= overlap
    return np.nonzero(np.triu(wanted, 1) if left is right else wanted)


def block_range(x: Block, y: Block, overlap: int, lo: float, hi: float, room: Room) -> tuple[float, float]:
    """``lo`` and ``hi``, or the least and greatest correlation of two blocks where they are beyond these."""
    known = hi > -np.inf  # Then the first of the two bounds leaves its products.
    for sign in (1, -1):
        i, j = likely_pairs(x, y, hi if sign > 0 else -lo, overlap, 1, room, sign, known and sign < 0)
        corr, n = pair_correlations(x.returns, i, y.returns, j)
        if x is y:  # A series that stands for several is a pair with itself.
            own = np.flatnonzero(x.times > 1)
            corr, n = (np.concatenate(c) for c in zip((corr, n), pair_correlations(x.returns, own, x.returns, own)))
        corr = corr[(n >= overlap) & np.isfinite(corr)]
        if len(corr):
            lo, hi = min(lo, corr.min()), max(hi, corr.max())
    return lo, hi


class Shape(NamedTuple):
    """Series of a block in single precision: centred returns of unit length (not a number where there is no spread), their
    squares, and ones where a return is missing; beside these columns that make their product the number of shared bars.
    Each series of a block stands for as many."""

    ranks: np.ndarray
    returns: np.ndarray
    times: int
    unit: np.ndarray
    squares: np.ndarray
    missing: np.ndarray
    left: np.ndarray
    right: np.ndarray


def shapes_of(side: Side) -> list[Shape]:
    out = []
    alike = [np.flatnonzero(side.times == t) for t in np.unique(side.times)]
    for cut in (rows[at:at + BLOCK] for rows in alike for at in range(0, len(rows), BLOCK)):
        held = Side(*[c[cut] for c in side])
        seen, unit, squares = correlation_parts(held.returns)
        size = squares.sum(1, keepdims=True)
        size[~(size > 0)] = np.nan
        missing, one = 1.0 - seen, np.ones((len(seen), 1))
        gone = missing.sum(1, keepdims=True)
        single = (unit / np.sqrt(size), squares / size, missing, np.hstack([missing, seen.shape[1] - gone, one]), np.hstack([missing, one, -gone]))
        out.append(Shape(held.ranks, held.returns, int(held.times[0]), *(v.astype("float32") for v in single)))
    return out


def block_counts(x: Shape, y: Shape, overlap: int, lo: float, hi: float, bins: int, room: Room) -> np.ndarray:
    """How many correlations of two blocks are in each of the equal bins from ``lo`` to ``hi``."""
    def exact(corr: np.ndarray, n: np.ndarray) -> np.ndarray:
        corr = corr[(n >= overlap) & np.isfinite(corr)]
        place = np.floor((corr - lo) / (hi - lo) * bins) if hi > lo else np.zeros(len(corr))
        return np.bincount(np.clip(place, 0, bins - 1).astype("int64"), minlength=bins)

    if x is not y and hi > lo:
        corr, kept_x, kept_y, sum_x, sum_y, n, spare = room.of(x, y)
        for a, b, out in ((x.unit, y.unit, corr), (x.squares, y.missing, kept_x), (x.missing, y.squares, kept_y),
                          (x.unit, y.missing, sum_x), (x.missing, y.unit, sum_y), (x.left, y.right, n)):
            np.matmul(a, b.T, out=out)
        few = n.min() < overlap
        with np.errstate(divide="ignore", invalid="ignore"):
            doubt = n < overlap if few else None
            np.reciprocal(n, out=n)
            sum_x *= n
            corr -= np.multiply(sum_x, sum_y, out=spare)
            kept_x += np.divide(np.square(sum_x, out=sum_x), n, out=sum_x)
            kept_y += np.multiply(np.square(sum_y, out=sum_y), n, out=sum_y)
            np.subtract(1, kept_x, out=kept_x)
            kept_x *= np.subtract(1, kept_y, out=kept_y)
            corr /= np.sqrt(kept_x, out=kept_y)
        corr *= np.float32(bins / (hi - lo))
        corr -= np.float32(lo * bins / (hi - lo))
        off = np.subtract(corr, np.rint(corr, out=sum_x), out=sum_x)
        sure = np.abs(off, out=off) > np.float32(SINGLE_ERROR * x.unit.shape[1] * bins / (hi - lo))
        sure &= kept_x >= np.float32(KEPT)
        if few:
            sure &= ~doubt
        i, j = _both_ways(~sure, False)
        if len(i) <= MANY * corr.size:
            np.clip(corr, 0, bins - 1, out=corr)
            corr[i, j] = bins
            held = np.bincount(corr.ravel().astype("int64"), minlength=bins)[:bins]
            return (held + exact(*pair_correlations(x.returns, i, y.returns, j))) * (x.times * y.times)
    corr, n = masked_correlation(x.returns, y.returns)
    if x is not y:
        return exact(corr.ravel(), n.ravel()) * (x.times * y.times)
    over, own = np.triu_indices(len(corr), 1), np.arange(len(corr) if x.times > 1 else 0)
    return exact(corr[over], n[over]) * x.times ** 2 + exact(*pair_correlations(x.returns, own, x.returns, own)) * (x.times * (x.times - 1) // 2)


def each_once(series: DataFrame) -> DataFrame:
    """The series with ``times``: those of a fold that are alike in all returns as one that counts as often, at a rank of its own."""
    alike = series.groupBy("fold_id", F.xxhash64("ret")).count().agg(F.max("count")).first()[0]
    if (alike or 0) < 2:
        return series.withColumn("times", F.lit(1).cast("bigint"))
    once = stage(series.groupBy("fold_id", "ret").agg(F.min("uni_rank").alias("place"), F.count(F.lit(1)).alias("times")), "series-once")
    places = once.select("fold_id", "place", F.row_number().over(W.partitionBy("fold_id").orderBy("place")).alias("uni_rank"))
    sizes = once.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_universe"))
    return once.join(places, ["fold_id", "place"]).join(sizes, "fold_id").withColumn("symbol", F.col("place").cast("string"))


def correlation_histogram(series: DataFrame, bins: int, overlap: int = CorrelationSearch().min_overlap,
                          tile: int = TILE) -> DataFrame:
    """(bin, bin_low, n) of all pairs' correlations, over their range in equal bins.

    A tile pair returns its range, then its counts; no pair leaves a task. Series that are alike are multiplied once.
    """
    groups = tiled(each_once(series), tile, "times")

    def reach(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, room, lo, hi = sides_of(key, batches), Room(4), np.inf, -np.inf
        if all(len(side.ranks) for side in sides):
            for x, y in block_pairs(blocks_of(sides)):
                lo, hi = block_range(x, y, overlap, lo, hi, room)
        ends = [[v] if lo <= hi else [] for v in (lo, hi)]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64()) for v in ends], ["lo", "hi"])

    lo, hi = groups.applyInArrow(reach, "lo double, hi double").agg(F.min("lo"), F.max("hi")).first()

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = np.zeros(bins, np.int64), Room(7)
        for x, y in block_pairs([shapes_of(side) for side in sides_of(key, batches)]):
            if lo is not None:
                held += block_counts(x, y, overlap, lo, hi, bins, room)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype("int32")), pa.array(held[found])], ["bin", "n"])

    counted = groups.applyInArrow(count, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    low = F.lit(lo) + (F.lit(hi) - F.lit(lo)) * F.col("bin") / bins
    return counted.select("bin", low.cast("double").alias("bin_low"), "n")


def _pair_frame(fold_id, columns: list[np.ndarray]) -> pd.DataFrame:
    rows = pd.DataFrame(dict(zip(("sym_a", "sym_b", "rank_a", "rank_b", "train_corr", "n_obs"), columns)))
    rows.insert(0, "fold_id", fold_id)
    return rows.astype({"fold_id": "int32", "rank_a": "int32", "rank_b": "int32", "n_obs": "int64"})


def _best_of(held: list[list[np.ndarray]], top_k: int) -> list[np.ndarray]:
    """Of columns of pairs (symbols, ranks, correlation, overlap) the best ``top_k``, best first."""
    columns = [np.concatenate(c) for c in zip(*held)]
    best = np.lexsort((columns[3], columns[2], -columns[4]))[:top_k]
    return [c[best] for c in columns]


def block_pairs(sides: list[list]) -> Iterator[tuple]:
    """Each two blocks of two sides; of one side each two and each with itself."""
    for at, x in enumerate(sides[0]):
        for y in sides[1] if len(sides) == 2 else sides[0][at:]:
            yield x, y


def listed_pairs(fold_id, sides: list[Side], search: CorrelationSearch, floor: float) -> Iterator[pd.DataFrame]:
    """Pairs of a row of each side (of two rows, where there is one) that may be in the fold's list; no pair outside a
    tile pair's own best ``top_k`` can."""
    if not all(len(side.ranks) for side in sides):
        return
    held, new, last, room = [], 0, None, Room(4)
    for x, y in block_pairs(blocks_of(sides)):
        i, j = likely_pairs(x, y, floor, search.min_overlap, search.top_k, room)
        corr, n = pair_correlations(x.returns, i, y.returns, j)
        low, high = np.minimum(x.ranks[i], y.ranks[j]), np.maximum(x.ranks[i], y.ranks[j])
        kept = (corr >= floor) & (n >= search.min_overlap)
        if last is not None:  # Of pairs like the last place only those that come before it.
            kept &= (corr > floor) | (low < last[0]) | ((low == last[0]) & (high < last[1]))
        if not kept.any():
            continue
        first = x.ranks[i] < y.ranks[j]
        a, b = x.symbols[i], y.symbols[j]
        held.append([c[kept] for c in (np.where(first, a, b), np.where(first, b, a), low, high, corr, n)])
        new += kept.sum()
        if search.top_k is None:
            yield _pair_frame(fold_id, held.pop())
        elif new >= (search.top_k if last is None else search.top_k / 4):
            held, new = [_best_of(held, search.top_k)], 0
            low, high, corr = (c[-1] for c in held[0][2:5])
            floor, last = corr, (low, high)
    if held:
        yield _pair_frame(fold_id, _best_of(held, search.top_k))


def _as_batch(rows: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(rows, preserve_index=False)


def all_tile_pairs(series: DataFrame, search: CorrelationSearch, tile: int) -> DataFrame:
    """Every pair of tiles multiplied."""
    least = -np.inf if search.min_corr is None else search.min_corr

    def correlate(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, sides = key[0].as_py(), sides_of(key, batches)
        if search.top_k is None and search.min_corr is None:
            for left, right, corr, n in tile_blocks(sides):
                i, j = wanted_pairs(left, right, corr, n, search.min_overlap)
                if len(i):
                    first, a, b = left.ranks[i] < right.ranks[j], left.symbols[i], right.symbols[j]
                    yield _as_batch(_pair_frame(fold, [
                        np.where(first, a, b), np.where(first, b, a), np.minimum(left.ranks[i], right.ranks[j]),
                        np.maximum(left.ranks[i], right.ranks[j]), corr[i, j], n[i, j]]))
        else:
            yield from map(_as_batch, listed_pairs(fold, sides, search, least))

    return tiled(series, tile).applyInArrow(correlate, PAIR_SCHEMA)


def tile_pairs_in_reach(tiles: DataFrame, floors: DataFrame) -> DataFrame:
    """(fold_id, tile_a, tile_b, floor) of two tiles whose sketches allow a correlation of the fold's floor.

    A task compares the tiles of two of at most ``MOST_TILES`` spans, so a sketch is copied that often.
    """
    def bound(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = pd.concat(list(batches))
        floor = block["floor"].iloc[0]
        held = []
        for t, side in block.groupby("small"):
            regular = side["regular"].all()
            held.append((t, side["tile"].iloc[0], (np.stack(side["coords"].to_list()), side["rest"].to_numpy()) if regular else None))
        found = []
        for at, (a, span_a, x) in enumerate(held):
            for b, span_b, y in held[at + 1:]:
                if {span_a, span_b} != set(key[1:]):
                    continue
                if x is None or y is None or (x[0] @ y[0].T + np.outer(x[1], y[1])).max() + ROOM >= floor:
                    found.append((a, b))
        yield pd.DataFrame({"fold_id": key[0], "tile_a": [a for a, _ in found], "tile_b": [b for _, b in found], "floor": floor})

    span = F.ceil(F.col("n_tiles") / MOST_TILES)
    spans = tiles.join(floors, "fold_id").drop("symbol").withColumn("small", F.col("tile")).withColumn(
        "tile", F.floor(F.col("small") / span).cast("int")).withColumn("n_tiles", F.ceil(F.col("n_tiles") / span).cast("int"))
    return pair_up_tiles(spans).groupBy("fold_id", "tile_a", "tile_b").applyInPandas(
        bound, "fold_id int, tile_a int, tile_b int, floor double")


def fold_floors(inside: DataFrame, tiles: DataFrame, search: CorrelationSearch) -> DataFrame:
    """(fold_id, floor): no pair below it can be in the fold's list, by what the tiles hold themselves."""
    least = F.lit(-float("inf") if search.min_corr is None else float(search.min_corr))
    folds = tiles.select("fold_id").distinct()
    if search.top_k is None:
        return folds.withColumn("floor", least)
    best = W.partitionBy("fold_id").orderBy(F.desc("train_corr"))
    last = inside.select("fold_id", "train_corr", F.row_number().over(best).alias("place")).filter(F.col("place") == search.top_k)
    return folds.join(last, "fold_id", "left").select("fold_id", F.coalesce("train_corr", least).alias("floor"))


def tile_pairs_by_bound(series: DataFrame, search: CorrelationSearch, tile: int) -> DataFrame:
    """Each tile multiplied by itself, then the pairs of tiles that can still hold a pair of the list."""
    tiles = sketched_tiles(series, tile)
    rows, places = series.select("fold_id", "symbol", "ret", "uni_rank"), tiles.select("fold_id", "symbol", "tile")
    floor = -np.inf if search.min_corr is None else search.min_corr

    def within(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from listed_pairs(key[0], [side_of_rows(pd.concat(list(batches)))], search, floor)

    def across(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = pd.concat(list(batches))
        yield from listed_pairs(key[0], [side_of_rows(block[block["tile"] == t]) for t in key[1:]], search, block["floor"].iloc[0])

    inside = stage(rows.join(places, ["fold_id", "symbol"]).groupBy("fold_id", "tile").applyInPandas(within, PAIR_SCHEMA), "tile-correlations")
    reached = stage(tile_pairs_in_reach(tiles, stage(fold_floors(inside, tiles, search), "floors")), "tile-pairs")
    sides = reached.withColumn("tile", F.explode(F.array("tile_a", "tile_b")))
    copied = sides.groupBy("fold_id", "tile").count().join(places.groupBy("fold_id", "tile").agg(F.count(F.lit(1)).alias("held")), ["fold_id", "tile"])
    times = copied.agg(F.sum(F.col("count") * F.col("held"))).first()[0] or 0
    if times > MOST_TILES * places.count():
        return all_tile_pairs(series, search, tile)
    copies = rows.join(places.join(sides, ["fold_id", "tile"]), ["fold_id", "symbol"])
    return inside.unionByName(copies.groupBy("fold_id", "tile_a", "tile_b").applyInPandas(across, PAIR_SCHEMA))


def bounds_help(series: DataFrame, tile: int) -> bool:
    """Whether some fold has many small tiles, and no fold has many of series whose missing returns are not the usual ones.

    Those are compared with every other tile, so every series would be copied once for each such tile.
    """
    if (series.agg(F.max("n_universe")).first()[0] or 0) <= tile * (BOUND_FROM - 1):
        return False
    pattern = F.xxhash64(F.transform("ret", lambda x: finite(x).isNotNull()))
    counts = series.groupBy("fold_id", pattern.alias("pattern")).count().groupBy("fold_id").agg(
        (F.sum("count") - F.max("count")).alias("unusual"))
    return counts.agg(F.max("unusual")).first()[0] <= tile * MOST_TILES


def correlated_pairs(series: DataFrame, search: CorrelationSearch = CorrelationSearch(),
                     tile: int = TILE) -> DataFrame:
    """Pairs of a fold with their correlation over common returns, best first.

    Adds ``cand_rank``, the place in (correlation down, rank_a, rank_b) order.
    Without ``top_k`` and ``min_corr`` every pair with enough overlap is kept.
    """
    bounded = search.top_k is not None or search.min_corr is not None
    found = (tile_pairs_by_bound if bounded and bounds_help(series, tile) else all_tile_pairs)(series, search, tile)
    if search.top_k is None:
        return found
    best = W.partitionBy("fold_id").orderBy(F.desc("train_corr"), F.asc("rank_a"), F.asc("rank_b"))
    return found.withColumn("cand_rank", F.row_number().over(best)).filter(
        F.col("cand_rank") <= search.top_k)
