"""Packed series: one row per (fold, symbol) with the fold's dense bar arrays.

A fold window has a fixed number of bars, so a packed row is bounded by the fold
plan, whatever the data size. Packing is the one shuffle by (fold, symbol) that
correlation, pair statistics, back-test and embeddings all share; joining two
packed rows replaces a bar-by-bar join of two legs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import FoldPlan
from ..staging import lanes
from .folds import assign_members

FILL_LIMIT = 3


_PACKED = "fold_id int, symbol string, lo bigint, close array<double>, ret array<double>"


def _dense(rows: pa.Table) -> pa.RecordBatch:
    """Packed rows of whole series, whose bars follow each other in ``rows``, spread over the grid of their fold."""
    fold, seq, lo, hi = (rows.column(c).to_numpy() for c in ("fold_id", "bar_seq", "lo", "hi"))
    starts = np.concatenate([[0], _borders(rows)])
    ends = np.append(starts[1:], len(seq))
    # A bar past its fold's border is kept, for the guard to see.
    width = np.maximum(hi[starts], seq[ends - 1]) - lo[starts] + 1
    first = np.cumsum(width) - width
    place = np.repeat(first - lo[starts], ends - starts) + seq
    at = np.full(width.sum(), -1)
    at[place] = np.arange(len(seq))
    cells = np.arange(len(at))
    seen = np.maximum.accumulate(np.where(at >= 0, cells, -1))
    filled = (seen >= np.repeat(first, width)) & (cells - seen <= FILL_LIMIT)
    offsets = pa.array(np.append(first, len(at)), pa.int32())

    def spread(value: str, source: np.ndarray, held: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(offsets, rows.column(value).combine_chunks().take(pa.array(source, mask=~held)))

    return pa.RecordBatch.from_arrays([
        pa.array(fold[starts]), rows.column("symbol").combine_chunks().take(pa.array(starts)), pa.array(lo[starts]),
        spread("close", at[seen], filled), spread("logret", at, at >= 0)], ["fold_id", "symbol", "lo", "close", "ret"])


def _borders(rows: pa.Table) -> np.ndarray:
    """Numbers of the rows that begin another series than the row before."""
    fold = rows.column("fold_id").to_numpy()
    name = rows.column("symbol").combine_chunks().dictionary_encode().indices.to_numpy()
    return np.flatnonzero((fold[1:] != fold[:-1]) | (name[1:] != name[:-1])) + 1


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # The last series of a batch, which may go on in the next one.
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        borders = _borders(rows)
        cut = borders[-1] if len(borders) else 0
        if cut:
            yield _dense(rows.slice(0, cut))
        held = rows.slice(cut)
    if held is not None and len(held):
        yield _dense(held)


def pack_series(rows: DataFrame, folds: DataFrame, side: str) -> DataFrame:
    """(fold_id, symbol, lo, close[], ret[]) from (fold_id, symbol, bar_seq, close, logret).

    Closes are forward filled over at most three bars and never from before the
    window; returns are not filled. Bars are sorted where their series lies and spread over
    the grid a batch at a time; a task holds a batch and the one series that it ends in.
    """
    bounds = folds.select("fold_id", F.col(f"{side}_lo").alias("lo"), F.col(f"{side}_hi").alias("hi"))
    keys = ["fold_id", "symbol"]
    # By number: a packed row is of the same size whatever the bytes of its bars.
    dealt = rows.select(*keys, "bar_seq", "close", "logret").repartition(lanes(rows.sparkSession), *keys)
    return dealt.join(bounds, "fold_id").select(
        *keys, "bar_seq", "lo", "hi", "close", "logret").sortWithinPartitions(*keys, "bar_seq").mapInArrow(_packed, _PACKED)


def train_series(panel: DataFrame, folds: DataFrame, universe: DataFrame,
                 plan: FoldPlan) -> DataFrame:
    """Packed train windows of each fold's universe, with its ``uni_rank``."""
    ranks = universe.select("fold_id", "symbol", "uni_rank", "n_universe")
    rows = assign_members(panel, ranks, plan, "train")
    return pack_series(rows, folds, "train").join(ranks, ["fold_id", "symbol"])


def pair_legs(pairs: DataFrame) -> DataFrame:
    return pairs.select("fold_id", F.explode(F.array("sym_a", "sym_b")).alias("symbol"))


def test_series(panel: DataFrame, folds: DataFrame, pairs: DataFrame, plan: FoldPlan) -> DataFrame:
    """Packed test windows of the symbols that some selected pair trades."""
    return pack_series(assign_members(panel, pair_legs(pairs), plan, "test"), folds, "test")


def series_rows(series: DataFrame) -> DataFrame:
    """Unpack: (fold_id, symbol, bar_seq, close, logret) on the dense fold grid."""
    return series.select(
        "fold_id", "symbol", "lo", F.posexplode(F.arrays_zip("close", "ret"))
    ).select(
        "fold_id", "symbol", (F.col("lo") + F.col("pos")).alias("bar_seq"),
        F.col("col.close").alias("close"), F.col("col.ret").alias("logret"),
    )
