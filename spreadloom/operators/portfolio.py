"""Equal-weight portfolio of a fold's pairs, and the stitched out-of-sample series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def with_weight(pairs: DataFrame) -> DataFrame:
    """Add ``weight`` = 1 / number of pairs of the fold (at most ``max_pairs`` rows each)."""
    n = F.count(F.lit(1)).over(W.partitionBy("fold_id"))
    return pairs.withColumn("weight", 1 / n)


def fold_portfolio(pair_bars: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold_id, bar_seq, ret, turnover) on every test bar of every fold, zero without pairs.

    The empty grid is added as zero rows, so one aggregate serves for the sum and
    for the fill.
    """
    zero = F.lit(0.0)
    grid = folds.select("fold_id", F.explode(F.sequence("test_lo", "test_hi")).alias("bar_seq"),
                        zero.alias("ret"), zero.alias("turnover"))
    weighted = pair_bars.select(
        "fold_id", "bar_seq", (F.col("net_ret") * F.col("weight")).alias("ret"),
        (F.col("turnover") * F.col("weight")).alias("turnover"))
    return grid.unionByName(weighted).groupBy("fold_id", "bar_seq").agg(
        F.sum("ret").alias("ret"), F.sum("turnover").alias("turnover"))


def stitch(portfolio: DataFrame) -> DataFrame:
    """One row per bar; where test windows overlap the earliest fold counts."""
    return portfolio.groupBy("bar_seq").agg(
        F.min("fold_id").alias("fold_id"),
        F.min_by("ret", "fold_id").alias("ret"), F.min_by("turnover", "fold_id").alias("turnover"))


def active_pairs(pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold_id, n_active_pairs), zero for a fold without pairs."""
    counts = pairs.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n"))
    return folds.select("fold_id").join(counts, "fold_id", "left").select(
        "fold_id", F.coalesce("n", F.lit(0)).cast("double").alias("n_active_pairs"))
