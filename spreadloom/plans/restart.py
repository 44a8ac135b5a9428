"""Which folds a run has to compute, and which it can take from the saved bundle.

A fold depends on the bars of its own days and on settings. An order-free sum of hashes of
each day's bars, added up over the days of a fold, tells whether any of them was added,
removed or corrected, at the cost of one pass over the panel and a row per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import FoldPlan
from ..operators.folds import window_folds
from ..sources.results import config_key, read_bundle
from ..staging import stage
from .walk_forward import FoldResults

#: Columns of a bar that a fold's results follow from.
BAR = ("symbol", "bar_ts", "bar_seq", "close", "dollar_vol", "logret")


def day_fingerprints(panel: DataFrame) -> DataFrame:
    """(day_idx, n_days, bars, hashes): how many bars a day has, and the sum of their hashes, whatever their order."""
    return panel.groupBy("day_idx", "n_days").agg(
        F.count(F.lit(1)).alias("bars"), F.sum(F.xxhash64(*BAR).cast("decimal(38,0)")).alias("hashes"))


def fold_keys(panel: DataFrame, folds: DataFrame, plan: FoldPlan, *settings) -> DataFrame:
    """(fold_id, fold_key): equal for equal bars in the fold's train and test days, equal borders and settings."""
    ids = window_folds(F.col("day_idx"), F.col("n_days"), plan)
    sums = (day_fingerprints(panel).withColumn("fold_id", F.explode(ids)).groupBy("fold_id")
            .agg(F.sum("bars").alias("bars"), F.sum("hashes").alias("hashes")))
    parts = [F.col(c).cast("string") for c in ("bars", "hashes", "train_lo", "train_hi", "test_lo", "test_hi")]
    return folds.join(sums, "fold_id", "left").select("fold_id", F.sha2(F.concat_ws(
        "-", F.lit(config_key(*settings)), *[F.coalesce(p, F.lit("")) for p in parts]), 256).alias("fold_key"))


def folds_to_run(keys: DataFrame, saved: DataFrame | None) -> DataFrame:
    """The rows of ``keys`` that a saved run has not."""
    return keys if saved is None else keys.join(saved, ["fold_id", "fold_key"], "left_anti")


def with_saved_folds(new: FoldResults | None, keys: DataFrame, out: str, arm: str) -> FoldResults:
    """Fold results of a run together with the saved ones of all other folds of ``keys``."""
    spark = keys.sparkSession
    saved = read_bundle(spark, out, arm, "fold_keys")
    if saved is None:
        return new
    kept = stage(keys.join(saved, ["fold_id", "fold_key"], "left_semi").select("fold_id"), "kept-folds")

    def whole(table: str) -> DataFrame:
        old = read_bundle(spark, out, arm, table).join(kept, "fold_id", "left_semi")
        return old if new is None else new.tables()[table].unionByName(old)

    return FoldResults(*[whole(t) for t in ("pairs", "trades", "portfolio")])
