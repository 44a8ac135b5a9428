"""Training windows cut from packed return series, their scaling and pooling."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..config import AutoencoderSpec, GruSpec
from ..functions.numeric import left_pad, unit_vector


def tumbling_windows(series: DataFrame, spec: AutoencoderSpec = AutoencoderSpec()) -> DataFrame:
    """(fold_id, symbol, window_id, x): consecutive ``seq_len`` grid bars of returns.

    Windows follow the grid, not the days; one with too few returns is dropped and
    the missing ones of a kept window are zero. A rest at the end is not used.
    """
    size = spec.seq_len
    starts = F.sequence(F.lit(0), F.floor(F.size("ret") / size).cast("int") - 1)
    cut = F.transform(starts, lambda w: F.slice("ret", w * size + 1, size))
    rows = series.filter(F.size("ret") >= size).select(
        "fold_id", "symbol", F.posexplode(cut).alias("window_id", "raw"))
    seen = F.size(F.filter("raw", lambda v: v.isNotNull()))
    return rows.filter(seen / size >= spec.min_valid_share).select(
        "fold_id", "symbol", "window_id",
        F.transform("raw", lambda v: F.coalesce(v, F.lit(0.0))).alias("x"))


def sliding_windows(series: DataFrame, lookbacks: DataFrame, spec: GruSpec = GruSpec()) -> DataFrame:
    """(fold_id, symbol, bar_pos, x, target): the symbol's own number of returns before
    each bar, all present, left padded with zeros; ``target`` is the bar's return or NULL."""
    width = F.least(F.coalesce("lookback", F.lit(spec.default_lookback)), F.lit(spec.max_lags))
    rows = series.select("fold_id", "symbol", "ret").join(
        lookbacks.select("fold_id", "symbol", "lookback"), ["fold_id", "symbol"], "left"
    ).withColumn("width", width.cast("int")).filter(F.size("ret") > F.col("width"))
    cut = F.transform(
        F.sequence(F.col("width"), F.size("ret") - 1),
        lambda i: F.struct(
            i.alias("bar_pos"),
            F.slice("ret", i - F.col("width") + 1, F.col("width")).alias("raw"),
            F.get("ret", i).alias("target")))
    return rows.select("fold_id", "symbol", F.inline(cut)).filter(
        F.forall("raw", lambda v: v.isNotNull())
    ).select("fold_id", "symbol", "bar_pos", left_pad(F.col("raw"), spec.max_lags).alias("x"), "target")


def window_scale(windows: DataFrame) -> DataFrame:
    """(fold_id, scale_mean, scale_std, n_windows): one mean and one population deviation
    over all values of a fold; a zero deviation counts as one."""
    values = windows.select("fold_id", F.explode("x").alias("v"))
    spread = F.stddev_pop("v")
    return values.groupBy("fold_id").agg(
        F.avg("v").alias("scale_mean"),
        F.when(spread > 0, spread).otherwise(1.0).alias("scale_std"),
        F.count(F.lit(1)).alias("n_values"))


def standardize(windows: DataFrame, scale: DataFrame) -> DataFrame:
    z: Column = F.transform("x", lambda v: (v - F.col("scale_mean")) / F.col("scale_std"))
    return windows.join(scale, "fold_id").withColumn("x", z).drop(
        "scale_mean", "scale_std", "n_values")


def pool_codes(codes: DataFrame, min_windows: int, unit_rows: bool, times: str | None = None) -> DataFrame:
    """(fold_id, symbol, embedding): unit-length mean code of each symbol with enough windows.

    ``unit_rows`` scales every code to unit length before the mean. Column ``times`` tells of how many windows a code is the mean.
    """
    code = unit_vector(F.col("code")) if unit_rows else F.col("code")
    held = F.lit(1) if times is None else F.col(times)
    pooled = codes.withColumn("v", array_to_vector(code)).groupBy("fold_id", "symbol").agg(
        Summarizer.mean(F.col("v"), held.cast("double")).alias("mean"), F.sum(held).alias("n_windows"))
    return pooled.filter(F.col("n_windows") >= min_windows).select(
        "fold_id", "symbol", unit_vector(vector_to_array("mean")).alias("embedding"))


def enough(rows: DataFrame, at_least: int) -> DataFrame:
    """Rows of the folds that have at least ``at_least`` rows."""
    counts = rows.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(counts.filter(F.col("n") >= at_least).select("fold_id"), "fold_id", "left_semi")
