"""Return, drawdown, trade and turnover metrics, one row per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import MarketClock

BARS_PER_YEAR = MarketClock().bars_per_year


def sharpe(ret: Column, bars_per_year: int = BARS_PER_YEAR) -> Column:
    """Annualized mean over deviation; zero for fewer than two bars or no deviation."""
    ratio = F.try_divide(F.avg(ret), F.stddev_samp(ret)) * F.sqrt(F.lit(float(bars_per_year)))
    return F.coalesce(F.when(F.count(ret) >= 2, ratio), F.lit(0.0))


def growth(ret: Column) -> Column:
    return F.product(1 + F.coalesce(ret, F.lit(0.0)))


def total_return(ret: Column) -> Column:
    return F.coalesce(growth(ret) - 1, F.lit(0.0))


def annualized_return(ret: Column, bars_per_year: int = BARS_PER_YEAR) -> Column:
    g = growth(ret)
    n = F.count(F.lit(1))
    grown = F.pow(g, F.lit(float(bars_per_year)) / n) - 1
    return F.when(n == 0, 0.0).when(g <= 0, -1.0).otherwise(grown)


def hit_rate(ret: Column) -> Column:
    """Share of positive bars among the non-zero ones."""
    return F.coalesce(F.avg(F.when(ret != 0, (ret > 0).cast("double"))), F.lit(0.0))


def turnover_stats(bars_per_year: int = BARS_PER_YEAR) -> list[Column]:
    mean = F.coalesce(F.avg(F.coalesce("turnover", F.lit(0.0))), F.lit(0.0))
    return [(mean * bars_per_year).alias("turnover_annualized"), mean.alias("turnover_per_bar")]


def trade_stats(trades: DataFrame, keys: list[str]) -> DataFrame:
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("trade_win_rate"),
        F.avg("holding_bars").alias("avg_holding_bars"),
        F.avg("pnl").alias("avg_trade_pnl"),
    )


def equity_curve(returns: DataFrame, keys: list[str], segment: str, seq: str = "bar_seq") -> DataFrame:
    """Add ``equity``, ``peak`` and ``drawdown`` along ``seq`` within ``keys``.

    Compounded per ``segment`` (a run of bars, here the fold) and then shifted by
    the product of the earlier segments, so that a long curve is a parallel scan
    rather than one ordered task. The peak starts at the first equity value.
    """
    inside = W.partitionBy(*keys, segment).orderBy(seq)
    grown = returns.withColumn(
        "own", F.product(1 + F.coalesce(F.col("ret"), F.lit(0.0))).over(
            inside.rowsBetween(W.unboundedPreceding, 0))
    ).withColumn("own_peak", F.max("own").over(inside))
    ends = grown.groupBy(*keys, segment).agg(
        F.max_by("own", seq).alias("through"), F.max("own").alias("top"))
    # A key-less curve has one group of segments, which is as many rows as folds.
    over = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(segment)
    earlier = over.rowsBetween(W.unboundedPreceding, -1)
    shifts = ends.withColumn(
        "base", F.coalesce(F.product("through").over(earlier), F.lit(1.0))
    ).withColumn("base_peak", F.max(F.col("base") * F.col("top")).over(earlier))
    joined = grown.join(shifts.select(*keys, segment, "base", "base_peak"), [*keys, segment])
    equity = F.col("base") * F.col("own")
    peak = F.greatest(F.col("base_peak"), F.col("base") * F.col("own_peak"))
    return (
        joined.withColumn("equity", equity).withColumn("peak", peak)
        .withColumn("drawdown", F.col("equity") / F.col("peak") - 1)
        .drop("own", "own_peak", "base", "base_peak")
    )


def summarize(returns: DataFrame, keys: list[str], segment: str,
              trades: DataFrame | None = None, pair_counts: DataFrame | None = None,
              bars_per_year: int = BARS_PER_YEAR) -> DataFrame:
    """The metric bundle per ``keys``; trade columns are NULL for a group without trades."""
    ret = F.col("ret")
    curve = equity_curve(returns, keys, segment)
    out = curve.groupBy(*keys).agg(
        sharpe(ret, bars_per_year).alias("sharpe_annualized"),
        total_return(ret).alias("return_total"),
        annualized_return(ret, bars_per_year).alias("return_annualized"),
        F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        hit_rate(ret).alias("hit_rate_bars"),
        F.count(F.lit(1)).alias("n_bars"),
        *turnover_stats(bars_per_year),
    )
    if trades is not None:
        out = out.join(trade_stats(trades, keys), keys, "left")
    if pair_counts is not None:
        out = out.join(pair_counts, keys, "left").withColumn(
            "n_active_pairs", F.coalesce("n_active_pairs", F.lit(0.0)))
    return out
