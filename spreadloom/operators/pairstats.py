"""Train-side statistics of candidate pairs, and the eligibility filter.

Every step is a window or an aggregate over (fold, pair) on one partitioning:
the packed legs are joined, spread over tasks by pair, and unpacked in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import Eligibility
from ..functions.numeric import bp_p_value
from ..staging import lanes

PAIR = ("fold_id", "sym_a", "sym_b")

MIN_OLS_ROWS = 10
MIN_SPREAD_ROWS = 20
MIN_BP_ROWS = 60


def pair_grid(pairs: DataFrame, series: DataFrame, folds: DataFrame | None = None,
              side: str = "train", returns: bool = True) -> DataFrame:
    """One row per (pair, grid bar): pair columns, first_seq, bar_seq, close_a/b and, with ``returns``, ret_a/b.

    With ``folds`` a pair keeps its full grid of empty bars when a leg has no
    bar at all in the window; without, such a pair has no rows.
    """
    values = ("close", "ret") if returns else ("close",)

    def leg(tag: str) -> DataFrame:
        return series.select("fold_id", F.col("symbol").alias(f"sym_{tag}"), F.col("lo").alias(f"lo_{tag}"),
                             *[F.col(v).alias(f"{v}_{tag}") for v in values])

    packed = [f"{v}_{tag}" for v in values for tag in ("a", "b")]
    how = "inner" if folds is None else "left"
    both = pairs.join(leg("a"), ["fold_id", "sym_a"], how).join(leg("b"), ["fold_id", "sym_b"], how)
    if folds is None:
        both = both.withColumn("lo", F.col("lo_a"))
    else:
        bounds = folds.select("fold_id", F.col(f"{side}_lo").alias("lo"),
                              (F.col(f"{side}_hi") - F.col(f"{side}_lo") + 1).cast("int").alias("grid"))
        empty = F.array_repeat(F.lit(None).cast("double"), F.col("grid"))
        both = both.join(bounds, "fold_id").withColumns({c: F.coalesce(F.col(c), empty) for c in packed})
    keyed = both.repartition(lanes(pairs.sparkSession), *PAIR)
    kept = [F.col(c) for c in pairs.columns]
    return keyed.select(*kept, "lo", F.posexplode(F.arrays_zip(*packed))).select(
        *kept, F.col("lo").alias("first_seq"), (F.col("lo") + F.col("pos")).alias("bar_seq"), *[F.col(f"col.{c}").alias(c) for c in packed])


def residual(log_a: Column, log_b: Column, alpha: Column, beta: Column) -> Column:
    return log_a - (alpha + beta * log_b)


def aligned_logs(grid: DataFrame) -> DataFrame:
    """Bars on which both legs have a log price."""
    logs = grid.withColumn("log_a", F.ln("close_a")).withColumn("log_b", F.ln("close_b"))
    return logs.filter(F.col("log_a").isNotNull() & F.col("log_b").isNotNull())


def hedge_ratios(grid: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """(pair, n_rows, alpha, beta): least squares of log a on log b, NULL if too short."""
    rows = aligned_logs(grid)
    enough = F.count(F.lit(1)) >= MIN_OLS_ROWS
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.when(enough, F.regr_intercept("log_a", "log_b")).alias("alpha"),
        F.when(enough, F.regr_slope("log_a", "log_b")).alias("beta"),
    )


def half_life(slope: Column, n_rows: Column) -> Column:
    """Bars until a shock has halved; NULL when the spread does not revert."""
    reverting = (n_rows >= MIN_SPREAD_ROWS) & (slope < 0) & (slope > -1)
    return F.when(reverting, -F.ln(F.lit(2.0)) / F.ln(1 + slope))


def pair_statistics(grid: DataFrame, keys: tuple[str, ...] = PAIR,
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """(pair, n_rows, alpha, beta, mu, sigma, half_life, bp_stat) of each pair.

    The regression runs as a window over the pair, so its residuals are at hand
    in the same pass for the spread moments, the reversion regression and the
    heteroskedasticity statistic (n times R2 of squared residuals on log b).
    """
    rows = aligned_logs(grid).select(*keys, *carry, "bar_seq", "log_a", "log_b")
    # Both windows are in time order, so that one sort serves them.
    in_time = W.partitionBy(*keys).orderBy("bar_seq")
    whole = in_time.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    spreads = (
        rows
        .withColumn("beta", F.regr_slope("log_a", "log_b").over(whole))
        .withColumn("alpha", F.regr_intercept("log_a", "log_b").over(whole))
        .withColumn("spread", residual(F.col("log_a"), F.col("log_b"), F.col("alpha"), F.col("beta")))
        .withColumn("before", F.lag("spread").over(in_time))
        .withColumn("step", F.col("spread") - F.col("before"))
        .withColumn("squared", F.col("spread") * F.col("spread"))
    )
    n = F.count(F.lit(1))
    stats = spreads.groupBy(*keys).agg(
        n.alias("n_rows"),
        F.first("alpha").alias("alpha"), F.first("beta").alias("beta"),
        F.avg("spread").alias("mu"), F.stddev_samp("spread").alias("sigma"),
        F.regr_slope("step", "before").alias("reversion"),
        F.when(n >= MIN_BP_ROWS, n * F.regr_r2("squared", "log_b")).alias("bp_stat"),
        *[F.first(c).alias(c) for c in carry],
    )
    fitted = (
        (F.col("n_rows") >= MIN_SPREAD_ROWS) & F.col("beta").isNotNull()
        & (F.col("beta") != 0) & (F.col("sigma") > 0)
    )
    return stats.filter(fitted).select(
        *keys, *carry, "n_rows", "alpha", "beta", "mu", "sigma",
        half_life(F.col("reversion"), F.col("n_rows")).alias("half_life"), "bp_stat")


def eligible_pairs(stats: DataFrame, rule: Eligibility = Eligibility()) -> DataFrame:
    """Pairs with a positive hedge ratio, even residual variance, a half-life in
    range and enough spread volatility."""
    lm, limit = F.col("bp_stat"), F.lit(rule.bp_critical)
    even = lm < limit if rule.bp_strict else lm <= limit
    return stats.filter(
        (F.col("beta") > 0) & even
        & F.col("half_life").between(rule.half_life_min, rule.half_life_max)
        & (F.col("sigma") >= rule.min_spread_vol)
    )


def with_p_value(stats: DataFrame) -> DataFrame:
    return stats.withColumn("bp_pval", bp_p_value(F.col("bp_stat")))


def cap_pairs(scored: DataFrame, rule: Eligibility = Eligibility()) -> DataFrame:
    """The best ``max_pairs`` of each fold, numbered in ``rank``; ties keep candidate order."""
    first = F.desc("train_sharpe") if rule.rank_by == "train_sharpe" else F.asc("half_life")
    best = W.partitionBy("fold_id").orderBy(first, F.asc("cand_rank"))
    return scored.withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= rule.max_pairs)
