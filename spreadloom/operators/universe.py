"""Which symbols a fold may use: coverage of the train grid, then liquidity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import Eligibility, FoldPlan
from ..functions.numeric import finite
from ..staging import lanes, stage
from .folds import train_folds


# Buckets of a summary for each factor e of the value. Few make the summary small, many the bracket of the median.
SUMMARY_BUCKETS = 16
SPAN_BUCKETS, SPLITS = 64, 4096


def value_bucket(value: Column, per_e: int) -> Column:
    """A number that never falls as the value grows, about ``per_e`` of them for each factor e."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * per_e)).cast("bigint")


def middle_ranks(n: Column) -> tuple[Column, Column]:
    return F.floor((n + 1) / 2), F.floor((n + 2) / 2)


def middle_brackets(counts: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, lo_bucket, hi_bucket, low, high, lo_rank, hi_rank): the buckets that hold the two middle ranks of each key.

    ``counts`` has keys, bucket, held, low and high (least and greatest value), and either
    the ranks wanted or none, for the middle ones of all. The ranks returned are those
    inside the bracket.
    """
    up_to = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    if "lo_rank" not in counts.columns:
        lo, hi = middle_ranks(F.sum("held").over(W.partitionBy(*keys)))
        counts = counts.withColumn("lo_rank", lo).withColumn("hi_rank", hi)
    through = counts.withColumn("through", F.sum("held").over(up_to)).withColumn("before", F.col("through") - F.col("held"))
    held = through.filter((F.col("through") >= F.col("lo_rank")) & (F.col("before") < F.col("hi_rank")))
    return held.groupBy(*keys).agg(
        F.min("bucket").alias("lo_bucket"), F.max("bucket").alias("hi_bucket"), F.min("low").alias("low"), F.max("high").alias("high"),
        (F.min("lo_rank") - F.min("before")).alias("lo_rank"), (F.min("hi_rank") - F.min("before")).alias("hi_rank"),
        *[F.first(c).alias(c) for c in carry])


def exact_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact median of ``value`` per ``key``; neither a key nor its distinct values are gathered.

    Values are counted in buckets of about 1.6 percent, with partial counts in every task; the
    bucket of the middle ranks is split in 4,096 equal parts and counted again; only what
    falls in the part of the middle ranks is ranked value by value. Every step reads the
    rows anew and shuffles counts; the brackets are one row per key, staged, so that their
    true size decides how they are joined.
    """
    v = F.col(value)
    rows = df.filter(v.isNotNull() & F.col(key).isNotNull()).select(key, v.alias("value"))
    least = (F.count(F.lit(1)).alias("held"), F.min("value").alias("low"), F.max("value").alias("high"))
    coarse = stage(middle_brackets(
        rows.groupBy(key, value_bucket(F.col("value"), SPAN_BUCKETS).alias("bucket")).agg(*least), [key]), "coarse-medians")

    def inside(brackets: DataFrame) -> DataFrame:
        return rows.join(brackets, key).filter(F.col("value").between(F.col("low"), F.col("high")))

    part = F.least(F.floor(F.coalesce(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * SPLITS),
                   F.lit(SPLITS - 1))
    fine = stage(middle_brackets(
        inside(coarse.drop("lo_bucket", "hi_bucket")).groupBy(key, part.alias("bucket"), "lo_rank", "hi_rank").agg(*least),
        [key]), "fine-medians")
    equal = inside(fine).groupBy(key, "value", "lo_rank", "hi_rank").agg(F.count(F.lit(1)).alias("held"))
    placed = equal.withColumn("last", F.sum("held").over(W.partitionBy(key).orderBy("value")))

    def at(rank: str) -> Column:
        return F.max(F.when(F.col(rank).between(F.col("last") - F.col("held") + 1, F.col("last")), F.col("value")))

    return placed.groupBy(key).agg(((at("lo_rank") + at("hi_rank")) / 2).alias("median"))


def liquid_symbols(bars: DataFrame, top_n: int = 150,
                   days: tuple[str, str] | None = None) -> DataFrame:
    """(symbol, median_dv, rank): the ``top_n`` symbols by median per-bar dollar volume.

    Works on raw bars, copies included; ``days`` limits the local days.
    """
    rows = bars
    if days is not None:
        rows = rows.filter(F.col("day").between(
            F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date")))
    rows = rows.select("symbol", finite(F.col("close") * F.col("volume")).alias("dollar_vol"))
    medians = exact_median(rows, "symbol", "dollar_vol").withColumnRenamed("median", "median_dv")
    top = medians.orderBy(F.desc("median_dv"), "symbol").limit(top_n)
    return top.withColumn(
        "rank", F.row_number().over(W.orderBy(F.desc("median_dv"), F.asc("symbol"))))


def span_coverage(panel: DataFrame, n_bars) -> DataFrame:
    """Share of the whole grid on which each symbol has a close."""
    return panel.groupBy("symbol").agg((F.count("close") / n_bars).alias("coverage"))


def fold_coverage(panel: DataFrame, folds: DataFrame, plan: FoldPlan) -> DataFrame:
    """(fold_id, symbol, coverage, median_dv) on each train window, before any fill.

    Train windows overlap, but each is made of whole units of days. So every bar is
    counted once, in a summary per (symbol, unit): bars by bucket of their volume. A fold's
    summary is the sum of its units', computed where the symbol's summary lies; it tells
    the coverage and the buckets that hold the median. Only the bars in these buckets
    are read again for the folds they belong to, about a thirtieth of a fold each.
    """
    unit = math.gcd(plan.train_days, plan.roll_days)
    rows = panel.filter(F.col("close").isNotNull()).select(
        "symbol", F.floor(F.col("day_idx") / unit).alias("unit"), "n_days", "dollar_vol",
        value_bucket(F.col("dollar_vol"), SUMMARY_BUCKETS).alias("bucket"))
    summary = rows.groupBy("symbol", "unit", "n_days", "bucket").agg(F.count(F.lit(1)).alias("held"))
    first_day = F.col("unit") * unit
    ids = train_folds(first_day, first_day + unit - 1, F.col("n_days"), plan)
    # Dealt by symbol once; the folds' sums and windows below need no further exchange.
    # By number: a summary is a few bytes, which the folds that hold it multiply.
    merged = (summary.repartition(lanes(panel.sparkSession), "symbol").withColumn("fold_id", F.explode(ids))
              .groupBy("fold_id", "symbol", "bucket").agg(F.sum("held").alias("held")))
    # In the order of the buckets, so that one sort serves all windows.
    whole = W.partitionBy("fold_id", "symbol").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counts = merged.withColumn("observed", F.sum("held").over(whole)).withColumn(
        "low", F.lit(None).cast("double")).withColumn("high", F.col("low"))
    # Bars without a volume count for the coverage only; a symbol of only such bars has no median.
    valued = F.sum(F.when(F.col("bucket").isNotNull(), F.col("held"))).over(whole)
    lo, hi = middle_ranks(F.coalesce(valued, F.lit(0)))
    ranked = counts.withColumn("valued", valued).withColumn("lo_rank", lo).withColumn("hi_rank", hi)
    held = ranked.filter(F.col("bucket").isNotNull() | F.col("valued").isNull())
    brackets = stage(middle_brackets(held, ["fold_id", "symbol"], carry=("observed",)), "median-brackets")
    reach = brackets.select("fold_id", "symbol", "lo_rank", "hi_rank", F.explode(F.array_distinct(F.array("lo_bucket", "hi_bucket"))).alias("bucket"))
    first_unit = F.col("fold_id") * (plan.roll_days // unit)
    bars = rows.join(reach, ["symbol", "bucket"]).filter(
        F.col("unit").between(first_unit, first_unit + plan.train_days // unit - 1))
    middle = bars.groupBy("fold_id", "symbol").agg(
        F.sort_array(F.collect_list("dollar_vol")).alias("values"), F.first("lo_rank").alias("lo"), F.first("hi_rank").alias("hi"))

    def at(rank: str) -> Column:
        return F.element_at("values", F.col(rank).cast("int"))

    medians = middle.select("fold_id", "symbol", ((at("lo") + at("hi")) / 2).alias("median_dv"))
    sized = folds.select("fold_id", (F.col("train_hi") - F.col("train_lo") + 1).alias("grid"))
    return (brackets.join(sized, "fold_id").join(medians, ["fold_id", "symbol"], "left")
            .select("fold_id", "symbol", (F.col("observed") / F.col("grid")).alias("coverage"), "median_dv"))


def fold_universe(panel: DataFrame, folds: DataFrame, plan: FoldPlan,
                  rule: Eligibility = Eligibility()) -> DataFrame:
    """(fold_id, symbol, coverage, median_dv, uni_rank, n_universe).

    ``uni_rank`` orders a fold's symbols and so orients its pairs: by liquidity
    when more symbols are covered than may stay, else by name.
    """
    covered = fold_coverage(panel, folds, plan).filter(F.col("coverage") >= rule.min_coverage)
    return rank_universe(covered, rule.top_n_liquid)


def rank_universe(covered: DataFrame, top_n: int | None) -> DataFrame:
    by_name = W.partitionBy("fold_id").orderBy("symbol")
    sizes = covered.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_covered"))
    if top_n is None:
        return covered.join(sizes, "fold_id").withColumn(
            "uni_rank", F.row_number().over(by_name)
        ).withColumnRenamed("n_covered", "n_universe")
    top = liquid_in_fold(covered, top_n)
    crowded = F.col("n_covered") > top_n
    return (
        top.join(sizes, "fold_id")
        .withColumn("uni_rank", F.when(crowded, F.col("dv_rank"))
                    .otherwise(F.row_number().over(by_name)))
        .withColumn("n_universe", F.least(F.col("n_covered"), F.lit(top_n)))
        .drop("dv_rank", "n_covered")
    )


def liquid_then_covered(panel: DataFrame, folds: DataFrame, plan: FoldPlan,
                        rule: Eligibility = Eligibility()) -> DataFrame:
    """The other order: the most liquid symbols of a fold first, then those of them with
    enough coverage, still ordered by liquidity."""
    liquid = liquid_in_fold(fold_coverage(panel, folds, plan), rule.top_n_liquid)
    clean = liquid.filter(F.col("coverage") >= rule.min_coverage)
    by_volume = W.partitionBy("fold_id").orderBy("dv_rank")
    sizes = clean.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_universe"))
    return clean.join(sizes, "fold_id").withColumn(
        "uni_rank", F.row_number().over(by_volume)).drop("dv_rank")


def liquid_in_fold(symbols: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` symbols of each fold by median dollar volume, numbered in ``dv_rank``.

    The rank filter directly on the window lets each task drop all but its own best
    rows before the shuffle.
    """
    by_volume = W.partitionBy("fold_id").orderBy(F.desc_nulls_last("median_dv"), F.asc("symbol"))
    return symbols.withColumn("dv_rank", F.row_number().over(by_volume)).filter(
        F.col("dv_rank") <= top_n)
