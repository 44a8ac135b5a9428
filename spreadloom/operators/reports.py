"""Reports over saved result tables. Every function takes tables of several arms at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import clip, pair_key, pair_label
from .metrics import BARS_PER_YEAR, annualized_return, sharpe

# The cost grid in basis points per side, the cost the runs were made with.
COST_GRID_BPS = (0.0, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0)
BASE_COST = 0.0005

# The headline lines as (label, metric, number of decimals, in percent).
HEADLINE = (
    ("Annualized Sharpe", "sharpe_annualized", 2, False),
    ("Total return (net)", "return_total", 1, True),
    ("Annualized return", "return_annualized", 2, True),
    ("Max drawdown", "max_drawdown", 1, True),
    ("Annualized turnover", "turnover_annualized", 1, False),
    ("# trades", "n_trades", 0, False),
    ("Trade win rate", "trade_win_rate", 1, True),
    ("Avg holding (bars)", "avg_holding_bars", 0, False),
    ("Avg pairs/fold", "n_active_pairs", 1, False),
    ("% folds Sharpe>0", "share_positive", 0, True),
)


def union_arms(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def percent_change(equity: DataFrame) -> DataFrame:
    """(arm, bar_seq, fold_id, ret): relative change of equity, zero on an arm's first bar.

    The previous bar of a segment's first bar is the last one of the segment before,
    which the curve knows without an ordering over the whole arm: it is
    ``equity / (1 + ret)``; only the first bar of the curve has no predecessor.
    """
    before = F.lag("equity").over(W.partitionBy("arm", "fold_id").orderBy("bar_seq"))
    ends = equity.groupBy("arm", "fold_id").agg(
        F.max_by("equity", "bar_seq").alias("end_equity"))
    by_fold = W.partitionBy("arm").orderBy("fold_id")
    entries = ends.select("arm", "fold_id", F.lag("end_equity").over(by_fold).alias("entry_equity"))
    rows = equity.withColumn("before", before).join(entries, ["arm", "fold_id"])
    previous = F.coalesce("before", "entry_equity")
    return rows.select("arm", "fold_id", "bar_seq",
                       F.coalesce(F.try_divide(F.col("equity"), previous) - 1, F.lit(0.0)).alias("ret"))


def cost_sensitivity(equity: DataFrame, aggregate: DataFrame, costs: tuple[float, ...] = COST_GRID_BPS,
                     base_cost: float = BASE_COST, bars_per_year: int = BARS_PER_YEAR) -> DataFrame:
    """(arm, cost_bps, sharpe, ann_return) had trading cost something else per side.

    The arm's mean turnover is charged on every bar.
    """
    mean_turnover = aggregate.select("arm", "turnover_per_bar")
    rows = percent_change(equity).join(mean_turnover, "arm").withColumn(
        "cost_bps", F.explode(F.array(*[F.lit(c) for c in costs])))
    gross = F.col("ret") + F.col("turnover_per_bar") * base_cost
    net = gross - F.col("turnover_per_bar") * (F.col("cost_bps") * 1e-4)
    return rows.withColumn("net", net).groupBy("arm", "cost_bps").agg(
        sharpe(F.col("net"), bars_per_year).alias("sharpe"),
        annualized_return(F.col("net"), bars_per_year).alias("ann_return"))


def panel_summary(panel: DataFrame, calendar: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row: n_symbols, n_above (covered at ``threshold``), total_bars, first_bar, last_bar."""
    grid = calendar.agg(F.count(F.lit(1)).alias("total_bars"), F.min("bar_ts").alias("first_bar"),
                        F.max("bar_ts").alias("last_bar"))
    bars = grid.select("total_bars").scalar()
    symbols = panel.groupBy("symbol").agg((F.count("close") / bars).alias("coverage"))
    return symbols.agg(
        F.count(F.lit(1)).alias("n_symbols"),
        F.count_if(F.col("coverage") >= threshold).alias("n_above"),
        *[grid.select(c).scalar().alias(c) for c in ("total_bars", "first_bar", "last_bar")])


def active_symbols(panel: DataFrame) -> DataFrame:
    """(month, n_symbols): symbols with a close in each local month.

    Deduplicated per (month, symbol) before the count, so no month is one group.
    """
    seen = panel.filter(F.col("close").isNotNull()).select(
        F.trunc("day", "month").alias("month"), "symbol").distinct()
    return seen.groupBy("month").agg(F.count(F.lit(1)).alias("n_symbols"))


def most_traded(trades: DataFrame, top: int = 15) -> DataFrame:
    """(arm, pair, n_trades, place): the most traded pairs of each arm."""
    counts = trades.groupBy("arm", pair_label(F.col("sym_a"), F.col("sym_b")).alias("pair")).agg(
        F.count(F.lit(1)).alias("n_trades"))
    place = F.row_number().over(W.partitionBy("arm").orderBy(F.desc("n_trades"), F.asc("pair")))
    return counts.withColumn("place", place).filter(F.col("place") <= top)


def distinct_pairs(trades: DataFrame) -> DataFrame:
    a, b = pair_key(F.col("sym_a"), F.col("sym_b"))
    return trades.select("arm", a.alias("sym_a"), b.alias("sym_b")).distinct()


def unique_pair_counts(trades: DataFrame) -> DataFrame:
    return distinct_pairs(trades).groupBy("arm").agg(F.count(F.lit(1)).alias("unique_pairs"))


def pair_overlap(trades: DataFrame, arms: list[str]) -> DataFrame:
    """(arm_1, arm_2, n_both, n_either, jaccard) of the traded pairs of every two arms.

    Each pair is gathered once with the set of arms that trade it, so the result
    grows with pairs and not with pairs of trades.
    """
    held = distinct_pairs(trades).groupBy("sym_a", "sym_b").agg(F.collect_set("arm").alias("arms"))
    combos = F.array(*[F.struct(F.lit(x).alias("arm_1"), F.lit(y).alias("arm_2"))
                       for x in arms for y in arms])
    one, two = (F.array_contains("arms", F.col(c)) for c in ("arm_1", "arm_2"))
    rows = held.select("arms", F.inline(combos))
    counted = rows.groupBy("arm_1", "arm_2").agg(
        F.count_if(one & two).alias("n_both"), F.count_if(one | two).alias("n_either"))
    return counted.withColumn(
        "jaccard", F.coalesce(F.try_divide(F.col("n_both"), F.col("n_either")), F.lit(0.0)))


def fold_return_matrix(fold_metrics: DataFrame, arms: list[str]) -> DataFrame:
    return fold_metrics.groupBy("test_start").pivot("arm", arms).agg(F.first("return_total"))


def equity_table(equity: DataFrame, arms: list[str]) -> DataFrame:
    """One column of equity per arm on the union of their bars."""
    return equity.groupBy("bar_ts").pivot("arm", arms).agg(F.first("equity"))


def positive_fold_share(fold_metrics: DataFrame) -> DataFrame:
    return fold_metrics.groupBy("arm").agg(
        F.avg((F.col("sharpe_annualized") > 0).cast("double")).alias("share_positive"))


def arm_summary(aggregates: DataFrame, fold_metrics: DataFrame) -> DataFrame:
    return aggregates.join(positive_fold_share(fold_metrics), "arm")


def headline_values(summary: DataFrame, arms: list[str]) -> DataFrame:
    """(line, metric, one column per arm), numbers not yet formatted."""
    lines = F.array(*[
        F.struct(F.lit(i).alias("line"), F.lit(label).alias("metric"),
                 F.col(column).cast("double").alias("value"))
        for i, (label, column, _, _) in enumerate(HEADLINE)])
    return summary.select("arm", F.inline(lines)).groupBy("line", "metric").pivot("arm", arms).agg(
        F.first("value"))


def headline_table(summary: DataFrame, arms: list[str]) -> DataFrame:
    """The headline lines as text."""
    def text(column: Column) -> Column:
        out = F.lit(None).cast("string")
        for i, (_, _, decimals, percent) in enumerate(HEADLINE):
            shown = F.format_string(f"%.{decimals}f", column * (100.0 if percent else 1.0))
            shown = F.concat(shown, F.lit("%" if percent else ""))
            out = F.when(F.col("line") == i, shown).otherwise(out)
        return F.when(column.isNotNull(), out)

    values = headline_values(summary, arms)
    return values.select("line", "metric", *[text(F.col(a)).alias(a) for a in arms])


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None,
              high: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by…, bin, bin_low, n): equal bins over [low, high], the last one closed.

    A missing border is the least or greatest value of the data. Values outside are
    not counted.
    """
    rows = df.filter(F.col(value).isNotNull())
    lo = F.lit(float(low)) if low is not None else rows.agg(F.min(value)).scalar()
    hi = F.lit(float(high)) if high is not None else rows.agg(F.max(value)).scalar()
    kept = rows.select(*by, F.col(value).cast("double").alias("v"), lo.alias("lo"), hi.alias("hi"))
    place = F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    bin_ = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = kept.filter(F.col("v").between(F.col("lo"), F.col("hi"))).withColumn("bin", bin_)
    return counted.groupBy(*by, "bin").agg(
        F.min(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("bin_low"),
        F.count(F.lit(1)).alias("n"))


def holding_histogram(trades: DataFrame, bins: int = 50, cap: int = 200) -> DataFrame:
    held = trades.withColumn("held", clip(F.col("holding_bars").cast("double"), high=float(cap)))
    return histogram(held, "held", bins, 0, cap, ("arm",))


def pnl_histogram(trades: DataFrame, bins: int = 50, limit: float = 0.03) -> DataFrame:
    """Per-trade pnl in percent, clipped at both ends."""
    shown = trades.withColumn("pct", clip(F.col("pnl"), -limit, limit) * 100)
    return histogram(shown, "pct", bins, -limit * 100, limit * 100, ("arm",))


def half_life_histogram(fits: DataFrame, bins: int = 40, limit: float = 500.0) -> DataFrame:
    known = fits.filter((F.col("half_life") > 0) & (F.col("half_life") < limit))
    return histogram(known, "half_life", bins, by=("bp_pass",))


def selection_funnel(liquid: DataFrame, clean: DataFrame, candidates: DataFrame, fits: DataFrame) -> DataFrame:
    """(fold_id, n_liquid, n_clean, n_candidates, n_bp_pass, n_bp_fail).

    ``fits`` has a boolean ``bp_pass``, NULL where the test was not possible.
    """
    def tagged(df: DataFrame, stage_name: str) -> DataFrame:
        return df.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "step", F.lit(stage_name))

    counts = union_arms([
        tagged(liquid, "n_liquid"), tagged(clean, "n_clean"), tagged(candidates, "n_candidates"),
        tagged(fits.filter("bp_pass"), "n_bp_pass"), tagged(fits.filter(~F.col("bp_pass")), "n_bp_fail")])
    steps = ["n_liquid", "n_clean", "n_candidates", "n_bp_pass", "n_bp_fail"]
    wide = counts.groupBy("fold_id").pivot("step", steps).agg(F.sum("n"))
    return wide.select("fold_id", *[F.coalesce(s, F.lit(0)).alias(s) for s in steps])
