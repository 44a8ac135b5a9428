"""The walk-forward run: all folds of an arm in one plan keyed by fold."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from ..config import RunSettings
from ..operators.folds import check_no_lookahead, fold_table, last_bar, stage_guarded
from ..operators.metrics import equity_curve, summarize
from ..operators.pairstats import PAIR, pair_grid
from ..operators.portfolio import active_pairs, fold_portfolio, stitch, with_weight
from ..operators.series import test_series, train_series
from ..operators.signal import evaluate_pairs, extract_trades
from ..operators.universe import fold_universe, liquid_then_covered
from ..staging import side_by_side, stage
from .selection import Selector, TrainData

TRADED = ("alpha", "beta", "mu", "sigma", "half_life", "weight")


@dataclass(frozen=True)
class Market:
    """What all arms of a job share: the panel, its calendar and the train side."""

    panel: DataFrame
    calendar: DataFrame
    folds: DataFrame
    universe: DataFrame
    train: TrainData
    settings: RunSettings


@dataclass(frozen=True)
class ArmResult:
    pairs: DataFrame
    pair_bars: DataFrame | None  # not kept for folds taken from a saved run
    portfolio: DataFrame
    trades: DataFrame
    fold_metrics: DataFrame
    returns: DataFrame
    equity: DataFrame
    aggregate: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"pairs": self.pairs, "trades": self.trades, "fold_metrics": self.fold_metrics,
                "equity": self.equity, "aggregate": self.aggregate}


def open_market(panel: DataFrame, settings: RunSettings = RunSettings(),
                liquid_first: bool = False, calendar: DataFrame | None = None,
                only: DataFrame | None = None) -> Market:
    """Folds, universes and packed train series of a staged panel.

    ``calendar`` is the staged ``grid_calendar`` of the panel's bars; without it the bars of
    the panel are the grid, which is the same unless some bar has no price at all.
    ``liquid_first`` takes the most liquid symbols before it asks for coverage. ``only`` names
    the folds (fold_id) that are wanted; nothing is derived for the others.
    """
    if calendar is None:
        calendar = stage(
            panel.select("bar_ts", "day", "day_idx", "bar_seq", "n_days").distinct(), "calendar")
    folds = check_no_lookahead(fold_table(calendar, settings.folds))
    folds = stage(folds if only is None else folds.join(only.select("fold_id"), "fold_id", "left_semi"), "folds")
    pick = liquid_then_covered if liquid_first else fold_universe
    universe = stage(pick(panel, folds, settings.folds, settings.eligibility), "universe")
    series = stage_guarded(train_series(panel, folds, universe, settings.folds), "train-series", folds,
                           "test_lo", last_bar("ret") - F.col("test_lo") + 1)
    return Market(panel, calendar, folds, universe, TrainData(series, folds), settings)


def trade_test(market: Market, pairs: DataFrame) -> DataFrame:
    """Every bar of every selected pair on its fold's test window."""
    s = market.settings
    series = test_series(market.panel, market.folds, pairs, s.folds)
    grid = pair_grid(with_weight(pairs).select(*PAIR, *TRADED), series, market.folds, "test")
    return evaluate_pairs(grid, s.rule).drop("first_seq", "width", "block")


def trade_log(pair_bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trades with their bar times and the weight of their pair."""
    trades = extract_trades(pair_bars, carry=("weight",))
    times = calendar.select("bar_seq", "bar_ts")
    entry = times.select(F.col("bar_seq").alias("entry_seq"), F.col("bar_ts").alias("entry_ts"))
    exit_ = times.select(F.col("bar_seq").alias("exit_seq"), F.col("bar_ts").alias("exit_ts"))
    return trades.join(entry, "entry_seq").join(exit_, "exit_seq").select(
        *PAIR, "side", "entry_ts", "exit_ts", "holding_bars", "pnl", "weight")


def restricted(market: Market, only: DataFrame) -> Market:
    """The market with the folds of ``only`` (fold_id) alone."""
    def kept(df: DataFrame) -> DataFrame:
        return df.join(only.select("fold_id"), "fold_id", "left_semi")

    folds = stage(kept(market.folds), "folds")
    return replace(market, folds=folds, universe=kept(market.universe),
                   train=replace(market.train, series=kept(market.train.series), folds=folds))


@dataclass(frozen=True)
class FoldResults:
    """What each fold gives by itself; an arm is made of these."""

    pairs: DataFrame
    trades: DataFrame
    portfolio: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"pairs": self.pairs, "trades": self.trades, "portfolio": self.portfolio}


def run_folds(market: Market, selector: Selector, arm: str) -> tuple[FoldResults, DataFrame]:
    """Select on the train windows and trade the test windows; also every bar of every pair."""
    pairs = stage(selector(market.train), f"{arm}-pairs")
    pair_bars = stage_guarded(trade_test(market, pairs), f"{arm}-bars", market.folds,
                              "train_hi", F.col("train_hi") - F.col("bar_seq") + 1)
    trades, portfolio = side_by_side([
        lambda: stage(trade_log(pair_bars, market.calendar), f"{arm}-trades"),
        lambda: stage(fold_portfolio(pair_bars, market.folds), f"{arm}-portfolio")])
    return FoldResults(pairs, trades, portfolio), pair_bars


def assemble(results: FoldResults, calendar: DataFrame, folds: DataFrame, arm: str, bars_per_year: int,
             pair_bars: DataFrame | None = None) -> ArmResult:
    """Stitch the folds of an arm and measure them."""
    tag = F.lit(arm).alias("arm")
    counts = active_pairs(results.pairs, folds)
    per_fold = summarize(results.portfolio, ["fold_id"], "fold_id", results.trades, counts, bars_per_year)
    fold_metrics = folds.select(
        "fold_id", "train_start", "train_end", "test_start", "test_end").join(per_fold, "fold_id")
    returns = stitch(results.portfolio).join(calendar.select("bar_seq", "bar_ts"), "bar_seq")
    keyed = returns.select(tag, "*")
    curve = equity_curve(keyed, ["arm"], "fold_id")
    aggregate = summarize(
        keyed, ["arm"], "fold_id", results.trades.select(tag, "*"),
        counts.agg(F.avg("n_active_pairs").alias("n_active_pairs")).select(tag, "*"), bars_per_year)
    return ArmResult(
        pairs=results.pairs.select(tag, "*"), pair_bars=None if pair_bars is None else pair_bars.select(tag, "*"),
        portfolio=results.portfolio.select(tag, "*"), trades=results.trades.select(tag, "*"),
        fold_metrics=fold_metrics.select(tag, "*"), returns=keyed, equity=curve, aggregate=aggregate)


def run_arm(market: Market, selector: Selector, arm: str) -> ArmResult:
    """Select on the train windows, trade the test windows, stitch and measure."""
    results, pair_bars = run_folds(market, selector, arm)
    return assemble(results, market.calendar, market.folds, arm, market.settings.clock.bars_per_year, pair_bars)
