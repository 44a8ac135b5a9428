"""Panels derived from the given tables, and the settings the catalog runs them with.

``supplier_week``: a symbol per supplier, a bar per week, a price made of a common
factor and the supplier's own trailing demand, a gap where no line was shipped for
two weeks. The number of symbols grows with the data.

``event_half_hour``: a symbol per event type, thirty-minute bars with an open bar at
09:30 New York time and several bars a day.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import replace
from functools import partial
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from spreadloom.config import (
    Eligibility, FoldPlan, GruSpec, MarketClock, RunSettings, TradeRule)
from spreadloom.operators.autoregression import ar_fits
from spreadloom.operators.correlation import correlated_pairs
from spreadloom.operators.panel import build_panel, grid_calendar
from spreadloom.operators.reports import union_arms
from spreadloom.operators.windows import pool_codes, tumbling_windows
from spreadloom.plans.walk_forward import open_market, run_arm
from spreadloom.plans import selection
from spreadloom.staging import lanes, side_by_side, stage

SPAN_WEEKS = 20
# Two lags, so that SQL can give the fit in closed form.
SHORT_AR = GruSpec(max_lags=2, ar_cutoff=0.1)
WEEK_CLOCK = MarketClock(zone="UTC", open_time="none", bars_per_year=52)
WEEK_FOLDS = FoldPlan(train_days=104, test_days=26, roll_days=26)

WEEKLY = RunSettings(
    clock=WEEK_CLOCK,
    folds=WEEK_FOLDS,
    rule=TradeRule(z_entry=1.5, z_exit=0.5, z_stop=2.5),
)

# The same without a cap on the universe, for operators whose feature is not the cap.
OPEN = replace(WEEKLY, eligibility=replace(WEEKLY.eligibility, top_n_liquid=None))

WEEKLY_BASELINE = RunSettings(
    clock=WEEK_CLOCK,
    folds=WEEK_FOLDS,
    rule=TradeRule(z_entry=1.5, z_exit=0.5, z_stop=2.5, full_window=True),
    eligibility=Eligibility(min_coverage=0.98, bp_strict=True,
                            half_life_min=2.0, rank_by="half_life"),
)

EVENT_CLOCK = MarketClock()
EVENT_FOLDS = FoldPlan(train_days=12, test_days=4, roll_days=4)
EVENTS = RunSettings(clock=EVENT_CLOCK, folds=EVENT_FOLDS,
                     eligibility=Eligibility(min_coverage=0.0, top_n_liquid=None))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def supplier_week_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, bar_ts, close, volume) without gaps rows."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")

    def week_of(time: str):
        # The number of its Monday: weeks are counted, compared and sorted as plain numbers.
        return F.unix_date(F.trunc(F.col(time).cast("date"), "week"))

    span = lines.agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    # One row of dates, attached to the suppliers' weeks by a scalar subquery.
    first, last = span.select(week_of("first")).scalar(), span.select(week_of("last")).scalar()
    # Lines are dealt by supplier and by number, since a supplier's weeks are more bytes than its lines. All that follows
    # keeps to this one shuffle: a week with lines makes the empty weeks up to the next one, so no grid is joined.
    weekly = (lines.filter("l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL").withColumn("week", week_of("l_shipdate"))
              .repartition(lanes(spark), "l_suppkey").groupBy("l_suppkey", "week").agg(
                  F.avg("l_quantity").alias("v"), F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n")))
    by_time = W.partitionBy("l_suppkey").orderBy("week")
    start = F.when(F.lag("week").over(by_time).isNull(), first).otherwise(F.col("week"))
    stop = F.coalesce(F.lead("week").over(by_time) - 7, last)
    made = weekly.withColumn("start", start).withColumn("stop", stop).withColumn(
        "at", F.explode(F.sequence("start", "stop", F.lit(7))))
    own_week = F.col("at") == F.col("week")
    grid = made.select("l_suppkey", F.col("at").alias("week"), *[F.when(own_week, F.col(c)).alias(c) for c in ("v", "qty", "n")])
    dense = (
        grid
        .withColumn("v", F.coalesce("v", F.last("v", True).over(by_time.rowsBetween(-3, 0)), F.lit(25.5)))
        .withColumn("volume", F.sum("qty").over(by_time.rowsBetween(-1, 0)))
        .withColumn("lines", F.sum("n").over(by_time.rowsBetween(-1, 0)))
    )
    whole = W.partitionBy("l_suppkey")
    scaled = dense.withColumn(
        "x", F.try_divide(F.col("v") - F.avg("v").over(whole), F.stddev_pop("v").over(whole)))
    # Written, since the factor is taken from the same rows that it is joined to.
    own = stage(scaled.select("l_suppkey", "week", "x", "volume", "lines", F.avg("x").over(
        by_time.rowsBetween(-(SPAN_WEEKS - 1), 0)).alias("own")), "supplier-grid")
    weeks = own.groupBy("week").agg(F.avg("x").alias("m"))
    # One row per week of the span, whatever the data size.
    all_weeks = W.partitionBy(F.lit(0))
    factor = stage(weeks.withColumn("step", F.col("m") / F.stddev_samp("m").over(all_weeks)).withColumn(
        "factor", F.sum("step").over(all_weeks.orderBy("week"))).select("week", "factor"), "factor")
    return own.filter(F.col("lines") > 0).join(factor, "week").select(
        F.format_string("S%07d", "l_suppkey").alias("symbol"), F.date_from_unix_date("week").cast("timestamp_ntz").alias("bar_ts"),
        F.exp(F.lit(4.0) + 0.02 * F.col("factor") + 0.2 * F.col("own")).alias("close"), "volume")


def event_half_hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, bar_ts, close, volume, file_order): every event is a bar, copies included."""
    half = F.expr("TIMESTAMPADD(MINUTE, -(minute(ts) % 30), date_trunc('minute', ts))")
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), half.cast("timestamp_ntz").alias("bar_ts"),
        (F.col("value") + 1).alias("close"),
        (F.col("user_id") + 1).cast("double").alias("volume"),
        F.col("event_id").alias("file_order"))


_kept: dict[tuple, object] = {}


_locks: dict[tuple, Lock] = defaultdict(Lock)


def once(spark: SparkSession, sf_dir: str, name: str, make):
    """A derived table is built once per session and data folder and then read."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    with _locks[key]:
        if key not in _kept:
            _kept[key] = make()
        return _kept[key]


def forget() -> None:
    """Drop what is kept, so that the next query derives everything again."""
    _kept.clear()


def weekly_bars(spark, sf_dir) -> DataFrame:
    return once(spark, sf_dir, "weekly_bars",
                lambda: stage(supplier_week_bars(spark, sf_dir), "weekly-bars"))


def weekly_grid(spark, sf_dir) -> DataFrame:
    return once(spark, sf_dir, "weekly_grid", lambda: stage(
        grid_calendar(weekly_bars(spark, sf_dir), WEEK_CLOCK), "weekly-grid"))


def weekly_panel(spark, sf_dir) -> DataFrame:
    return once(spark, sf_dir, "weekly_panel", lambda: stage(build_panel(
        weekly_bars(spark, sf_dir), WEEK_CLOCK, order=None, calendar=weekly_grid(spark, sf_dir)), "weekly-panel"))


def event_bars(spark, sf_dir) -> DataFrame:
    return once(spark, sf_dir, "event_bars",
                lambda: stage(event_half_hour_bars(spark, sf_dir), "event-bars"))


def event_grid(spark, sf_dir) -> DataFrame:
    return once(spark, sf_dir, "event_grid", lambda: stage(
        grid_calendar(event_bars(spark, sf_dir), EVENT_CLOCK), "event-grid"))


def event_panel(spark, sf_dir) -> DataFrame:
    return once(spark, sf_dir, "event_panel", lambda: stage(build_panel(
        event_bars(spark, sf_dir), EVENT_CLOCK, calendar=event_grid(spark, sf_dir)), "event-panel"))


def weekly_market(spark, sf_dir):
    return once(spark, sf_dir, "weekly_market",
                lambda: open_market(
                    weekly_panel(spark, sf_dir), WEEKLY, calendar=weekly_grid(spark, sf_dir)))


def open_weekly_market(spark, sf_dir):
    """The weekly market with every covered symbol in its universe."""
    return once(spark, sf_dir, "open_market", lambda: open_market(
        weekly_panel(spark, sf_dir), OPEN, calendar=weekly_grid(spark, sf_dir)))


def baseline_market(spark, sf_dir):
    return once(spark, sf_dir, "baseline_market", lambda: open_market(
        weekly_panel(spark, sf_dir), WEEKLY_BASELINE, liquid_first=True,
        calendar=weekly_grid(spark, sf_dir)))


def event_market(spark, sf_dir):
    return once(spark, sf_dir, "event_market",
                lambda: open_market(
                    event_panel(spark, sf_dir), EVENTS, calendar=event_grid(spark, sf_dir)))


def classic_arm(spark, sf_dir):
    return once(spark, sf_dir, "classic_arm", lambda: run_arm(
        weekly_market(spark, sf_dir), selection.correlation_selector(WEEKLY), "classic"))


def baseline_arm(spark, sf_dir):
    return once(spark, sf_dir, "baseline_arm", lambda: run_arm(
        baseline_market(spark, sf_dir), selection.correlation_selector(WEEKLY_BASELINE), "baseline"))


def window_vectors(market) -> DataFrame:
    """Symbol vectors without a network: the unit-length mean return window."""
    windows = tumbling_windows(market.train.series, WEEKLY.autoencoder)
    return pool_codes(windows.withColumnRenamed("x", "code"), WEEKLY.autoencoder.min_windows, False)


def vector_arm(spark, sf_dir):
    def select(train):
        return selection.select_by_vectors(
            window_vectors(weekly_market(spark, sf_dir)), train, WEEKLY, WEEKLY.autoencoder.neighbours)

    return once(spark, sf_dir, "vector_arm",
                lambda: run_arm(weekly_market(spark, sf_dir), select, "window_mean"))


def autoencoder_arm(spark, sf_dir):
    return once(spark, sf_dir, "autoencoder_arm", lambda: run_arm(
        weekly_market(spark, sf_dir), selection.autoencoder_selector(WEEKLY), "autoencoder"))


def gru_arm(spark, sf_dir):
    return once(spark, sf_dir, "gru_arm", lambda: run_arm(
        weekly_market(spark, sf_dir), selection.gru_selector(WEEKLY), "gru"))


ARMS = ["classic", "baseline", "window_mean"]


def three_arms(spark, sf_dir) -> list:
    return side_by_side([partial(arm, spark, sf_dir) for arm in (classic_arm, baseline_arm, vector_arm)])


def all_trades(spark, sf_dir) -> DataFrame:
    return union_arms([a.trades for a in three_arms(spark, sf_dir)])


def all_fold_metrics(spark, sf_dir) -> DataFrame:
    return union_arms([a.fold_metrics for a in three_arms(spark, sf_dir)])


def all_equity(spark, sf_dir) -> DataFrame:
    return union_arms([a.equity for a in three_arms(spark, sf_dir)])


def all_aggregates(spark, sf_dir) -> DataFrame:
    return union_arms([a.aggregate for a in three_arms(spark, sf_dir)])


def open_candidates(spark, sf_dir) -> DataFrame:
    return once(spark, sf_dir, "open_candidates", lambda: stage(correlated_pairs(
        open_weekly_market(spark, sf_dir).train.series, OPEN.correlation), "candidates"))


def open_fits(spark, sf_dir) -> DataFrame:
    return once(spark, sf_dir, "open_fits", lambda: stage(selection.pair_fits(
        open_candidates(spark, sf_dir), open_weekly_market(spark, sf_dir).train.series), "fits"))


def labelled_vectors(spark, sf_dir) -> DataFrame:
    """The given embeddings as symbol vectors, a label being a fold."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("int").alias("fold_id"),
        F.format_string("V%07d", "vec_id").alias("symbol"), "embedding")


def fitted_lags(spark, sf_dir) -> DataFrame:
    """AR fits of the method's 15 lags for every fold and symbol."""
    return once(spark, sf_dir, "fitted_lags", lambda: stage(
        ar_fits(open_weekly_market(spark, sf_dir).train.series, WEEKLY.gru), "ar-fits"))
