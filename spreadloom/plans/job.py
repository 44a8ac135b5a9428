"""Batch job: run the chosen arms over a range of years, save their tables and the reports.

    spark-submit … run_job.py --bars PATH --out PATH \\
        [--arms classic autoencoder gru baseline] [--start 2016] [--end 2025]

Each arm is committed as a whole as soon as it is done. A job that runs again, after a
failure or with added or corrected bars, computes only the folds whose bars or settings
are not those of the committed bundle, and takes the others from it.
"""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import RunSettings, baseline_settings
from ..operators.folds import check_no_lookahead, fold_table
from ..operators.panel import build_panel, grid_calendar
from ..sources.bars import FILE_PATTERN, load_panel_bars
from ..sources.results import (
    FOLD_TABLES, commit_arm, config_frame, delete_folder, load_arms, read_bundle, write_json)
from ..staging import clear_stages, side_by_side, stage
from .report_job import write_reports
from .restart import fold_keys, folds_to_run, with_saved_folds
from .selection import BASELINE, SELECTORS
from .walk_forward import assemble, open_market, restricted, run_folds


def run_arms(panel: DataFrame, calendar: DataFrame, settings: RunSettings, arms: list[str], out: str,
             years: list[int], liquid_first: bool = False) -> None:
    """Run those folds of the arms that are not saved yet, and commit each arm with all its folds."""
    spark = panel.sparkSession
    folds = stage(check_no_lookahead(fold_table(calendar, settings.folds)), "all-folds")
    # What decides a fold's results, apart from its bars.
    keys = {arm: stage(fold_keys(panel, folds, settings.folds, arm, liquid_first, settings.snapshot()), f"{arm}-keys") for arm in arms}
    todo = {arm: stage(folds_to_run(keys[arm], read_bundle(spark, out, arm, "fold_keys")), f"{arm}-todo") for arm in arms}
    counts = {arm: todo[arm].count() for arm in arms}
    n_folds = folds.count()
    market = None
    if any(counts.values()):
        wanted = spark.createDataFrame([], "fold_id int")
        for arm in arms:
            wanted = wanted.union(todo[arm].select("fold_id"))
        market = open_market(panel, settings, liquid_first, calendar, stage(wanted.distinct(), "wanted-folds"))

    def run(arm: str) -> None:
        saved = read_bundle(spark, out, arm, "fold_keys")
        if not counts[arm] and saved is not None and saved.count() == n_folds:
            return  # the committed bundle is this run's result
        new = None
        if counts[arm]:
            if counts[arm] == n_folds:
                for table in FOLD_TABLES:
                    delete_folder(spark, f"{out}/{table}/arm={arm}")
            selector = SELECTORS[arm](settings, f"{out}/weights", out)
            new, _ = run_folds(restricted(market, todo[arm]), selector, arm)
        parts = with_saved_folds(new, keys[arm], out, arm)
        result = assemble(parts, calendar, folds, arm, settings.clock.bars_per_year)
        config = {"arm": arm, "years": years, "settings": settings.snapshot()}
        commit_arm({**result.tables(), "portfolio": parts.portfolio, "fold_keys": keys[arm],
                    "config": config_frame(spark, arm, config)}, out, arm)

    side_by_side([partial(run, arm) for arm in arms])


def run_job(spark: SparkSession, bars: str, out: str, arms: list[str], years: list[int],
            settings: RunSettings = RunSettings(), pattern: str = FILE_PATTERN,
            baseline: RunSettings = baseline_settings()) -> DataFrame:
    """Run the arms over the years' bars and write the reports; returns the arms' aggregates."""
    rows = load_panel_bars(spark, bars, years, pattern=pattern)
    calendar = stage(grid_calendar(rows, settings.clock), "grid")
    panel = stage(build_panel(rows, settings.clock, calendar=calendar), "panel")
    shared = [arm for arm in arms if arm != BASELINE]
    if shared:
        run_arms(panel, calendar, settings, shared, out, years)
    if BASELINE in arms:
        run_arms(panel, calendar, baseline, [BASELINE], out, years, liquid_first=True)
    aggregates = load_arms(spark, out, ("aggregate",))["aggregate"]
    comparison = stage(aggregates.filter(F.col("arm").isin(list(arms))), "comparison")
    write_json(comparison, f"{out}/comparison")
    write_reports(spark, out, arms, settings.clock.bars_per_year)
    return comparison


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Walk-forward pair selection and back-test")
    parser.add_argument("--bars", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--arms", nargs="+", default=["classic", "autoencoder", "gru"], choices=list(SELECTORS))
    parser.add_argument("--start", type=int, default=2016)
    parser.add_argument("--end", type=int, default=2025)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("spreadloom").getOrCreate()
    comparison = run_job(spark, args.bars, args.out, args.arms, list(range(args.start, args.end + 1)))
    comparison.orderBy(F.col("arm")).show(truncate=False)
    clear_stages(spark)


if __name__ == "__main__":
    main()
