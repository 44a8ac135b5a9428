"""Sources, panel, calendar, fills, coverage and universe."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadloom.config import Eligibility
from spreadloom.operators import folds as fd, panel as pn, reports as rp, series as sr, universe as un
from spreadloom.sources import bars as br
from spreadloom.staging import new_stage_path

from . import inputs as I
from .registry import query


# The columns of the wide export; an export has a fixed set.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _years(spark, sf_dir) -> list[int]:
    """The years the bars span; one row each."""
    years = I.weekly_bars(spark, sf_dir).select(F.year("bar_ts").alias("y")).distinct()
    return sorted(r.y for r in years.collect())


def _yearly_files(spark, sf_dir) -> str:
    """The weekly bars as one folder per year, with the columns of raw bar files."""
    def write():
        base = new_stage_path(spark, "bar-files")
        I.weekly_bars(spark, sf_dir).select(
            "symbol", F.col("bar_ts").alias("timestamp_utc"), "close", "volume",
            F.to_date("bar_ts").cast("string").alias("date_ny"),
            (F.month("bar_ts") != 12).alias("is_regular_hours"),
            F.year("bar_ts").alias("year"),
        ).write.partitionBy("year").parquet(base)
        return base

    return I.once(spark, sf_dir, "yearly_files", write)


@query("symbol timestamp_utc close:d", """
SELECT symbol, bar_ts AS timestamp_utc, close FROM w_bars WHERE month(bar_ts) <> 12""")
def bar_scan(spark, sf_dir):
    return br.load_bars(spark, _yearly_files(spark, sf_dir), _years(spark, sf_dir),
                        columns=["symbol", "timestamp_utc", "close", "symbol"], pattern="year={year}")


@query("symbol timestamp_utc date_ny close:d volume:d is_regular_hours",
       "SELECT symbol, bar_ts AS timestamp_utc, bar_ts::DATE::VARCHAR AS date_ny, close, volume, "
       "month(bar_ts) <> 12 AS is_regular_hours FROM w_bars")
def bar_scan_all_hours(spark, sf_dir):
    return br.load_bars(spark, _yearly_files(spark, sf_dir), _years(spark, sf_dir), regular_hours_only=False, pattern="year={year}")


@query("symbol bar_ts close:d dollar_vol:d bar_seq:i", """
SELECT symbol, bar_ts, close, close * volume AS dollar_vol, dense_rank() OVER (ORDER BY bar_ts) - 1 AS bar_seq
FROM w_bars WHERE month(bar_ts) <> 12""")
def panel_from_files(spark, sf_dir):
    bars = br.load_panel_bars(spark, _yearly_files(spark, sf_dir), _years(spark, sf_dir), pattern="year={year}")
    return pn.build_panel(bars, I.WEEK_CLOCK)


@query("symbol bar_ts close:d volume:d", """
SELECT symbol, bar_ts, close, CASE WHEN year(bar_ts) > 1998 THEN volume END AS volume FROM w_bars""")
def union_of_years(spark, sf_dir):
    bars = I.weekly_bars(spark, sf_dir)
    early = bars.filter(F.year("bar_ts") <= 1998).drop("volume")
    return br.union_years([early, bars.filter(F.year("bar_ts") > 1998)])


@query("symbol bar_ts close:d volume:d", "SELECT * FROM e_bars")
def keep_last_bar(spark, sf_dir):
    return pn.keep_last(I.event_bars(spark, sf_dir), ["symbol", "bar_ts"], "file_order", ["close", "volume"])


@query("bar_ts day bar_seq:i day_idx:i n_bars:i n_days:i", """
SELECT *, count(*) OVER () AS n_bars, max(day_idx) OVER () + 1 AS n_days FROM e_grid""")
def local_calendar(spark, sf_dir):
    return pn.grid_calendar(I.event_bars(spark, sf_dir), I.EVENT_CLOCK)


@query("symbol bar_ts day day_idx:i bar_seq:i close:d", "SELECT * FROM e_panel")
def price_panel(spark, sf_dir):
    bars = pn.keep_last(I.event_bars(spark, sf_dir), ["symbol", "bar_ts"], "file_order", ["close"])
    return pn.on_grid(bars, pn.grid_calendar(bars, I.EVENT_CLOCK))


@query("bar_ts " + " ".join(f"{t}:d" for t in EVENT_TYPES), f"""
SELECT bar_ts, {", ".join(f"max(CASE WHEN symbol = '{t}' THEN close END) AS {t}" for t in EVENT_TYPES)}
FROM e_panel GROUP BY 1""")
def wide_price_export(spark, sf_dir):
    return pn.wide_panel(I.event_panel(spark, sf_dir), "close", EVENT_TYPES)


@query("symbol bar_seq:i dollar_vol:d", "SELECT * FROM e_panel")
def dollar_volume_panel(spark, sf_dir):
    return pn.build_panel(I.event_bars(spark, sf_dir), I.EVENT_CLOCK)


@query("symbol bar_seq:i logret:d", "SELECT * FROM e_panel")
def intraday_returns(spark, sf_dir):
    return pn.build_panel(I.event_bars(spark, sf_dir), I.EVENT_CLOCK)


@query("symbol bar_seq:i logret:d", "SELECT symbol, bar_seq, full_ret AS logret FROM e_panel")
def returns_with_overnight(spark, sf_dir):
    # A small chunk, so that the check also crosses many chunk borders.
    priced = I.event_panel(spark, sf_dir).drop("logret")
    return pn.log_returns(priced, drop_overnight=False, chunk=64)


@query("symbol bar_seq:i logret:d", "SELECT * FROM w_panel")
def sparse_returns(spark, sf_dir):
    return pn.build_panel(I.weekly_bars(spark, sf_dir), I.WEEK_CLOCK, order=None)


@query("symbol bar_ts close:d", """
SELECT symbol, bar_ts, close FROM e_panel WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-14'""")
def day_slice(spark, sf_dir):
    return fd.between_days(I.event_panel(spark, sf_dir), "2024-01-10", "2024-01-14")


@query("fold_id:i symbol bar_seq:i logret:d", """
SELECT u.fold_id, u.symbol, g.bar_seq, coalesce(p.logret, 0.0) AS logret
FROM o_uni u JOIN w_folds f USING (fold_id) JOIN w_grid g ON g.bar_seq BETWEEN f.test_lo AND f.test_hi
LEFT JOIN w_panel p ON p.symbol = u.symbol AND p.bar_seq = g.bar_seq""")
def zero_reindex(spark, sf_dir):
    m = I.open_weekly_market(spark, sf_dir)
    grid = m.universe.select("fold_id", "symbol").join(m.folds, "fold_id").select(
        "fold_id", "symbol", F.explode(F.sequence("test_lo", "test_hi")).alias("bar_seq"))
    rows = fd.assign_folds(m.panel, I.WEEK_FOLDS, "test").select("fold_id", "symbol", "bar_seq", "logret")
    return pn.reindex_zero(rows, grid, ["fold_id", "symbol", "bar_seq"], ["logret"])


@query("symbol bar_seq:i src_seq:i close:d", """
SELECT symbol, bar_seq, src_seq, close FROM (
  SELECT s.symbol, g.bar_seq,
         last_value(p.close IGNORE NULLS) OVER f AS close,
         last_value(CASE WHEN p.close IS NOT NULL THEN p.bar_seq END IGNORE NULLS) OVER f AS src_seq
  FROM (SELECT DISTINCT symbol FROM e_panel) s CROSS JOIN e_grid g
  LEFT JOIN e_panel p ON p.symbol = s.symbol AND p.bar_seq = g.bar_seq
  WINDOW f AS (PARTITION BY s.symbol ORDER BY g.bar_seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
WHERE close IS NOT NULL""")
def bounded_fill(spark, sf_dir):
    end = pn.grid_calendar(I.event_bars(spark, sf_dir), I.EVENT_CLOCK).agg(F.max("bar_seq")).scalar()
    return pn.forward_fill(I.event_panel(spark, sf_dir), "close", end, chunk=64)


@query("fold_id:i symbol bar_seq:i close:d logret:d",
       "SELECT fold_id, symbol, bar_seq, close, ret AS logret FROM o_train")
def train_windows_filled(spark, sf_dir):
    return sr.series_rows(I.open_weekly_market(spark, sf_dir).train.series)


@query("fold_id:i train_start train_end test_start test_end train_lo:i train_hi:i test_lo:i test_hi:i",
       "SELECT * FROM w_folds")
def fold_calendar(spark, sf_dir):
    return fd.check_no_lookahead(fd.fold_table(I.weekly_grid(spark, sf_dir), I.WEEK_FOLDS))


@query("fold_id:i train_start train_end test_start test_end train_lo:i train_hi:i test_lo:i test_hi:i",
       "SELECT * FROM e_folds")
def fold_calendar_intraday(spark, sf_dir):
    return fd.fold_table(I.event_market(spark, sf_dir).calendar, I.EVENT_FOLDS)


@query("fold_id:i last_train_seq:i first_test_seq:i", """
SELECT fold_id, last_train_seq, first_test_seq
FROM (SELECT fold_id, max(bar_seq) AS last_train_seq FROM w_train WHERE ret IS NOT NULL GROUP BY 1)
LEFT JOIN (SELECT fold_id, min(bar_seq) AS first_test_seq FROM c_t_bars
           WHERE close_a IS NOT NULL AND close_b IS NOT NULL GROUP BY 1) USING (fold_id)""")
def lookahead_evidence(spark, sf_dir):
    return fd.fold_evidence(I.weekly_market(spark, sf_dir).train.series, I.classic_arm(spark, sf_dir).pair_bars)


@query("fold_id:i symbol bar_seq:i logret:d", """
SELECT fold_id, symbol, bar_seq, logret FROM e_panel JOIN e_folds ON bar_seq BETWEEN train_lo AND train_hi""")
def bars_to_train_folds(spark, sf_dir):
    return fd.assign_folds(I.event_panel(spark, sf_dir), I.EVENT_FOLDS, "train")


@query("fold_id:i symbol bar_seq:i logret:d", """
SELECT fold_id, symbol, bar_seq, logret FROM e_panel JOIN e_folds ON bar_seq BETWEEN test_lo AND test_hi""")
def bars_to_test_folds(spark, sf_dir):
    return fd.assign_folds(I.event_panel(spark, sf_dir), I.EVENT_FOLDS, "test")


@query("fold_id:i symbol coverage:d median_dv:d", "SELECT * FROM w_cov WHERE coverage >= 0.95")
def covered_symbols(spark, sf_dir):
    m = I.weekly_market(spark, sf_dir)
    return un.fold_coverage(m.panel, m.folds, I.WEEK_FOLDS).filter("coverage >= 0.95")


@query("fold_id:i symbol coverage:d", "SELECT * FROM w_cov WHERE coverage >= 1.0")
def fully_covered_symbols(spark, sf_dir):
    m = I.weekly_market(spark, sf_dir)
    return un.fold_universe(m.panel, m.folds, I.WEEK_FOLDS, Eligibility(min_coverage=1.0, top_n_liquid=None))


@query("symbol median_dv:d rank:i", """
SELECT symbol, median(close * volume) AS median_dv, row_number() OVER (ORDER BY median(close * volume) DESC, symbol) AS rank
FROM w_bars GROUP BY 1 QUALIFY rank <= 60""")
def liquid_universe(spark, sf_dir):
    return un.liquid_symbols(I.weekly_bars(spark, sf_dir), 60)


@query("symbol median_dv:d rank:i", """
SELECT symbol, median(close * volume) AS median_dv, row_number() OVER (ORDER BY median(close * volume) DESC, symbol) AS rank
FROM e_raw WHERE ((bar_ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE
      BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
GROUP BY 1 QUALIFY rank <= 3""")
def liquid_universe_days(spark, sf_dir):
    # Raw bars, copies of a bar included: a few symbols hold all rows.
    bars = I.event_bars(spark, sf_dir).withColumn(
        "day", pn.local_day(F.col("bar_ts"), I.EVENT_CLOCK.zone))
    return un.liquid_symbols(bars, 3, ("2024-01-05", "2024-01-20"))


@query("fold_id:i symbol coverage:d median_dv:d uni_rank:i n_universe:i", "SELECT * FROM w_uni")
def fold_universe(spark, sf_dir):
    m = I.weekly_market(spark, sf_dir)
    return un.fold_universe(m.panel, m.folds, I.WEEK_FOLDS, I.WEEKLY.eligibility)


@query("fold_id:i symbol coverage:d median_dv:d uni_rank:i n_universe:i", "SELECT * FROM b_uni")
def fold_universe_liquid_first(spark, sf_dir):
    m = I.weekly_market(spark, sf_dir)
    return un.liquid_then_covered(m.panel, m.folds, I.WEEK_FOLDS, I.WEEKLY_BASELINE.eligibility)


@query("fold_id:i symbol bar_seq:i close:d", """
SELECT fold_id, symbol, bar_seq, raw_close AS close FROM w_train WHERE raw_close IS NOT NULL""")
def universe_bars(spark, sf_dir):
    m = I.weekly_market(spark, sf_dir)
    return fd.assign_folds(m.panel, I.WEEK_FOLDS, "train").join(
        m.universe.select("fold_id", "symbol"), ["fold_id", "symbol"], "left_semi")


@query("n_symbols:i n_above:i total_bars:i first_bar last_bar", """
SELECT count(*) AS n_symbols, count(*) FILTER (WHERE c >= 0.95) AS n_above, any_value(total_bars) AS total_bars,
       any_value(first_bar) AS first_bar, any_value(last_bar) AS last_bar
FROM (SELECT symbol, count(close) * 1.0 / any_value(total_bars) AS c, any_value(total_bars) AS total_bars,
             any_value(first_bar) AS first_bar, any_value(last_bar) AS last_bar
      FROM w_panel CROSS JOIN (SELECT count(*) AS total_bars, min(bar_ts) AS first_bar, max(bar_ts) AS last_bar FROM w_grid)
      GROUP BY 1)""")
def panel_summary(spark, sf_dir):
    m = I.weekly_market(spark, sf_dir)
    return rp.panel_summary(m.panel, m.calendar)


@query("symbol coverage:d", """
SELECT symbol, count(close) * 1.0 / (SELECT count(*) FROM w_grid) AS coverage FROM w_panel GROUP BY 1""")
def span_coverage(spark, sf_dir):
    m = I.weekly_market(spark, sf_dir)
    return un.span_coverage(m.panel, m.calendar.agg(F.count(F.lit(1))).scalar())


@query("month n_symbols:i", """
SELECT date_trunc('month', day)::DATE AS month, count(DISTINCT symbol) AS n_symbols FROM w_panel GROUP BY 1""")
def active_symbols_by_month(spark, sf_dir):
    return rp.active_symbols(I.weekly_panel(spark, sf_dir))
