"""Correlation, pair statistics, trading rule, portfolio and metrics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from spreadloom.config import CorrelationSearch, FoldPlan
from spreadloom.operators import (
    correlation as cr, folds as fd, metrics as mt, pairstats as ps, portfolio as pf, series as sr,
    signal as sg)
from spreadloom.plans import selection as sl, walk_forward as wf

from . import inputs as I
from .registry import query

PAIR = "fold_id:i sym_a sym_b"
FITS = f"{PAIR} n_rows:i alpha:d beta:d mu:d sigma:d half_life:d bp_stat:d bp_pval:d"


def _train_grid(spark, sf_dir):
    pairs = I.open_candidates(spark, sf_dir)
    return ps.pair_grid(pairs.select(*ps.PAIR), I.open_weekly_market(spark, sf_dir).train.series, returns=False)


def _test_grid(spark, sf_dir, arm=None):
    m, a = I.weekly_market(spark, sf_dir), arm or I.classic_arm(spark, sf_dir)
    pairs = a.pairs.drop("arm")
    series = sr.test_series(m.panel, m.folds, pairs, I.WEEK_FOLDS)
    return ps.pair_grid(pf.with_weight(pairs).select(*ps.PAIR, *wf.TRADED), series, m.folds, "test")


@query(f"{PAIR} bar_seq:i log_a:d log_b:d",
       "SELECT fold_id, sym_a, sym_b, bar_seq, la AS log_a, lb AS log_b FROM oc_legs")
def aligned_pair_bars(spark, sf_dir):
    return ps.aligned_logs(_train_grid(spark, sf_dir))


@query(f"{PAIR} rank_a:i rank_b:i train_corr:d n_obs:i", "SELECT * FROM o_corr")
def all_pair_correlations(spark, sf_dir):
    # Tiles smaller than the universe, so that the check crosses tile borders.
    return cr.correlated_pairs(I.open_weekly_market(spark, sf_dir).train.series,
                               CorrelationSearch(top_k=None, min_corr=None), tile=16)


@query(f"{PAIR} train_corr:d n_obs:i cand_rank:i", "SELECT * FROM o_cand")
def correlation_candidates(spark, sf_dir):
    return cr.correlated_pairs(I.open_weekly_market(spark, sf_dir).train.series, I.OPEN.correlation)


@query(f"{PAIR} train_corr:d n_obs:i", """
SELECT a.fold_id, a.symbol AS sym_a, b.symbol AS sym_b, corr(a.logret, b.logret) AS train_corr, count(*) AS n_obs
FROM (SELECT fold_id, symbol, bar_seq, logret FROM e_panel JOIN e_folds ON bar_seq BETWEEN train_lo AND train_hi) a
JOIN (SELECT fold_id, symbol, bar_seq, logret FROM e_panel JOIN e_folds ON bar_seq BETWEEN train_lo AND train_hi) b
  ON a.fold_id = b.fold_id AND a.bar_seq = b.bar_seq AND a.symbol < b.symbol
WHERE a.logret IS NOT NULL AND b.logret IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 50""")
def intraday_correlations(spark, sf_dir):
    return cr.correlated_pairs(I.event_market(spark, sf_dir).train.series,
                               CorrelationSearch(top_k=None, min_corr=None))


@query(f"{PAIR} n_rows:i alpha:d beta:d", "SELECT * FROM oc_ols")
def hedge_ratios(spark, sf_dir):
    return ps.hedge_ratios(_train_grid(spark, sf_dir))


@query(f"{PAIR} n_rows:i alpha:d beta:d mu:d sigma:d", "SELECT * FROM oc_fits")
def pair_parameters(spark, sf_dir):
    return ps.pair_statistics(_train_grid(spark, sf_dir))


@query(f"{PAIR} half_life:d", "SELECT * FROM oc_fits")
def half_lives(spark, sf_dir):
    return ps.pair_statistics(_train_grid(spark, sf_dir))


@query(f"{PAIR} bp_stat:d bp_pval:d", "SELECT * FROM oc_fits")
def heteroskedasticity_test(spark, sf_dir):
    return ps.with_p_value(ps.pair_statistics(_train_grid(spark, sf_dir)))


@query(FITS, "SELECT * FROM oc_ok")
def eligible_pairs(spark, sf_dir):
    return ps.eligible_pairs(I.open_fits(spark, sf_dir), I.OPEN.eligibility)


@query(FITS, """
SELECT * FROM oc_fits WHERE beta > 0 AND bp_pval > 0.05 AND half_life BETWEEN 3 AND 150 AND sigma >= 0.005""")
def eligible_pairs_strict(spark, sf_dir):
    rule = replace(I.OPEN.eligibility, bp_strict=True, half_life_min=3.0)
    return ps.eligible_pairs(I.open_fits(spark, sf_dir), rule)


@query(f"{PAIR} train_sharpe:d", "SELECT * FROM c_scored")
def train_sharpes(spark, sf_dir):
    series = I.weekly_market(spark, sf_dir).train.series
    fits = I.stage(sl.pair_fits(cr.correlated_pairs(series, I.WEEKLY.correlation), series), "fits")
    return sl.train_sharpes(ps.eligible_pairs(fits, I.WEEKLY.eligibility), series, I.WEEKLY)


@query(f"{FITS.replace('n_rows:i ', '')} cand_rank:i train_sharpe:d rank:i", "SELECT * FROM c_pairs")
def classic_pairs(spark, sf_dir):
    m = I.weekly_market(spark, sf_dir)
    return sl.correlation_selector(I.WEEKLY)(m.train)


@query(f"{FITS.replace('n_rows:i ', '')} cand_rank:i rank:i", "SELECT * FROM h_pairs")
def baseline_pairs(spark, sf_dir):
    return I.baseline_arm(spark, sf_dir).pairs


@query(f"{PAIR} bar_seq:i close_a:d close_b:d ret_a:d ret_b:d", "SELECT * FROM c_t_legs")
def selected_pair_bars(spark, sf_dir):
    return _test_grid(spark, sf_dir)


@query(f"{PAIR} bar_seq:i spread:d", "SELECT * FROM c_t_z")
def pair_spreads(spark, sf_dir):
    return sg.spread_zscores(_test_grid(spark, sf_dir), I.WEEKLY.rule)


@query(f"{PAIR} unit_a:d unit_b:d",
       "SELECT fold_id, sym_a, sym_b, 1 / (1 + abs(beta)) AS unit_a, -beta / (1 + abs(beta)) AS unit_b FROM c_pairs")
def leg_weights(spark, sf_dir):
    a, b = sg.leg_weights(F.col("beta"))
    return I.classic_arm(spark, sf_dir).pairs.select(*ps.PAIR, a.alias("unit_a"), b.alias("unit_b"))


@query(f"{PAIR} bar_seq:i z:d", "SELECT * FROM c_t_z")
def rolling_zscores(spark, sf_dir):
    return sg.spread_zscores(_test_grid(spark, sf_dir), I.WEEKLY.rule)


@query(f"{PAIR} bar_seq:i z:d", "SELECT * FROM h_t_z")
def full_window_zscores(spark, sf_dir):
    grid = _test_grid(spark, sf_dir, I.baseline_arm(spark, sf_dir))
    return sg.spread_zscores(grid, I.WEEKLY_BASELINE.rule)


@query(f"{PAIR} bar_seq:i z:d",
       "SELECT fold_id, sym_a, sym_b, bar_seq, (spread - mu) / nullif(sigma, 0) AS z FROM c_t_spread")
def frozen_zscores(spark, sf_dir):
    return sg.spread_zscores(_test_grid(spark, sf_dir), replace(I.WEEKLY.rule, rolling=False))


@query(f"{PAIR} bar_seq:i position:i", "SELECT * FROM c_t_bars")
def positions(spark, sf_dir):
    rows = sg.spread_zscores(_test_grid(spark, sf_dir), I.WEEKLY.rule)
    return sg.positions(rows, I.WEEKLY.rule)


@query(f"{PAIR} bar_seq:i gross_ret:d turnover:d cost:d net_ret:d", "SELECT * FROM c_t_bars")
def pair_returns(spark, sf_dir):
    return sg.evaluate_pairs(_test_grid(spark, sf_dir), I.WEEKLY.rule)


@query(f"{PAIR} bar_seq:i position:i net_ret:d turnover:d", """
SELECT p.fold_id, p.sym_a, p.sym_b || '?' AS sym_b, g.bar_seq, 0 AS position, 0.0 AS net_ret, 0.0 AS turnover
FROM c_pairs p JOIN w_folds f USING (fold_id) JOIN w_grid g ON g.bar_seq BETWEEN f.test_lo AND f.test_hi""")
def missing_leg(spark, sf_dir):
    m = I.weekly_market(spark, sf_dir)
    pairs = I.classic_arm(spark, sf_dir).pairs.drop("arm").withColumn(
        "sym_b", F.concat("sym_b", F.lit("?")))
    return wf.trade_test(m, pairs)


@query(f"{PAIR} side:i entry_ts exit_ts holding_bars:i weight:d pnl:d", "SELECT * FROM c_trades")
def trade_log(spark, sf_dir):
    a = I.classic_arm(spark, sf_dir)
    return wf.trade_log(a.pair_bars, I.weekly_market(spark, sf_dir).calendar)


@query("fold_id:i bar_seq:i ret:d turnover:d", "SELECT * FROM c_port")
def fold_portfolio(spark, sf_dir):
    return pf.fold_portfolio(I.classic_arm(spark, sf_dir).pair_bars, I.weekly_market(spark, sf_dir).folds)


@query("bar_seq:i fold_id:i ret:d turnover:d", """
SELECT bar_seq, fold_id, ret, turnover FROM (
  SELECT k AS fold_id, bar_seq, avg(logret) AS ret, count(logret)::DOUBLE AS turnover
  FROM (SELECT unnest(generate_series(0, (max(day_idx) + 1 - 130) // 13)) AS k FROM w_days)
  JOIN w_panel ON day_idx BETWEEN k * 13 + 104 AND k * 13 + 129 GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY bar_seq ORDER BY fold_id) = 1""")
def stitched_overlaps(spark, sf_dir):
    plan = FoldPlan(104, 26, 13)
    rows = fd.assign_folds(I.weekly_panel(spark, sf_dir), plan, "test")
    per_fold = rows.groupBy("fold_id", "bar_seq").agg(
        F.avg("logret").alias("ret"), F.count("logret").cast("double").alias("turnover"))
    return pf.stitch(per_fold)


@query("bar_ts equity:d peak:d drawdown:d",
       "SELECT bar_ts, eq AS equity, peak, dd AS drawdown FROM c_oos")
def equity_and_drawdown(spark, sf_dir):
    return mt.equity_curve(I.classic_arm(spark, sf_dir).returns, ["arm"], "fold_id")


METRICS = ("sharpe_annualized:d return_total:d return_annualized:d max_drawdown:d hit_rate_bars:d n_bars:i "
           "turnover_annualized:d turnover_per_bar:d n_trades:i trade_win_rate:d avg_holding_bars:d "
           "avg_trade_pnl:d n_active_pairs:d")
FOLD_METRICS = f"arm fold_id:i train_start train_end test_start test_end {METRICS}"


@query(FOLD_METRICS, "SELECT * FROM c_fm")
def classic_fold_metrics(spark, sf_dir):
    return I.classic_arm(spark, sf_dir).fold_metrics


@query(FOLD_METRICS, "SELECT * FROM h_fm")
def baseline_fold_metrics(spark, sf_dir):
    return I.baseline_arm(spark, sf_dir).fold_metrics


@query(FOLD_METRICS, "SELECT * FROM v_fm")
def vector_fold_metrics(spark, sf_dir):
    return I.vector_arm(spark, sf_dir).fold_metrics


@query(f"arm {METRICS}", "SELECT * FROM c_agg")
def classic_walk_forward(spark, sf_dir):
    m = I.weekly_market(spark, sf_dir)
    return wf.run_arm(m, sl.correlation_selector(I.WEEKLY), "classic").aggregate


@query(f"arm {METRICS}", "SELECT * FROM h_agg")
def baseline_walk_forward(spark, sf_dir):
    return I.baseline_arm(spark, sf_dir).aggregate


@query(f"arm {METRICS}", "SELECT * FROM v_agg")
def vector_walk_forward(spark, sf_dir):
    return I.vector_arm(spark, sf_dir).aggregate


@query("fold_id:i n_trades:i trade_win_rate:d avg_holding_bars:d avg_trade_pnl:d", "SELECT * FROM c_ts")
def trade_statistics(spark, sf_dir):
    return mt.trade_stats(I.classic_arm(spark, sf_dir).trades, ["fold_id"])


SYMBOL_METRICS = """
SELECT fold_id, symbol, {sharpe} AS sharpe, product(1 + coalesce(logret, 0)) - 1 AS total,
       CASE WHEN product(1 + coalesce(logret, 0)) <= 0 THEN -1.0
            ELSE pow(product(1 + coalesce(logret, 0)), 52.0 / count(*)) - 1 END AS annualized,
       coalesce(avg(CASE WHEN logret > 0 THEN 1.0 WHEN logret < 0 THEN 0.0 END), 0.0) AS hits
FROM w_panel JOIN w_folds ON bar_seq BETWEEN test_lo AND test_hi GROUP BY 1, 2"""


@query("fold_id:i symbol sharpe:d total:d annualized:d hits:d", SYMBOL_METRICS.format(sharpe="""
CASE WHEN count(logret) < 2 OR stddev_samp(logret) = 0 THEN 0.0
     ELSE avg(logret) / stddev_samp(logret) * sqrt(52) END"""))
def buy_and_hold_metrics(spark, sf_dir):
    rows = fd.assign_folds(I.weekly_panel(spark, sf_dir), I.WEEK_FOLDS, "test")
    r = F.col("logret")
    return rows.groupBy("fold_id", "symbol").agg(
        mt.sharpe(r, 52).alias("sharpe"), mt.total_return(r).alias("total"),
        mt.annualized_return(r, 52).alias("annualized"), mt.hit_rate(r).alias("hits"))
