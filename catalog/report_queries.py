"""Reports across arms, histograms, and the result sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadloom.operators import correlation as cr, reports as rp, windows as wn
from spreadloom.plans import job, restart as rt
from spreadloom.sources import results as rs
from spreadloom.staging import new_stage_path

from . import inputs as I
from .oracle_tables import sharpe
from .pair_queries import FOLD_METRICS, METRICS
from .registry import query

TRADES = "(SELECT * FROM c_trades UNION ALL SELECT * FROM h_trades UNION ALL SELECT * FROM v_trades)"
EQUITY = "(SELECT * FROM c_oos UNION ALL SELECT * FROM h_oos UNION ALL SELECT * FROM v_oos)"
FOLD_ROWS = "(SELECT * FROM c_fm UNION ALL SELECT * FROM h_fm UNION ALL SELECT * FROM v_fm)"
TOTALS = "(SELECT * FROM c_agg UNION ALL SELECT * FROM h_agg UNION ALL SELECT * FROM v_agg)"
ARM_COLUMNS = " ".join(f"{a}:d" for a in I.ARMS)


def by_arm(value: str) -> str:
    return ", ".join(f"max(CASE WHEN arm = '{a}' THEN {value} END) AS {a}" for a in I.ARMS)


@query(f"bar_ts {ARM_COLUMNS}", f"SELECT bar_ts, {by_arm('eq')} FROM {EQUITY} GROUP BY 1")
def equity_by_arm(spark, sf_dir):
    return rp.equity_table(I.all_equity(spark, sf_dir), I.ARMS)


PCT = f"""(SELECT arm, bar_seq, fold_id,
       coalesce(eq / lag(eq) OVER (PARTITION BY arm ORDER BY bar_seq) - 1, 0) AS ret FROM {EQUITY})"""


@query("arm bar_seq:i ret:d", f"SELECT * FROM {PCT}")
def equity_changes(spark, sf_dir):
    return rp.percent_change(I.all_equity(spark, sf_dir))


@query("arm cost_bps:d sharpe:d ann_return:d", f"""
SELECT arm, cost_bps, {sharpe('net', 52)} AS sharpe, pow(product(1 + net), 52.0 / count(*)) - 1 AS ann_return
FROM (SELECT p.arm, c.cost_bps, p.ret + a.turnover_per_bar * 0.0005 - a.turnover_per_bar * (c.cost_bps * 1e-4) AS net
      FROM {PCT} p JOIN {TOTALS} a USING (arm)
      CROSS JOIN (SELECT unnest([0.0, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0]::DOUBLE[]) AS cost_bps) c)
GROUP BY 1, 2""")
def cost_sensitivity(spark, sf_dir):
    return rp.cost_sensitivity(I.all_equity(spark, sf_dir), I.all_aggregates(spark, sf_dir), bars_per_year=52)


@query("arm pair n_trades:i place:i", f"""
SELECT arm, sym_a || ' / ' || sym_b AS pair, count(*) AS n_trades,
       row_number() OVER (PARTITION BY arm ORDER BY count(*) DESC, sym_a || ' / ' || sym_b) AS place
FROM {TRADES} GROUP BY arm, sym_a, sym_b QUALIFY place <= 15""")
def most_traded_pairs(spark, sf_dir):
    return rp.most_traded(I.all_trades(spark, sf_dir))


DISTINCT = f"(SELECT DISTINCT arm, least(sym_a, sym_b) AS a, greatest(sym_a, sym_b) AS b FROM {TRADES})"


@query("arm unique_pairs:i", f"SELECT arm, count(*) AS unique_pairs FROM {DISTINCT} GROUP BY 1")
def unique_pairs(spark, sf_dir):
    return rp.unique_pair_counts(I.all_trades(spark, sf_dir))


@query("arm_1 arm_2 n_both:i n_either:i jaccard:d", f"""
SELECT arm_1, arm_2, n_both, n1 + n2 - n_both AS n_either, coalesce(n_both * 1.0 / nullif(n1 + n2 - n_both, 0), 0) AS jaccard
FROM (SELECT x.arm AS arm_1, y.arm AS arm_2, x.n AS n1, y.n AS n2,
             (SELECT count(*) FROM {DISTINCT} p JOIN {DISTINCT} q ON p.a = q.a AND p.b = q.b
              WHERE p.arm = x.arm AND q.arm = y.arm) AS n_both
      FROM (SELECT arm, count(*) AS n FROM {DISTINCT} GROUP BY 1) x
      CROSS JOIN (SELECT arm, count(*) AS n FROM {DISTINCT} GROUP BY 1) y)""")
def pair_overlap(spark, sf_dir):
    return rp.pair_overlap(I.all_trades(spark, sf_dir), I.ARMS)


@query(f"test_start {ARM_COLUMNS}", f"SELECT test_start, {by_arm('return_total')} FROM {FOLD_ROWS} GROUP BY 1")
def fold_return_matrix(spark, sf_dir):
    return rp.fold_return_matrix(I.all_fold_metrics(spark, sf_dir), I.ARMS)


@query("arm share_positive:d", f"""
SELECT arm, avg(CASE WHEN sharpe_annualized > 0 THEN 1.0 ELSE 0.0 END) AS share_positive FROM {FOLD_ROWS} GROUP BY 1""")
def positive_folds(spark, sf_dir):
    return rp.positive_fold_share(I.all_fold_metrics(spark, sf_dir))


SUMMARY = f"""(SELECT t.*, share_positive FROM {TOTALS} t JOIN (
  SELECT arm, avg(CASE WHEN sharpe_annualized > 0 THEN 1.0 ELSE 0.0 END) AS share_positive
  FROM {FOLD_ROWS} GROUP BY 1) USING (arm))"""


@query(f"arm {METRICS} share_positive:d", f"SELECT * FROM {SUMMARY}")
def arm_comparison(spark, sf_dir):
    return rp.arm_summary(I.all_aggregates(spark, sf_dir), I.all_fold_metrics(spark, sf_dir))


@query(f"line:i metric {ARM_COLUMNS}", " UNION ALL ".join(
    f"SELECT {i} AS line, '{label}' AS metric, {by_arm(f'{column}::DOUBLE')} FROM {SUMMARY}"
    for i, (label, column, _, _) in enumerate(rp.HEADLINE)))
def headline_values(spark, sf_dir):
    summary = rp.arm_summary(I.all_aggregates(spark, sf_dir), I.all_fold_metrics(spark, sf_dir))
    return rp.headline_values(summary, I.ARMS)


@query(f"line:i metric {' '.join(I.ARMS)}", " UNION ALL ".join(
    "SELECT {i} AS line, '{label}' AS metric, {columns} FROM {src}".format(
        i=i, label=label, src=SUMMARY, columns=by_arm(
            f"printf('%.{d}f', {column}::DOUBLE * {100.0 if pct else 1.0}::DOUBLE) || '{'%' if pct else ''}'"))
    for i, (label, column, d, pct) in enumerate(rp.HEADLINE)))
def headline_table(spark, sf_dir):
    summary = rp.arm_summary(I.all_aggregates(spark, sf_dir), I.all_fold_metrics(spark, sf_dir))
    return rp.headline_table(summary, I.ARMS)


def hist(source: str, value: str, bins: int, lo: str, hi: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"""
SELECT {lead}bin, min(lo + (hi - lo) * bin / {bins}) AS bin_low, count(*) AS n FROM (
  SELECT *, least(coalesce(floor((v - lo) / nullif(hi - lo, 0) * {bins}), 0), {bins - 1})::INTEGER AS bin
  FROM (SELECT {lead}({value})::DOUBLE AS v, ({lo})::DOUBLE AS lo, ({hi})::DOUBLE AS hi FROM {source}
        WHERE ({value}) IS NOT NULL) WHERE v BETWEEN lo AND hi)
GROUP BY {lead}bin"""


@query("arm bin:i bin_low:d n:i", hist(TRADES, "least(holding_bars, 200)", 50, "0", "200", "arm"))
def holding_histogram(spark, sf_dir):
    return rp.holding_histogram(I.all_trades(spark, sf_dir))


@query("arm bin:i bin_low:d n:i",
       hist(TRADES, "least(greatest(pnl, -0.03), 0.03) * 100", 50, "-0.03::DOUBLE * 100", "0.03::DOUBLE * 100", "arm"))
def pnl_histogram(spark, sf_dir):
    return rp.pnl_histogram(I.all_trades(spark, sf_dir))


@query("bin:i bin_low:d n:i",
       hist("o_corr", "train_corr", 80, "(SELECT min(train_corr) FROM o_corr)", "(SELECT max(train_corr) FROM o_corr)"))
def correlation_histogram(spark, sf_dir):
    return cr.correlation_histogram(I.open_weekly_market(spark, sf_dir).train.series, 80)


@query("bin:i bin_low:d n:i",
       hist("oc_fits", "bp_pval", 50, "(SELECT min(bp_pval) FROM oc_fits)", "(SELECT max(bp_pval) FROM oc_fits)"))
def p_value_histogram(spark, sf_dir):
    return rp.histogram(I.open_fits(spark, sf_dir), "bp_pval", 50)


KNOWN = "(SELECT *, bp_pval > 0.05 AS bp_pass FROM oc_fits WHERE half_life > 0 AND half_life < 500)"


@query("bp_pass bin:i bin_low:d n:i", hist(
    KNOWN, "half_life", 40, f"(SELECT min(half_life) FROM {KNOWN})", f"(SELECT max(half_life) FROM {KNOWN})", "bp_pass"))
def half_life_histogram(spark, sf_dir):
    fits = I.open_fits(spark, sf_dir).withColumn("bp_pass", F.col("bp_pval") > 0.05)
    return rp.half_life_histogram(fits)


SPAN = "(SELECT symbol, count(close) * 1.0 / (SELECT count(*) FROM w_grid) AS c FROM w_panel GROUP BY 1)"


@query("bin:i bin_low:d n:i", hist(SPAN, "c", 50, f"(SELECT min(c) FROM {SPAN})", f"(SELECT max(c) FROM {SPAN})"))
def coverage_histogram(spark, sf_dir):
    m = I.weekly_market(spark, sf_dir)
    covered = m.panel.groupBy("symbol").agg(
        (F.count("close") / m.calendar.agg(F.count(F.lit(1))).scalar()).alias("coverage"))
    return rp.histogram(covered, "coverage", 50)


@query("fold_id:i n_liquid:i n_clean:i n_candidates:i n_bp_pass:i n_bp_fail:i", """
SELECT l.fold_id, n_liquid, coalesce(n_clean, 0) AS n_clean, coalesce(n_candidates, 0) AS n_candidates,
       coalesce(n_bp_pass, 0) AS n_bp_pass, coalesce(n_bp_fail, 0) AS n_bp_fail
FROM (SELECT fold_id, least(count(*), 150) AS n_liquid FROM w_cov GROUP BY 1) l
LEFT JOIN (SELECT fold_id, count(*) AS n_clean FROM b_uni GROUP BY 1) USING (fold_id)
LEFT JOIN (SELECT fold_id, count(*) AS n_candidates FROM b_cand GROUP BY 1) USING (fold_id)
LEFT JOIN (SELECT fold_id, count(*) FILTER (WHERE bp_pval > 0.05) AS n_bp_pass,
                  count(*) FILTER (WHERE bp_pval <= 0.05) AS n_bp_fail FROM h_fits GROUP BY 1) USING (fold_id)""")
def selection_funnel(spark, sf_dir):
    from spreadloom.operators.universe import fold_coverage, liquid_in_fold
    from spreadloom.plans.selection import pair_fits

    m = I.baseline_market(spark, sf_dir)
    liquid = liquid_in_fold(fold_coverage(m.panel, m.folds, I.WEEK_FOLDS), I.WEEKLY_BASELINE.eligibility.top_n_liquid)
    candidates = I.once(spark, sf_dir, "baseline_candidates", lambda: I.stage(
        cr.correlated_pairs(m.train.series, I.WEEKLY_BASELINE.correlation), "candidates"))
    fits = pair_fits(candidates, m.train.series).withColumn("bp_pass", F.col("bp_pval") > 0.05)
    return rp.selection_funnel(liquid, m.universe, candidates, fits)


# ---- sinks: written, read back, compared --------------------------------

@query(f"arm {METRICS}", f"SELECT * FROM {TOTALS}")
def json_round_trip(spark, sf_dir):
    path = new_stage_path(spark, "aggregate-json")
    aggregates = I.all_aggregates(spark, sf_dir)
    rs.write_json(aggregates, path)
    return rs.read_json(spark, path, aggregates.schema)


@query(FOLD_METRICS, f"SELECT * FROM {FOLD_ROWS}")
def tsv_round_trip(spark, sf_dir):
    path = new_stage_path(spark, "fold-metrics-tsv")
    rows = I.all_fold_metrics(spark, sf_dir)
    rs.write_tsv(rows, path, order=("arm", "fold_id"))
    return rs.read_tsv(spark, path, rows.schema)


@query("arm fold_id:i sym_a sym_b holding_bars:i pnl:d", f"SELECT * FROM {TRADES}")
def arm_bundle_round_trip(spark, sf_dir):
    out = new_stage_path(spark, "arm-bundle")
    for name, arm in zip(I.ARMS, I.three_arms(spark, sf_dir)):
        rs.commit_arm(arm.tables(), out, name)
    return rs.load_arms(spark, out, ("trades",))["trades"]


@query("arm fold_id:i sym_a sym_b rank:i half_life:d", """
SELECT 'classic' AS arm, fold_id, sym_a, sym_b, rank, half_life FROM c_pairs
UNION ALL SELECT 'window_mean', fold_id, sym_a, sym_b, rank, half_life FROM v_pairs""")
def fold_tables_round_trip(spark, sf_dir):
    out = new_stage_path(spark, "fold-tables")
    for name, arm in (("classic", I.classic_arm(spark, sf_dir)), ("window_mean", I.vector_arm(spark, sf_dir))):
        rs.save_folds({"pairs": arm.pairs}, out, name)
    return spark.read.parquet(f"{out}/pairs")


@query("fold_id:i", """
SELECT fold_id FROM w_folds WHERE (
    SELECT max(bar_seq) FROM w_panel WHERE symbol = (SELECT min(symbol) FROM w_panel)
       AND bar_seq <= (SELECT test_lo FROM w_folds WHERE fold_id = 3)) BETWEEN train_lo AND test_hi""")
def folds_to_run(spark, sf_dir):
    """One bar is corrected; the folds that see it are to be run again."""
    m = I.weekly_market(spark, sf_dir)
    name = m.panel.agg(F.min("symbol")).first()[0]
    edge = m.folds.filter("fold_id = 3").first().test_lo
    at = m.panel.filter((F.col("symbol") == name) & (F.col("bar_seq") <= edge)).agg(F.max("bar_seq")).first()[0]
    hit = (F.col("symbol") == name) & (F.col("bar_seq") == at)
    corrected = m.panel.withColumn("close", F.when(hit, F.col("close") * 1.01).otherwise(F.col("close")))
    before, after = (rt.fold_keys(p, m.folds, I.WEEK_FOLDS, I.WEEKLY.snapshot()) for p in (m.panel, corrected))
    return rt.folds_to_run(after, before)


@query(f"arm {METRICS}", "SELECT * FROM c_agg")
def job_continued(spark, sf_dir):
    """The batch job over all years but the last, then over all: only new folds run, the result is that of one run."""
    files, out = new_stage_path(spark, "bar-files"), new_stage_path(spark, "job")
    bars = I.weekly_bars(spark, sf_dir).select(
        "symbol", F.col("bar_ts").alias("timestamp_utc"), "close", "volume", F.lit(True).alias("is_regular_hours"),
        F.year("bar_ts").alias("year"))
    bars.write.partitionBy("year").parquet(files)
    years = sorted(r.year for r in bars.select("year").distinct().collect())
    job.run_job(spark, files, out, ["classic"], years[:-1], I.WEEKLY, pattern="year={year}")
    return job.run_job(spark, files, out, ["classic"], years, I.WEEKLY, pattern="year={year}")


@query("fold_id:i n_fits:i mean_first:d", """
SELECT fold_id, CASE WHEN fold_id = 1 THEN 2 ELSE 1 END AS n_fits, avg(x[1]) + CASE WHEN fold_id = 1 THEN 1 ELSE 0 END AS mean_first
FROM o_windows GROUP BY fold_id""")
def weights_cache(spark, sf_dir):
    """A fit per fold is kept with its samples; after fold 1's samples change, only fold 1 is fitted again."""
    path = new_stage_path(spark, "weights")
    windows = wn.tumbling_windows(I.open_weekly_market(spark, sf_dir).train.series, I.WEEKLY.autoencoder)
    samples = windows.select("fold_id", "symbol", F.col("window_id").alias("sample_id"), "x", F.lit(0.0).alias("target"))

    def fit(rows):
        return rows.groupBy("fold_id").agg(F.avg(F.col("x")[0]).alias("mean_first"))

    rs.fit_with_cache(samples, fit, path, "demo", "key")
    changed = samples.withColumn("x", F.transform("x", lambda v: F.when(F.col("fold_id") == 1, v + 1).otherwise(v)))
    now = rs.fit_with_cache(changed, fit, path, "demo", "key")
    fits = rs.cached_weights(spark, path, "demo", "key").groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_fits"))
    return now.join(fits, "fold_id")
