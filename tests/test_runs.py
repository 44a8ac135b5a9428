"""Whole runs: no lookahead, caps, empty selections, the batch job, plan shapes."""

import datetime as dt
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from catalog import inputs as I
from spreadloom.config import CorrelationSearch, FoldPlan, RunSettings, baseline_settings
from spreadloom.plans import job, selection as sl, walk_forward as wf
from spreadloom.plans.report_job import ORDERS
from spreadloom.plans.walk_forward import open_market, run_arm
from spreadloom.operators import correlation as cr, pairstats as ps, universe as un
from spreadloom.operators.panel import build_panel
from spreadloom.operators.signal import evaluate_pairs
from spreadloom.sources import results as rs
from spreadloom.staging import stage


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_do_not_see_the_test_window(spark, sf_dir):
    panel = I.weekly_panel(spark, sf_dir)
    market = I.weekly_market(spark, sf_dir)
    edge = market.folds.filter("fold_id = 0").first().train_hi
    tampered = panel.withColumn("close", F.when(F.col("bar_seq") > edge, F.col("close") * 7).otherwise(F.col("close"))) \
        .withColumn("logret", F.when(F.col("bar_seq") > edge, F.lit(0.5)).otherwise(F.col("logret")))
    other = open_market(stage(tampered, "tampered"), I.WEEKLY)
    def first_fold(m): return sorted(map(str, sl.correlation_selector(I.WEEKLY)(m.train).filter("fold_id = 0").collect()))
    assert first_fold(market) == first_fold(other)


def test_arm_invariants(spark, sf_dir):
    arm = I.classic_arm(spark, sf_dir)
    assert arm.pairs.groupBy("fold_id").count().filter(F.col("count") > 20).count() == 0
    assert {r.position for r in arm.pair_bars.select("position").distinct().collect()} <= {-1, 0, 1}
    off = arm.pair_bars.filter(F.abs(F.col("net_ret") - (F.col("gross_ret") - F.col("cost"))) > 1e-12)
    assert off.count() == 0
    assert arm.portfolio.count() == arm.fold_metrics.agg(F.sum("n_bars")).first()[0]
    total = arm.fold_metrics.agg(F.sum("n_trades")).first()[0]
    assert arm.aggregate.first().n_trades == total == arm.trades.count()


def test_no_pairs_gives_a_flat_counted_series(spark, sf_dir):
    market = I.weekly_market(spark, sf_dir)
    none = replace(I.WEEKLY, correlation=CorrelationSearch(top_k=10, min_corr=0.999999))
    arm = run_arm(market, sl.correlation_selector(none), "none")
    rows = arm.fold_metrics.collect()
    assert len(rows) == 9
    for r in rows:
        assert (r.n_bars, r.return_total, r.sharpe_annualized, r.max_drawdown, r.n_active_pairs) == (26, 0, 0, 0, 0)
        assert r.n_trades is None and r.avg_trade_pnl is None
    assert arm.aggregate.first().n_bars == 9 * 26


def test_single_symbol_universe_has_no_pairs(spark, sf_dir):
    bars = I.weekly_bars(spark, sf_dir).filter("symbol = 'S0000001'")
    panel = stage(build_panel(bars, I.WEEK_CLOCK, order=None), "one")
    market = open_market(panel, replace(I.WEEKLY, folds=FoldPlan(52, 13, 13)))
    assert sl.correlation_selector(I.WEEKLY)(market.train).count() == 0


def test_partition_count_does_not_change_results(spark, sf_dir):
    market = I.weekly_market(spark, sf_dir)
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            arm = run_arm(market, sl.correlation_selector(I.WEEKLY), "again")
            return [[round(v, 9) if isinstance(v, float) else v for v in r]
                    for r in arm.fold_metrics.orderBy("fold_id").collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert run("3") == run("13")


def test_baseline_settings():
    s = baseline_settings()
    assert s.eligibility.min_coverage == 1.0 and s.eligibility.rank_by == "half_life"
    assert s.rule.full_window and not RunSettings().rule.full_window
    assert RunSettings().snapshot()["folds"]["train_days"] == 252


@pytest.fixture(scope="module")
def weekly_files(spark, sf_dir, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("weekly") / "files")
    I.weekly_bars(spark, sf_dir).select(
        "symbol", F.col("bar_ts").alias("timestamp_utc"), "close", "volume",
        F.lit(True).alias("is_regular_hours"), F.year("bar_ts").alias("year"),
    ).write.partitionBy("year").parquet(base)
    return base


def test_job_saves_and_reloads_every_arm(spark, sf_dir, weekly_files, tmp_path):
    out = str(tmp_path / "out")
    years = list(range(1995, 2002))
    arms = ["classic", "autoencoder", "gru", "baseline"]
    job.run_job(spark, weekly_files, out, arms, years, I.WEEKLY, pattern="year={year}", baseline=I.WEEKLY_BASELINE)
    tables = rs.load_arms(spark, out)
    assert sorted(r.arm for r in tables["aggregate"].collect()) == sorted(arms)
    assert tables["equity"].groupBy("arm").count().filter(F.col("count") == 234).count() == 4
    assert rs.read_json(spark, f"{out}/comparison").count() == 4
    config = json.loads(tables["config"].filter("arm = 'baseline'").first().config)
    assert config["years"] == years and config["settings"]["rule"]["full_window"]
    counts = spark.read.parquet(f"{out}/selection").groupBy("arm").agg(
        F.count("*").alias("folds"), F.sum("n_selected").alias("n"), F.min(F.col("n_candidates") - F.col("n_selected")).alias("left")).collect()
    assert {r.arm: r.folds for r in counts} == dict.fromkeys(arms, 9) and all(r.left >= 0 for r in counts)
    pairs = rs.load_arms(spark, out, ("pairs",))["pairs"].groupBy("arm").count().collect()
    assert {r.arm: r["count"] for r in pairs} == {r.arm: r.n for r in counts if r.n}
    # Every report is there, and says what the saved tables say.
    text = {name: spark.read.option("sep", "\t").option("header", True).csv(f"{out}/reports/{name}") for name in ORDERS}
    assert text["fold_metrics"].count() == 4 * 9 and text["equity"].columns == ["bar_ts", *arms]
    assert text["cost_sensitivity"].count() == 4 * 7 and text["pair_overlap"].count() == 16 and text["headline"].count() == 10
    assert text["trades"].count() == tables["trades"].count()
    said = {r.arm: float(r.sharpe_annualized) for r in text["summary"].collect()}
    assert said == {r.arm: round(r.sharpe_annualized, 6) for r in tables["aggregate"].collect()}
    want = I.classic_arm(spark, sf_dir).aggregate.first()
    got = tables["aggregate"].filter("arm = 'classic'").first()
    assert abs(got.sharpe_annualized - want.sharpe_annualized) < 1e-9 and got.n_trades == want.n_trades
    kept = rs.load_arms(spark, out, ("embeddings", "lookbacks"))
    assert {r.arm for r in kept["embeddings"].select("arm").distinct().collect()} == {"autoencoder", "gru"}
    assert kept["lookbacks"].filter("lookback between 1 and 15").count() == kept["lookbacks"].count() > 0
    # The second run reads its weights and leaves the other arms' tables alone.
    weights = spark.read.parquet(f"{out}/weights").count()
    job.run_job(spark, weekly_files, out, ["autoencoder"], years, I.WEEKLY, pattern="year={year}")
    assert spark.read.parquet(f"{out}/weights").count() == weights
    assert rs.load_arms(spark, out)["aggregate"].count() == 4


def test_plans_have_no_cross_joins(spark, sf_dir):
    market = I.weekly_market(spark, sf_dir)
    pairs = I.classic_arm(spark, sf_dir).pairs.drop("arm")
    for df in (cr.correlated_pairs(market.train.series), wf.trade_test(market, pairs),
               ps.pair_statistics(ps.pair_grid(pairs.select(*ps.PAIR), market.train.series)),
               market.universe, I.classic_arm(spark, sf_dir).fold_metrics):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pair_chain_shuffles_pairs_once(spark, sf_dir):
    market = I.weekly_market(spark, sf_dir)
    pairs = I.classic_arm(spark, sf_dir).pairs.select(*ps.PAIR, "alpha", "beta", "mu", "sigma", "half_life")
    grid = ps.pair_grid(pairs, market.train.series)
    for df in (evaluate_pairs(grid, I.WEEKLY.rule), ps.pair_statistics(grid)):
        plan = plan_of(df)
        assert plan.count("Exchange hashpartitioning(fold_id") == 1, plan


@pytest.mark.parametrize("roll", [26, 13])
def test_bars_are_counted_before_folds_share_them(spark, sf_dir, roll, monkeypatch):
    """The summary is shuffled as counts, then by symbol; the overlap of folds multiplies it behind that."""
    m, plans, brackets = I.weekly_market(spark, sf_dir), [], un.middle_brackets
    monkeypatch.setattr(un, "middle_brackets", lambda counts, *a, **b: plans.append(plan_of(counts)) or brackets(counts, *a, **b))
    un.fold_coverage(m.panel, m.folds, FoldPlan(104, 26, roll))
    assert plans[0].index("Generate explode") < plans[0].index("Exchange hashpartitioning(symbol")
    assert plans[0].count("Exchange hashpartitioning") == 2


def rows_of(df) -> list:
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect()), key=str)


def test_a_killed_job_goes_on_and_added_years_run_only_new_folds(spark, weekly_files, tmp_path, monkeypatch):
    years, arms, ran = list(range(1995, 2002)), ["classic", "baseline"], []
    run_folds = job.run_folds

    def counted(market, selector, arm):
        if arm == "baseline" and len(ran) == 1:
            raise RuntimeError("killed")
        ran.append((arm, sorted(r.fold_id for r in market.folds.select("fold_id").collect())))
        return run_folds(market, selector, arm)

    monkeypatch.setattr(job, "run_folds", counted)

    def run(out, arms, years):
        return job.run_job(spark, weekly_files, str(tmp_path / out), arms, years, I.WEEKLY, pattern="year={year}", baseline=I.WEEKLY_BASELINE)

    with pytest.raises(RuntimeError):
        run("out", arms, years[:-1])
    ran.append("killed")
    run("out", arms, years[:-1])
    assert [r if r == "killed" else r[0] for r in ran] == ["classic", "killed", "baseline"]  # the saved arm is not run again
    first = set(ran[0][1])
    run("out", arms, years)
    whole = set(range(9))
    assert first < whole and [(a, set(f)) for a, f in ran[3:]] == [("classic", whole - first), ("baseline", whole - first)]
    run("out", arms, years)
    assert len(ran) == 5  # nothing has changed
    run("zero", arms, years)
    tables = ("aggregate", "fold_metrics", "trades", "equity", "pairs", "portfolio", "fold_keys")
    got, want = (rs.load_arms(spark, str(tmp_path / out), tables) for out in ("out", "zero"))
    for name in tables:
        assert rows_of(got[name]) == rows_of(want[name]), name


def test_readers_see_the_bundle_before_until_the_new_one_is_whole(spark, tmp_path):
    out = str(tmp_path / "out")

    def tables(n):
        return {"aggregate": spark.createDataFrame([(n,)], "v int"), "trades": spark.createDataFrame([(n,), (n,)], "v int")}

    def seen():
        return [sorted(r.v for r in df.collect()) for df in rs.load_arms(spark, out, ("aggregate", "trades")).values()]

    rs.commit_arm(tables(1), out, "classic")
    broken = tables(2) | {"trades": spark.range(1).select(F.raise_error(F.lit("lost")).alias("v"))}
    with pytest.raises(Exception, match="lost"):
        rs.commit_arm(broken, out, "classic")
    assert seen() == [[1], [1, 1]]
    open_before = rs.read_bundle(spark, out, "classic", "trades")
    rs.commit_arm(tables(3), out, "classic")
    assert seen() == [[3], [3, 3]] and open_before.count() == 2
    rs.commit_arm(tables(4), out, "other")
    assert seen() == [[3, 4], [3, 3, 4, 4]]
    assert len(rs.names_in(spark, f"{out}/bundles/arm=classic")) == 3  # two bundles and the markers
