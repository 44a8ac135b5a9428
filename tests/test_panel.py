"""Panel, calendar, universe and neighbours on hand-made inputs and brute force."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadloom.config import CorrelationSearch, Eligibility, FoldPlan, MarketClock, NeighbourSearch
from spreadloom.functions.timecols import local_hhmm, utc_clock
from spreadloom.staging import stage
from spreadloom.operators import correlation as cr, energy as en, folds as fd, neighbours as nb, panel as pn
from spreadloom.operators import pairstats as ps, series as sr, universe as un
from spreadloom.sources.bars import load_bars, load_panel_bars

UTC = dt.timezone.utc


def bars_frame(spark, rows):
    return spark.createDataFrame(
        rows, "symbol string, bar_ts timestamp_ntz, close double, volume double, file_order bigint")


def test_open_bar_mask_follows_daylight_saving(spark):
    # New York opens at 14:30 UTC before 10 March 2024 and at 13:30 UTC from then on.
    times = [dt.datetime(2024, 3, 8, 14, 0), dt.datetime(2024, 3, 8, 14, 30), dt.datetime(2024, 3, 8, 15, 0),
             dt.datetime(2024, 3, 11, 13, 30), dt.datetime(2024, 3, 11, 14, 0), dt.datetime(2024, 3, 11, 14, 30)]
    bars = bars_frame(spark, [("A", t, 10.0 + i, 1.0, i) for i, t in enumerate(times)])
    got = {r.bar_ts: r.logret for r in pn.build_panel(bars).collect()}
    assert [got[t] is None for t in times] == [True, True, False, True, False, False]


def test_utc_clock_ignores_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 7, 1, 13, 30, tzinfo=UTC),)], "ts timestamp")
    row = df.select(utc_clock(F.col("ts")).alias("u")).select(
        "u", local_hhmm(F.col("u"), "America/New_York").alias("ny")).first()
    assert row.u == dt.datetime(2024, 7, 1, 13, 30) and row.ny == "09:30"


def test_local_day_differs_from_utc_day(spark):
    bars = bars_frame(spark, [("A", dt.datetime(2024, 1, 2, 3, 0), 1.0, 1.0, 0),
                              ("A", dt.datetime(2024, 1, 2, 15, 0), 1.0, 1.0, 1)])
    days = [r.day for r in pn.grid_calendar(bars).orderBy("bar_ts").collect()]
    assert days == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]


def test_keep_last_takes_whole_row_and_keeps_missing_values(spark):
    t = dt.datetime(2024, 1, 2, 15, 0)
    bars = bars_frame(spark, [("A", t, 1.0, 5.0, 1), ("A", t, None, 7.0, 2), ("B", t, 3.0, 1.0, 9), ("B", t, 4.0, 2.0, 3)])
    got = {r.symbol: (r.close, r.volume) for r in
           pn.keep_last(bars, ["symbol", "bar_ts"], "file_order", ["close", "volume"]).collect()}
    assert got == {"A": (None, 7.0), "B": (3.0, 1.0)}


def test_nan_and_zero_prices_are_missing_returns(spark):
    closes = [1.0, float("nan"), 2.0, 0.0, 4.0, float("inf"), 8.0, 16.0]
    bars = bars_frame(spark, [("A", dt.datetime(2024, 1, 2 + i, 15, 0), c, 1.0, i) for i, c in enumerate(closes)])
    got = [r.logret for r in pn.build_panel(bars).orderBy("bar_seq").collect()]
    # The bars with NaN and infinity are gone but still count as grid rows.
    assert got[:-1] == [None] * (len(got) - 1) and abs(got[-1] - np.log(2)) < 1e-12


def sparse_panel(spark, seed=1, symbols=5, n=700):
    rng = random.Random(seed)
    rows = []
    for s in range(symbols):
        for i in range(n):
            if rng.random() < (0.9 if s else 1.0):
                rows.append((f"S{s}", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), rng.uniform(1, 9), rng.uniform(1, 5), i))
    return bars_frame(spark, rows)


@pytest.mark.parametrize("chunk", [2, 7, 4096])
def test_chunk_size_does_not_change_results(spark, chunk):
    clock = MarketClock(zone="UTC", open_time="none")
    bars = sparse_panel(spark)
    priced = pn.on_grid(bars, pn.grid_calendar(bars, clock))
    def key(rows): return sorted((r.symbol, r.bar_seq, r.logret) for r in rows if r.logret is not None)
    whole = key(pn.log_returns(priced, chunk=10 ** 6).collect())
    assert key(pn.log_returns(priced, chunk=chunk).collect()) == whole
    def fill(c): return sorted(tuple(r) for r in pn.forward_fill(priced, "close", F.lit(699), chunk=c).collect())
    assert fill(max(chunk, 4)) == fill(10 ** 6)


def test_exact_median_with_a_hot_key(spark):
    rng = random.Random(5)
    values = {"hot": [round(rng.gauss(0, 100), 1) for _ in range(3001)], "even": [4.0, 1.0, 3.0, 2.0],
              "one": [-7.5], "same": [2.0] * 500, "wide": [10.0 ** k for k in range(-6, 12)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("none", None)]
    df = spark.createDataFrame(rows, "symbol string, v double")
    got = {r.symbol: r.median for r in un.exact_median(df, "symbol", "v").collect()}
    assert got.keys() == values.keys()
    for k, vs in values.items():
        assert abs(got[k] - statistics.median(vs)) < 1e-12


@pytest.mark.parametrize("plan", [FoldPlan(10, 4, 4), FoldPlan(9, 4, 3), FoldPlan(7, 5, 2)])
def test_folds_equal_loop(spark, plan):
    clock = MarketClock(zone="UTC", open_time="none")
    bars = sparse_panel(spark, n=60)
    cal = pn.grid_calendar(bars, clock)
    got = {r.fold_id: (r.train_lo, r.train_hi, r.test_lo, r.test_hi) for r in fd.fold_table(cal, plan).collect()}
    want, start = {}, 0
    while start + plan.train_days + plan.test_days <= 60:
        a = start + plan.train_days
        want[len(want)] = (start, a - 1, a, a + plan.test_days - 1)
        start += plan.roll_days
    assert got == want
    panel = pn.on_grid(bars, cal)
    for side, (lo, hi) in (("train", (0, 1)), ("test", (2, 3))):
        rows = fd.assign_folds(panel, plan, side).select("fold_id", "symbol", "bar_seq").collect()
        expect = {(f, r.symbol, r.bar_seq) for r in panel.select("symbol", "bar_seq").collect()
                  for f, w in want.items() if w[lo] <= r.bar_seq <= w[hi]}
        assert {tuple(r) for r in rows} == expect and len(rows) == len(expect)
    cov = {(r.fold_id, r.symbol): (r.coverage, r.median_dv) for r in un.fold_coverage(
        panel.withColumn("dollar_vol", F.col("close") * F.col("volume")), fd.fold_table(cal, plan), plan).collect()}
    data = panel.select("symbol", "bar_seq", (F.col("close") * F.col("volume")).alias("d")).collect()
    for (f, s), (c, m) in cov.items():
        dv = [r.d for r in data if r.symbol == s and want[f][0] <= r.bar_seq <= want[f][1]]
        assert abs(c - len(dv) / plan.train_days) < 1e-12 and abs(m - statistics.median(dv)) < 1e-12


def test_lookahead_guard(spark):
    bad = spark.createDataFrame([(0, dt.date(2024, 1, 5), dt.date(2024, 1, 5))],
                                "fold_id int, train_end date, test_start date")
    with pytest.raises(Exception, match="looks ahead"):
        fd.check_no_lookahead(bad).collect()


def test_universe_order(spark):
    rows = [(0, "B", 1.0, 5.0), (0, "A", 1.0, 1.0), (0, "C", 1.0, 9.0), (1, "B", 1.0, 2.0), (1, "A", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "fold_id int, symbol string, coverage double, median_dv double")
    got = {(r.fold_id, r.symbol): r.uni_rank for r in un.rank_universe(df, 2).collect()}
    # Crowded fold: by liquidity, cut. Fold that fits: by name.
    assert got == {(0, "C"): 1, (0, "B"): 2, (1, "A"): 1, (1, "B"): 2}


def test_bars_past_a_border_fail_the_write(spark):
    folds = spark.createDataFrame([(0, 9, 10), (1, 19, 20)], "fold_id int, train_hi bigint, test_lo bigint")
    rows = spark.createDataFrame([(0, "A", 7, [0.1, 0.2, None, None]), (1, "A", 17, [None, None, None, None]), (1, "B", 17, [0.1, 0.2, 0.3, None])],
                                 "fold_id int, symbol string, lo bigint, ret array<double>")
    past = fd.last_bar("ret") - F.col("test_lo") + 1
    kept = fd.stage_guarded(rows, "kept", folds, "test_lo", past)
    assert kept.columns == rows.columns and sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))
    assert fd.stage_guarded(rows.limit(0), "none", folds, "test_lo", past).count() == 0
    late = rows.union(spark.createDataFrame([(1, "C", 17, [0.1, None, None, 0.2])], rows.schema))
    with pytest.raises(fd.LookaheadError, match="fold 1 reads 1 bars past test_lo"):
        fd.stage_guarded(late, "late", folds, "test_lo", past)
    bars = spark.createDataFrame([(0, 10), (1, 19), (1, 21)], "fold_id int, bar_seq bigint")
    with pytest.raises(fd.LookaheadError, match="fold 1 reads 1 bars past train_hi"):
        fd.stage_guarded(bars, "early", folds, "train_hi", F.col("train_hi") - F.col("bar_seq") + 1)


def test_packed_series_fill_limit_and_cold_start(spark):
    folds = spark.createDataFrame([(0, 10, 21)], "fold_id int, train_lo bigint, train_hi bigint")
    rows = spark.createDataFrame([(0, "A", 12, 1.0, 0.1), (0, "A", 13, 2.0, None), (0, "A", 19, 3.0, 0.3)],
                                 "fold_id int, symbol string, bar_seq bigint, close double, logret double")
    r = sr.pack_series(rows, folds, "train").first()
    n = None
    assert r.close == [n, n, 1.0, 2.0, 2.0, 2.0, 2.0, n, n, 3.0, 3.0, 3.0]
    assert r.ret == [n, n, 0.1, n, n, n, n, n, n, 0.3, n, n]


def test_series_are_packed_in_order_without_gathering_bars(spark):
    """Bars were gathered in a list per series; now they are sorted and spread, also where a series goes over batches."""
    rng = random.Random(3)
    folds = spark.createDataFrame([(0, 10, 40), (1, 30, 55)], "fold_id int, train_lo bigint, train_hi bigint")
    rows, want = [], {}
    for fold, lo, hi in ((0, 10, 40), (1, 30, 55)):
        for name in ("A", "B", "C", "D"):
            bars = {s: (rng.random(), rng.choice([None, rng.random()])) for s in range(lo, hi + 1) if rng.random() < 0.5}
            rows += [(fold, name, s, *v) for s, v in bars.items()]
            last = [max((t for t in bars if s - 3 <= t <= s), default=None) for s in range(lo, hi + 1)]
            if bars:
                want[fold, name] = (lo, [None if t is None else bars[t][0] for t in last],
                                    [bars.get(s, (None, None))[1] for s in range(lo, hi + 1)])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "fold_id int, symbol string, bar_seq bigint, close double, logret double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        series = sr.pack_series(df.repartition(5), folds, "train")
        got = {(r.fold_id, r.symbol): (r.lo, r.close, r.ret) for r in series.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    plan = series._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "REPARTITION_BY_NUM" in plan


def packed(spark, arrays, name="ret"):
    rows = [(0, f"S{i:03d}", 0, i + 1, len(arrays), [float(v) if v == v else None for v in a]) for i, a in enumerate(arrays)]
    return spark.createDataFrame(
        rows, f"fold_id int, symbol string, lo bigint, uni_rank int, n_universe bigint, {name} array<double>")


@pytest.mark.parametrize("tile", [3, 8, 64])
def test_correlation_tiles_equal_brute_force(spark, tile):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(11, 90)) + rng.normal(size=90)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[3, 40:] = np.nan
    found = cr.correlated_pairs(packed(spark, x), CorrelationSearch(top_k=20, min_corr=0.3, min_overlap=50), tile)
    got = [(r.rank_a - 1, r.rank_b - 1, r.train_corr) for r in found.orderBy("cand_rank").collect()]
    want = []
    for i in range(11):
        for j in range(i + 1, 11):
            both = np.isfinite(x[i]) & np.isfinite(x[j])
            if both.sum() >= 50:
                c = np.corrcoef(x[i][both], x[j][both])[0, 1]
                if c >= 0.3:
                    want.append((i, j, c))
    want = sorted(want, key=lambda p: -p[2])[:20]
    assert [p[:2] for p in got] == [p[:2] for p in want]
    assert np.allclose([p[2] for p in got], [p[2] for p in want])


def sector_returns(rng, sectors, each, bars=240):
    """Returns that share the bars of missing opens; three gapped series, two constant ones and two equal ones."""
    x = np.concatenate([rng.normal(size=bars) + 0.4 * rng.normal(size=(each, bars)) for _ in range(sectors)])
    x = x[rng.permutation(len(x))]
    x[:, ::13] = np.nan
    x[5:8][rng.random((3, bars)) < 0.3] = np.nan
    x[20] = np.where(np.isnan(x[20]), np.nan, 0.25)
    x[21] = np.where(np.isnan(x[21]), np.nan, 0.0)
    x[40] = x[33]
    return x


@pytest.mark.parametrize("search", [CorrelationSearch(top_k=60), CorrelationSearch(top_k=None, min_corr=0.7),
                                    CorrelationSearch(top_k=100_000, min_corr=None)])
def test_correlation_bounds_leave_out_tiles_and_no_pair(spark, search):
    rng = np.random.default_rng(12)
    folds = [sector_returns(rng, 12, 16), sector_returns(rng, 3, 20)]
    df = packed(spark, folds[0]).unionByName(packed(spark, folds[1]).withColumn("fold_id", F.lit(1)))
    rows = cr.correlated_pairs(df, search, 16).collect()
    for fold, x in enumerate(folds):
        want = {}
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                both = np.isfinite(x[i]) & np.isfinite(x[j])
                a, b = x[i][both], x[j][both]
                if a.std() > 1e-9 and b.std() > 1e-9 and both.sum() >= search.min_overlap:
                    c = np.corrcoef(a, b)[0, 1]
                    if search.min_corr is None or c >= search.min_corr:
                        want[i + 1, j + 1] = c
        best = sorted(want, key=lambda p: (-round(want[p], 12), p))[:search.top_k]
        got = {(r.rank_a, r.rank_b): r for r in rows if r.fold_id == fold}
        assert set(got) == set(best)
        assert all(abs(got[p].train_corr - want[p]) < 1e-9 for p in best)
        assert all(got[p].sym_a == f"S{p[0] - 1:03d}" and got[p].sym_b == f"S{p[1] - 1:03d}" for p in best)


def test_correlation_bounds_hold_and_skip(spark):
    x = sector_returns(np.random.default_rng(3), 12, 16)
    df = packed(spark, x)
    tiles = en.sketched_tiles(df, 16)
    rows = {r.symbol: r for r in tiles.collect()}
    assert len(rows) == len(x) and sum(not r.regular for r in rows.values()) == 5
    assert all(r.tile % 2 == (0 if r.regular else 1) for r in rows.values())
    on, smooth = np.isfinite(x[0]), [i for i in range(len(x)) if rows[f"S{i:03d}"].regular]
    exact = np.corrcoef(x[smooth][:, on])
    c = np.array([rows[f"S{i:03d}"].coords for i in smooth])
    rest = np.array([rows[f"S{i:03d}"].rest for i in smooth])
    assert (c @ c.T + np.outer(rest, rest) + 1e-12 >= exact).all()
    floors = spark.createDataFrame([(0, 0.9)], "fold_id int, floor double")
    among = cr.tile_pairs_in_reach(tiles, floors).filter("tile_a % 2 = 0 AND tile_b % 2 = 0").count()
    n = len({r.tile for r in rows.values() if r.regular})
    assert among < 0.5 * n * (n - 1) / 2


def gapped_returns(rng, n, bars=104):
    """Returns with a common factor, gaps at other bars in each series, some with a few returns that outweigh the rest."""
    x = rng.normal(size=bars) + 0.7 * rng.normal(size=(n, bars))
    x[::9, rng.integers(0, bars, 3)] *= 12
    x[rng.random(x.shape) < rng.random((n, 1)) * 0.1] = np.nan
    x[n // 2] = x[1]
    x[n // 3] = 0.5
    return x


def test_bound_of_a_block_holds_and_is_near():
    rng = np.random.default_rng(21)
    m = gapped_returns(rng, 300)
    (side,) = cr.blocks_of([cr.Side(np.arange(300) + 1, np.array([f"S{i:03d}" for i in range(300)], object), m, np.ones(300, int))])
    (block,) = side
    exact, _ = cr.masked_correlation(block.returns, block.returns)
    for floor in (-0.8, -0.5, -0.1, 0.0, 0.05, 0.5, 0.8, 0.9, 0.99, 1.0):
        with np.errstate(invalid="ignore"):
            assert cr.may_reach(block, block, floor, cr.Room(4))[exact >= floor].all()
            assert cr.may_reach(block, block, floor, cr.Room(4), -1)[-exact >= floor].all()
    assert cr.may_reach(block, block, 0.8, cr.Room(4)).sum() < 6 * (exact >= 0.8).sum()


def test_blocks_are_multiplied_in_full_only_until_a_list_is_there(monkeypatch):
    """Each block took six products in double precision, however far below the list its pairs were."""
    m = gapped_returns(np.random.default_rng(22), 400)
    side = cr.Side(np.arange(400) + 1, np.array([f"S{i:03d}" for i in range(400)], object), m, np.ones(400, int))
    exact, n = cr.masked_correlation(m, m)
    want = sorted(((-round(exact[i, j], 12), i + 1, j + 1) for i in range(400) for j in range(i + 1, 400) if exact[i, j] >= 0.5 and n[i, j] >= 50))[:30]
    full, whole = [], cr.masked_correlation
    monkeypatch.setattr(cr, "BLOCK", 40)
    monkeypatch.setattr(cr, "masked_correlation", lambda x, y: full.append(len(x)) or whole(x, y))
    (rows,) = cr.listed_pairs(0, [side], CorrelationSearch(top_k=30), 0.5)
    assert [(a, b) for a, b in zip(rows["rank_a"], rows["rank_b"])] == [p[1:] for p in want]
    assert len(full) <= 5 < 55


@pytest.mark.parametrize("overlap", [50, 98])
def test_histogram_blocks_are_multiplied_in_full_only_where_needed(monkeypatch, overlap):
    """Each block took six products in double precision twice, once for the range and once for the counts."""
    m = gapped_returns(np.random.default_rng(24), 400)
    exact, n = cr.masked_correlation(m, m)
    above = np.triu(np.ones((400, 400), bool), 1) & (n >= overlap) & np.isfinite(exact)
    monkeypatch.setattr(cr, "BLOCK", 40)
    full, whole = [], cr.masked_correlation
    monkeypatch.setattr(cr, "masked_correlation", lambda x, y: full.append(len(x)) or whole(x, y))
    side = cr.Side(np.arange(400) + 1, np.array([f"S{i:03d}" for i in range(400)], object), m, np.ones(400, int))
    lo, hi = np.inf, -np.inf
    for x, y in cr.block_pairs(cr.blocks_of([side])):
        lo, hi = cr.block_range(x, y, overlap, lo, hi, cr.Room(4))
    assert abs(lo - exact[above].min()) < 1e-12 and abs(hi - exact[above].max()) < 1e-12
    ranged = len(full)
    counts = sum(cr.block_counts(x, y, overlap, lo, hi, 80, cr.Room(7)) for x, y in cr.block_pairs([cr.shapes_of(side)]))
    place = np.clip(np.floor((exact[above] - lo) / (hi - lo) * 80), 0, 79).astype(int)
    assert counts.tolist() == np.bincount(place, minlength=80).tolist()
    if overlap == 50:
        assert ranged < 30 and len(full) - ranged == 10


@pytest.mark.parametrize("tile", [3, 64])
def test_histogram_counts_pairs_of_copies(spark, tile):
    """Series that are alike were multiplied again and again."""
    x = gapped_returns(np.random.default_rng(25), 12)
    x = np.concatenate([np.tile(x, (4, 1)), x[:5], gapped_returns(np.random.default_rng(26), 7)])
    exact, n = cr.masked_correlation(x, x)
    found = exact[np.triu(np.ones(exact.shape, bool), 1) & (n >= 50) & np.isfinite(exact)]
    once = cr.each_once(packed(spark, x))
    assert once.agg(F.count("*"), F.sum("times"), F.max("uni_rank"), F.max("n_universe")).first() == (16, 60, 16, 16)
    bars = cr.correlation_histogram(packed(spark, x), 40, 50, tile).collect()
    place = np.clip(np.floor((found - found.min()) / (1 - found.min()) * 40 + 1e-9), 0, 39).astype(int)
    want = np.bincount(place, minlength=40)
    assert {r.bin: r.n for r in bars} == {k: c for k, c in enumerate(want.tolist()) if c}


@pytest.mark.parametrize("tile", [8, 64])
def test_pairs_of_copies_are_listed_by_rank(spark, tile):
    """Copies' correlations differed in their last digits with the block they were in, so that not the ranks told their order."""
    x = np.tile(gapped_returns(np.random.default_rng(23), 12), (5, 1))
    rows = cr.correlated_pairs(packed(spark, x), CorrelationSearch(top_k=40), tile).orderBy("cand_rank").collect()
    kinds = [i % 12 for i in range(60)]
    kinds = [1 if k == 6 else k for k in kinds]
    want = [(i + 1, j + 1) for i in range(60) for j in range(i + 1, 60) if kinds[i] == kinds[j] != 4][:40]
    assert [(r.rank_a, r.rank_b) for r in rows] == want and {r.train_corr for r in rows} == {1.0}


def test_a_series_is_copied_to_few_tiles_whatever_the_universe(spark):
    """200 series in tiles of 4 went 50 times through the shuffle."""
    x = np.random.default_rng(8).normal(size=(200, 60))
    x[np.random.default_rng(9).random(x.shape) < 0.1] = np.nan
    df = packed(spark, x)
    assert cr.tiled(df, 4).count().agg(F.sum("count")).first()[0] <= 200 * cr.MOST_TILES
    got = {(r.rank_a, r.rank_b): r.train_corr for r in cr.correlated_pairs(df, CorrelationSearch(None, None, 20), 4).collect()}
    assert len(got) == 200 * 199 // 2
    for i, j in [(0, 1), (3, 150), (24, 25), (198, 199)]:
        both = np.isfinite(x[i]) & np.isfinite(x[j])
        assert abs(got[i + 1, j + 1] - np.corrcoef(x[i][both], x[j][both])[0, 1]) < 1e-12
    bars = cr.correlation_histogram(df, 10, 20, 4).orderBy("bin").collect()
    n, low = np.histogram(list(got.values()), 10)
    assert [r.n for r in bars] == n.tolist() and np.allclose([r.bin_low for r in bars], low[:-1])


def test_correlation_of_no_series(spark):
    assert cr.correlated_pairs(packed(spark, np.ones((1, 60))).limit(0), CorrelationSearch(), 4).count() == 0
    empty = packed(spark, np.full((9, 60), np.nan))
    assert cr.correlated_pairs(empty, CorrelationSearch(), 1).count() == 0


@pytest.mark.parametrize("tile", [4, 512])
def test_neighbours_equal_brute_force(spark, tile):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 16))
    v[7] = v[3]
    rows = [(0, f"S{i:03d}", [float(a) for a in x]) for i, x in enumerate(v)] + [(1, "alone", [1.0] * 16)]
    df = spark.createDataFrame(rows, "fold_id int, symbol string, embedding array<double>")
    got = {(r.symbol, r.neighbour) for r in nb.nearest_neighbours(df, 5, tile).collect()}
    d = np.linalg.norm(v[:, None] - v[None, :], axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(f"S{i:03d}", f"S{j:03d}") for i in range(40) for j in np.argsort(d[i], kind="stable")[:5]}
    assert got == want
    pairs = nb.unordered_pairs(nb.nearest_neighbours(df, 5, tile)).collect()
    assert all(p.sym_a < p.sym_b for p in pairs) and len({(p.sym_a, p.sym_b) for p in pairs}) == len(pairs)


def test_far_tiles_are_left_out_and_nothing_is_lost(spark):
    """Groups of vectors far apart, one of equal vectors only, one large: few pairs of tiles are joined."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8)) * 50
    v = np.concatenate([c + rng.normal(size=(25, 8)) for c in centres[:10]] + [np.repeat(centres[10:11], 60, 0), centres[11] + rng.normal(size=(90, 8))])
    rows = [(0, f"S{i:03d}", [float(a) for a in x]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "fold_id int, symbol string, embedding array<double>")
    tiles = nb.pivot_tiles(df, 16)
    assert tiles.count() == len(v) and tiles.select("symbol").distinct().count() == len(v)
    assert tiles.groupBy("tile").count().agg(F.max("count")).first()[0] <= 48
    n_tiles = tiles.select("tile").distinct().count()
    kept = nb.tile_pairs_in_reach(tiles, nb.inside_tiles(tiles, 4), 4).count()
    assert kept < 0.5 * n_tiles * (n_tiles - 1) / 2
    got = {}
    for r in nb.nearest_neighbours(df, 4, 16).collect():
        got.setdefault(r.symbol, []).append((round(r.distance, 9), r.neighbour))
    d = np.linalg.norm(v[:, None] - v[None, :], axis=2)
    np.fill_diagonal(d, np.inf)
    for i in range(len(v)):
        want = sorted((round(d[i, j], 9), f"S{j:03d}") for j in range(len(v)) if j != i)[:4]
        assert [x for _, x in sorted(got[f"S{i:03d}"])] == [x for _, x in want]


def test_weeks_of_suppliers_are_dealt_by_number(spark, sf_dir, monkeypatch):
    """The names alone are a few bytes, so all their weeks were made, sorted and filled in one task."""
    from catalog import inputs as I

    parts = {}

    def noted(df, label):
        table = stage(df, label)
        parts[label] = len(table.inputFiles())
        return table

    monkeypatch.setattr(I, "stage", noted)
    bars = I.supplier_week_bars(spark, sf_dir)
    assert parts["supplier-grid"] > 1
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_weeks_of_suppliers_take_one_shuffle(spark, sf_dir, monkeypatch):
    """The grid of all weeks was joined to the weeks with lines, which shuffled both by week and the result again by supplier."""
    from catalog import inputs as I

    plans = {}

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, label)

    monkeypatch.setattr(I, "stage", noted)
    I.supplier_week_bars(spark, sf_dir)
    plan = plans["supplier-grid"]
    assert "MergeJoin" not in plan and "HashJoin" not in plan and plan.count("Exchange hashpartitioning(l_suppkey") == 1
    assert set(plans) == {"supplier-grid", "factor"}


def test_times_are_distinct_before_their_days_are_made(spark, monkeypatch):
    """The filter on the month was pushed below ``distinct``, so that every bar had its zone converted."""
    plans = {}

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return stage(df, label)

    monkeypatch.setattr(pn, "stage", noted, raising=False)
    bars = spark.createDataFrame([("a", dt.datetime(2020, 1, 6)), ("b", dt.datetime(2020, 1, 6)), ("a", None)], "symbol string, bar_ts timestamp_ntz")
    assert pn.grid_calendar(bars).count() == 1
    assert "convert_timezone" not in plans["bar-times"] and "trunc" not in plans["bar-times"]


def test_summaries_are_dealt_by_number(spark, monkeypatch):
    """By bytes a few tasks got the summaries of all symbols, which the folds that hold them multiply."""
    seen = []

    def noted(df, label):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, label)

    monkeypatch.setattr(un, "stage", noted)
    start = dt.datetime(2020, 1, 6)
    rows = [(s, start + dt.timedelta(days=d), 10.0 + d % 7, 5.0 + d % 3, d) for s in ("a", "b") for d in range(12)]
    bars = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, close double, volume double, file_order int")
    panel = pn.build_panel(bars, MarketClock(zone="UTC", open_time="none"))
    plan = FoldPlan(train_days=6, test_days=2, roll_days=2)
    folds = fd.fold_table(panel.select("day", "day_idx", "bar_seq", "n_days").distinct(), plan)
    assert un.fold_coverage(panel, folds, plan).count() == 2 * folds.count() > 0
    assert "REPARTITION_BY_NUM" in seen[0]


def random_vectors(spark, n):
    v = np.random.default_rng(12).normal(size=(n, 6))
    rows = [(0, f"S{i:03d}", [float(a) for a in x]) for i, x in enumerate(v)]
    return v, spark.createDataFrame(rows, "fold_id int, symbol string, embedding array<double>")


def test_a_fold_has_few_tiles_whatever_its_vectors(spark):
    """300 vectors in tiles of 4 were 80 tiles and over 3,000 pairs of them."""
    _, df = random_vectors(spark, 300)
    tiles = nb.pivot_tiles(df, 4, most=nb.MOST_TILES)
    assert tiles.select("tile").distinct().count() <= nb.MOST_TILES + 2 * nb.PIVOTS


def test_nearest_pairs_bound_the_search(spark):
    """A list of 10 pairs asks for no vector's neighbours beyond what it can hold, and loses none."""
    v, df = random_vectors(spark, 200)
    few, every = (nb.nearest_neighbours(df, 5, 8, first=f).count() for f in (10, None))
    assert few < 0.5 * every
    d = np.linalg.norm(v[:, None] - v[None, :], axis=2)
    np.fill_diagonal(d, np.inf)
    near = {(min(i, j), max(i, j)) for i in range(200) for j in np.argsort(d[i], kind="stable")[:5]}
    want = [(f"S{i:03d}", f"S{j:03d}") for _, i, j in sorted((d[i, j], i, j) for i, j in near)[:10]]
    got = nb.neighbour_pairs(df, NeighbourSearch(5, 10), 8).orderBy("cand_rank").collect()
    assert [(r.sym_a, r.sym_b) for r in got] == want


def pair_rows(spark, a, b):
    rows = [(0, "a", "b", i, x, y) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(
        rows, "fold_id int, sym_a string, sym_b string, bar_seq bigint, close_a double, close_b double")


def test_short_or_constant_pairs_have_no_fit(spark):
    rng = np.random.default_rng(1)
    walk = [float(v) for v in np.exp(np.cumsum(rng.normal(0, 0.1, 100)))]
    assert ps.pair_statistics(pair_rows(spark, walk, [5.0] * 100)).count() == 0
    assert ps.pair_statistics(pair_rows(spark, walk[:15], walk[5:20])).count() == 0
    assert ps.hedge_ratios(pair_rows(spark, walk[:9], walk[5:14])).first().beta is None
    short = ps.pair_statistics(pair_rows(spark, walk[:40], walk[50:90])).first()
    assert short.bp_stat is None and short.n_rows == 40
    assert ps.eligible_pairs(ps.pair_statistics(pair_rows(spark, walk[:40], walk[50:90]))).count() == 0


def test_pair_statistics_equal_least_squares(spark):
    rng = np.random.default_rng(8)
    lb = np.cumsum(rng.normal(0, 0.05, 300))
    noise = np.zeros(300)
    for i in range(1, 300):
        noise[i] = 0.8 * noise[i - 1] + rng.normal(0, 0.02)
    la = 0.3 + 1.4 * lb + noise
    r = ps.with_p_value(ps.pair_statistics(pair_rows(
        spark, [float(v) for v in np.exp(la)], [float(v) for v in np.exp(lb)]))).first()
    x = np.column_stack([np.ones(300), lb])
    coef = np.linalg.lstsq(x, la, rcond=None)[0]
    e = la - x @ coef
    assert np.allclose([r.alpha, r.beta, r.sigma], [*coef, e.std(ddof=1)])
    b = np.linalg.lstsq(np.column_stack([np.ones(299), e[:-1]]), np.diff(e), rcond=None)[0][1]
    assert np.isclose(r.half_life, -np.log(2) / np.log(1 + b))
    fit = x @ np.linalg.lstsq(x, e ** 2, rcond=None)[0]
    lm = 300 * (1 - ((e ** 2 - fit) ** 2).sum() / ((e ** 2 - (e ** 2).mean()) ** 2).sum())
    assert np.isclose(r.bp_stat, lm) and 0 <= r.bp_pval <= 1


def test_p_values_equal_the_error_function(spark):
    values = [0.0, 1e-12, 0.01, 0.5, 1.0, 3.84, 6.63, 12.4, 12.5, 12.6, 30.0, 200.0, 1400.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "bp_stat double")
    got = ps.with_p_value(df).collect()
    assert got[-1].bp_pval is None
    for v, r in zip(values, got):
        assert math.isclose(r.bp_pval, math.erfc(math.sqrt(v / 2)), rel_tol=1e-10, abs_tol=1e-300)


def test_critical_value_matches_alpha():
    assert abs(Eligibility().bp_critical - 3.841458820694124) < 1e-9


@pytest.fixture(scope="module")
def bar_files(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("bars"))
    for year in (2019, 2020):
        rows = [(s, dt.datetime(year, 1, 2 + d, 14, 30, tzinfo=UTC), 10.0 + d, 100.0, f"{year}-01-{2 + d:02d}", d != 3)
                for d in range(6) for s in ("A", "B")]
        rows += [("A", dt.datetime(year, 1, 2, 14, 30, tzinfo=UTC), 77.0, 1.0, f"{year}-01-02", True)]
        spark.createDataFrame(rows, (
            "symbol string, timestamp_utc timestamp, close double, volume double, date_ny string, "
            "is_regular_hours boolean")).coalesce(1).write.parquet(f"{base}/bars_30m_{year}.parquet")
    return base


def test_bar_files(spark, bar_files):
    df = load_bars(spark, bar_files, [2019, 2020], columns=["close", "symbol", "close"])
    assert df.columns == ["close", "symbol"] and df.count() == 22
    assert load_bars(spark, bar_files, 2019, regular_hours_only=False).count() == 13
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(is_regular_hours,true)" in plan and "volume" not in plan.split("ReadSchema")[1]


def test_panel_from_bar_files_keeps_last_copy(spark, bar_files):
    panel = pn.build_panel(load_panel_bars(spark, bar_files, [2019, 2020]))
    first = {r.symbol: r.close for r in panel.filter("bar_seq = 0").collect()}
    assert first == {"A": 77.0, "B": 10.0}
    assert panel.count() == 20 and panel.agg(F.max("bar_seq")).first()[0] == 9


def test_last_copy_across_part_files(spark, tmp_path):
    base = str(tmp_path / "parts")
    rows = [("A", dt.datetime(2020, 1, 2, 14, 30), float(i), 1.0, True) for i in range(40)]
    df = spark.createDataFrame(rows, (
        "symbol string, timestamp_utc timestamp_ntz, close double, volume double, is_regular_hours boolean"))
    df.repartitionByRange(5, "close").write.option("maxRecordsPerFile", 3).parquet(f"{base}/bars_30m_2020.parquet")
    bars = load_panel_bars(spark, base, 2020)
    assert [r.close for r in bars.orderBy("file_order").collect()] == [float(i) for i in range(40)]
    assert pn.build_panel(bars).first().close == 39.0


def test_dedup_combines_before_the_shuffle(spark, bar_files):
    bars = load_panel_bars(spark, bar_files, [2019, 2020])
    plan = pn.keep_last(bars, ["symbol", "bar_ts"], "file_order", ["close"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_last_copy_in_files_of_any_name(spark, tmp_path):
    base = str(tmp_path / "foreign")
    day = dt.datetime(2020, 1, 2, 14, 30)
    for name, close in (("b-second", 2.0), ("a-first", 1.0)):
        spark.createDataFrame([("A", day, close, 1.0, True)], (
            "symbol string, timestamp_utc timestamp_ntz, close double, volume double, is_regular_hours boolean")
        ).coalesce(1).write.parquet(f"{base}/raw-{name}")
        [file] = (tmp_path / "foreign" / f"raw-{name}").glob("*.parquet")
        (tmp_path / "foreign" / "bars_30m_2020.parquet").mkdir(exist_ok=True)
        file.rename(tmp_path / "foreign" / "bars_30m_2020.parquet" / f"{name}.parquet")
    assert pn.build_panel(load_panel_bars(spark, base, 2020)).first().close == 2.0


@pytest.mark.parametrize("years", [[2019, 2020], [2020, 2019]])
def test_columns_of_some_years_are_kept(spark, tmp_path, years):
    base = str(tmp_path)
    for year, cols in ((2019, "'A' AS symbol, 1.0D AS close"), (2020, "'A' AS symbol, 2.0D AS close, 5 AS late")):
        spark.sql(f"SELECT {cols}, true AS is_regular_hours").write.parquet(f"{base}/bars_30m_{year}.parquet")
    rows = {r.close: r.late for r in load_bars(spark, base, years).collect()}
    assert rows == {1.0: None, 2.0: 5}


def _median(values):
    values = sorted(v for v in values if v is not None)
    return (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2 if values else None


def test_exact_median_equals_sorting(spark):
    rng = random.Random(4)
    keyed = {
        "one": [3.5], "two": [1.0, 2.0], "even": [rng.uniform(0, 1e9) for _ in range(2000)], "equal": [7.25] * 501,
        "signs": [rng.gauss(0, 5) for _ in range(999)], "tiny": [rng.uniform(0, 1e-9) for _ in range(100)],
        "gap": [1.0] * 50 + [1e12] * 50, "ties": [float(rng.randrange(5)) for _ in range(1000)], "nothing": [None, None],
        "close": [1e6 + rng.random() * 1e-6 for _ in range(777)], "some": [None if rng.random() < 0.4 else rng.lognormvariate(10, 3) for _ in range(801)]}
    rows = [(k, v) for k, values in keyed.items() for v in values] + [(None, 5.0)]
    rng.shuffle(rows)
    got = un.exact_median(spark.createDataFrame(rows, "symbol string, v double").repartition(7), "symbol", "v")
    assert {r.symbol: r["median"] for r in got.collect()} == {k: _median(v) for k, v in keyed.items() if _median(v) is not None}


@pytest.mark.parametrize("plan", [FoldPlan(12, 4, 4), FoldPlan(10, 3, 7), FoldPlan(6, 2, 9)])
def test_fold_medians_and_coverage_equal_a_loop(spark, plan):
    rng = random.Random(plan.roll_days)
    n_days, per_day = 47, 5
    rows = []
    for s in range(6):
        for i in range(n_days * per_day):
            if rng.random() < 0.9 and not (s == 5 and i < 100):
                volume = None if rng.random() < 0.1 or s == 4 else rng.choice([0.0, -2.0, rng.lognormvariate(12, 2), 40.0])
                rows.append((f"s{s}", i // per_day, n_days, i, None if rng.random() < 0.05 else 1.0, volume))
    panel = spark.createDataFrame(rows, "symbol string, day_idx long, n_days long, bar_seq long, close double, dollar_vol double")
    n_folds = (n_days - plan.train_days - plan.test_days) // plan.roll_days + 1
    folds = spark.createDataFrame(
        [(k, k * plan.roll_days * per_day, (k * plan.roll_days + plan.train_days) * per_day - 1) for k in range(n_folds)],
        "fold_id int, train_lo long, train_hi long")
    want = {}
    for k in range(n_folds):
        lo, hi = k * plan.roll_days * per_day, (k * plan.roll_days + plan.train_days) * per_day - 1
        for s in range(6):
            mine = [r for r in rows if r[0] == f"s{s}" and lo <= r[3] <= hi and r[4] is not None]
            if mine:
                want[k, f"s{s}"] = (len(mine) / (hi - lo + 1), _median([r[5] for r in mine]))
    got = un.fold_coverage(panel.repartition(3), folds, plan)
    assert {(r.fold_id, r.symbol): (r.coverage, r.median_dv) for r in got.collect()} == want
