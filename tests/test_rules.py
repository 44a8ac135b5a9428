"""The trading rule against plain loops on random series."""

import math
import random
import re
import statistics
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from spreadloom.config import TradeRule
from spreadloom.operators import signal as sg

KEYS = ("fold_id", "sym_a", "sym_b")


# Positions worked out by hand for entry 2.5, exit 0.5, stop 4.0; None is a missing z.
BY_HAND = [
    ([0.0, 2.4, 2.5, 1.0, 0.6, 0.5, 3.0], [0, 0, -1, -1, -1, 0, -1]),
    ([-2.5, -3.9, -0.6, 2.6, 0.4], [1, 1, 1, 1, 0]),
    ([-3.0, None, -2.0, -2.5, -4.0, -3.0], [1, 0, 0, 1, 0, 1]),
    ([2.6, 4.0, 4.0, 4.1, 3.9, 3.9], [-1, 0, -1, 0, -1, -1]),
    ([None, None, 2.5], [0, 0, -1]),
    ([-2.5, 4.5, -4.5, 0.0, 0.0], [1, 0, 1, 0, 0]),
]
# The same rule as a walk over rows in SQL: (position before, z) gives the position.
WALK = """
WITH RECURSIVE walk AS (
    SELECT series, -1 AS i, 0 AS position FROM (SELECT DISTINCT series FROM z)
    UNION ALL
    SELECT w.series, z.i, CASE
        WHEN z.z IS NULL THEN 0
        WHEN w.position = 0 AND abs(z.z) >= {entry} THEN -sign(z.z)::INTEGER
        WHEN w.position <> 0 AND NOT (abs(z.z) > {exit} AND abs(z.z) < {stop}) THEN 0
        ELSE w.position END
    FROM walk w JOIN z ON z.series = w.series AND z.i = w.i + 1)
SELECT series, list(position ORDER BY i) FROM walk WHERE i >= 0 GROUP BY series"""


def loop_trades(pos, gross, cost):
    trades, start, side = [], None, 0
    for i, p in enumerate(pos):
        if start is not None and p != side:
            trades.append((side, start, i, sum(gross[start + 1:i + 1]) - sum(cost[start:i + 1])))
            start = None
        if start is None and p != 0:
            start, side = i, p
    if start is not None:
        i = len(pos) - 1
        trades.append((side, start, i, sum(gross[start + 1:]) - sum(cost[start:])))
    return trades


def z_series(seed, n=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        roll = rng.random()
        if roll < 0.08:
            out.append(None)
        elif roll < 0.3:
            out.append(rng.choice([-1, 1]) * rng.uniform(3.5, 6))
        else:
            out.append(rng.choice([-4.0, -2.5, -0.5, 0.5, 2.5, 4.0, rng.uniform(-4.5, 4.5)]))
    return out


@pytest.fixture(scope="module")
def z_rows(spark):
    series = {s: z_series(s) for s in range(60)}
    rows = [(s, "a", "b", i, i, z) for s, zs in series.items() for i, z in enumerate(zs)]
    df = spark.createDataFrame(
        rows, "fold_id int, sym_a string, sym_b string, bar_seq bigint, block bigint, z double")
    return series, df


@pytest.mark.parametrize("rule", [TradeRule(), TradeRule(z_entry=2.0, z_exit=0.5, z_stop=4.0),
                                  TradeRule(z_entry=1.0, z_exit=1.5, z_stop=3.0)])
def test_positions_equal_a_recursive_query(z_rows, rule):
    series, df = z_rows
    con = duckdb.connect()
    con.execute("CREATE TABLE z (series INTEGER, i INTEGER, z DOUBLE)")
    con.executemany("INSERT INTO z VALUES (?, ?, ?)", [(s, i, z) for s, zs in series.items() for i, z in enumerate(zs)])
    want = dict(con.execute(WALK.format(entry=rule.z_entry, exit=rule.z_exit, stop=rule.z_stop)).fetchall())
    got = {}
    for r in sg.positions(df, rule).orderBy("fold_id", "bar_seq").collect():
        got.setdefault(r.fold_id, []).append(r.position)
    assert got == want


@pytest.mark.parametrize("zs, want", BY_HAND)
def test_positions_by_hand(spark, zs, want):
    df = spark.createDataFrame([(0, "a", "b", i, i, z) for i, z in enumerate(zs)],
                               "fold_id int, sym_a string, sym_b string, bar_seq bigint, block bigint, z double")
    assert [r.position for r in sg.positions(df, TradeRule()).orderBy("bar_seq").collect()] == want


def test_stop_sized_z_toggles(spark):
    rows = [(0, "a", "b", i, i, z) for i, z in enumerate([5.0, 5.0, 5.0, -5.0, 0.0])]
    df = spark.createDataFrame(
        rows, "fold_id int, sym_a string, sym_b string, bar_seq bigint, block bigint, z double")
    got = [r.position for r in sg.positions(df, TradeRule()).orderBy("bar_seq").collect()]
    assert got == [-1, 0, -1, 0, 0]


@pytest.mark.parametrize("full", [False, True])
def test_rolling_z_equals_loop(spark, full):
    rule = TradeRule(full_window=full)
    rng = random.Random(7)
    series, rows = {}, []
    for s, hl in enumerate([1.0, 2.5, 3.75, 9.0, 20.3, 150.0]):
        values = [None if rng.random() < 0.15 else rng.gauss(0, 1) for _ in range(400)]
        series[s] = (hl, values)
        rows += [(s, "a", "b", 1000, 1000 + i, hl, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(
        rows, "fold_id int, sym_a string, sym_b string, first_seq bigint, bar_seq bigint, half_life double, spread double")
    got = {}
    for r in sg.rolling_zscores(sg.with_blocks(df, rule), rule).orderBy("fold_id", "bar_seq").collect():
        got.setdefault(r.fold_id, []).append(r.z)
    for s, (hl, values) in series.items():
        w = max(round(hl * 2), 5)
        need = w if full else max(w // 2, 5)
        for i, v in enumerate(values):
            seen = [x for x in values[max(0, i - w + 1):i + 1] if x is not None]
            if v is None or len(seen) < need:
                assert got[s][i] is None
            else:
                want = (v - statistics.fmean(seen)) / statistics.stdev(seen)
                assert math.isclose(got[s][i], want, rel_tol=1e-9, abs_tol=1e-9)


def test_returns_costs_and_trades_equal_loop(spark):
    rng = random.Random(3)
    rule = TradeRule()
    series, rows = {}, []
    for s in range(40):
        beta = rng.uniform(0.2, 2.0)
        # Sign flips without a flat bar are allowed here, the trade log must close and reopen.
        pos = [rng.choice([-1, 0, 0, 1, 1]) for _ in range(60)]
        ra = [None if rng.random() < 0.1 else rng.gauss(0, 0.01) for _ in pos]
        rb = [None if rng.random() < 0.1 else rng.gauss(0, 0.01) for _ in pos]
        series[s] = (beta, pos, ra, rb)
        rows += [(s, "a", "b", 500 + i, 500 + i, beta, p, ra[i], rb[i]) for i, p in enumerate(pos)]
    df = spark.createDataFrame(rows, (
        "fold_id int, sym_a string, sym_b string, bar_seq bigint, block bigint, beta double, "
        "position int, ret_a double, ret_b double"))
    bars = sg.position_returns(df, rule)
    got, trades = {}, {}
    for r in bars.orderBy("fold_id", "bar_seq").collect():
        got.setdefault(r.fold_id, []).append(r)
    for r in sg.extract_trades(bars).orderBy("fold_id", "entry_seq").collect():
        trades.setdefault(r.fold_id, []).append((r.side, r.entry_seq - 500, r.exit_seq - 500, r.pnl))
    for s, (beta, pos, ra, rb) in series.items():
        ua, ub = 1 / (1 + abs(beta)), -beta / (1 + abs(beta))
        held = [0] + pos[:-1]
        gross = [h * ua * (a or 0) + h * ub * (b or 0) for h, a, b in zip(held, ra, rb)]
        before = [0] + held[:-1]
        turn = [abs(h * ua - q * ua) + abs(h * ub - q * ub) for h, q in zip(held, before)]
        cost = [t * rule.cost_per_side for t in turn]
        for i, r in enumerate(got[s]):
            assert math.isclose(r.gross_ret, gross[i], abs_tol=1e-12)
            assert math.isclose(r.turnover, turn[i], abs_tol=1e-12)
            assert math.isclose(r.net_ret, r.gross_ret - r.cost, abs_tol=1e-15)
        want = loop_trades(pos, gross, cost)
        assert len(want) == len(trades[s])
        for (a, b, c, d), (e, f, g, h) in zip(trades[s], want):
            assert (a, b, c) == (e, f, g) and math.isclose(d, h, abs_tol=1e-12)


def test_frozen_z_without_half_life(spark):
    df = spark.createDataFrame(
        [(0, "a", "b", 0, i, 2.0 + i, 1.0, 0.0, 1.0, 0.5, 0.25, None) for i in range(3)],
        "fold_id int, sym_a string, sym_b string, first_seq bigint, bar_seq bigint, close_a double, close_b double, "
        "alpha double, beta double, mu double, sigma double, half_life double")
    got = [r.z for r in sg.spread_zscores(df).orderBy("bar_seq").collect()]
    assert all(math.isclose(z, (math.log(2.0 + i) - 0.5) / 0.25) for i, z in enumerate(got))


def test_rolling_z_of_far_values_and_of_constant_ones(spark):
    """No digit is lost to an offset a million times the spread, and equal values have no z."""
    rule, rng = TradeRule(), random.Random(11)
    far = [1e6 + rng.gauss(0, 1) for _ in range(900)]
    flat = [0.1] * 300 + [0.3] * 600
    rows = [(s, "a", "b", 7, 7 + i, hl, v) for s, (hl, values) in enumerate([(150.0, far), (40.0, flat), (3.0, flat)])
            for i, v in enumerate(values)]
    df = spark.createDataFrame(
        rows, "fold_id int, sym_a string, sym_b string, first_seq bigint, bar_seq bigint, half_life double, spread double")
    got = {(r.fold_id, r.bar_seq - 7): r.z for r in sg.rolling_zscores(sg.with_blocks(df, rule), rule).collect()}
    for i in range(150, 900):
        seen = [Fraction(x) for x in far[max(0, i - 299):i + 1]]
        mean = sum(seen) / len(seen)
        deviation = math.sqrt(sum((x - mean) ** 2 for x in seen) / (len(seen) - 1))
        # The values themselves are known to 1e-10 of their spread; what is added on top stays within ten times that.
        assert abs(got[0, i] - float(Fraction(far[i]) - mean) / deviation) < 1e-8
    assert all(got[1, i] is None for i in (*range(300), *range(379, 900)))
    assert all(got[2, i] is None for i in (*range(300), *range(305, 900)))
    assert all(got[1, i] > 0 for i in range(300, 379))


def test_rolling_z_reads_no_frame_of_its_width(spark):
    df = spark.createDataFrame([(0, "a", "b", 0, 0, 3.0, 1.0)], "fold_id int, sym_a string, sym_b string, "
                               "first_seq bigint, bar_seq bigint, half_life double, spread double").repartition(4, *KEYS)
    plan = sg.rolling_zscores(sg.with_blocks(df, TradeRule()), TradeRule())._jdf.queryExecution().executedPlan().toString()
    frames = set(re.findall(r"specifiedwindowframe\((.*?)\)\)", plan))
    assert frames == {"RowFrame, unboundedpreceding$(), currentrow$("} | {f for f in frames if f.startswith("RowFrame, -1, -1")}
    assert plan.count("Exchange hashpartitioning") == 1


def test_windows_share_their_sorts(spark):
    """The chain over a pair runs on a single shuffle; its moments take two sorts, all else the time order."""
    df = spark.createDataFrame(
        [(0, "a", "b", 0, 0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 3.0)],
        "fold_id int, sym_a string, sym_b string, first_seq bigint, bar_seq bigint, close_a double, close_b double, "
        "ret_a double, ret_b double, alpha double, beta double, mu double, sigma double, half_life double")
    keyed = df.repartition(4, *KEYS)
    plan = sg.evaluate_pairs(keyed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 3
