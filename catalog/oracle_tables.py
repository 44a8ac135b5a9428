"""Named SQL tables that the checks are assembled from.

Each entry is one common table expression over the given tables. They restate the
operators in plain SQL on dense grids, with joins and row frames where the Spark
side uses packed arrays, so that the two sides share inputs but not methods.
"""

from __future__ import annotations

import re

from spreadloom.config import RunSettings

from .inputs import OPEN, EVENTS, SPAN_WEEKS, WEEKLY, WEEKLY_BASELINE

TABLES: dict[str, str] = {}


def define(name: str, body: str) -> None:
    TABLES[name] = body.strip()


def sql(body: str) -> str:
    """``body`` with the tables it mentions, directly or not, in front of it."""
    def mentioned(text: str) -> set[str]:
        return set(re.findall(r"\b[a-z]\w*\b", text)) & TABLES.keys()

    needed, frontier = set(), mentioned(body)
    while frontier:
        needed |= frontier
        frontier = set().union(*(mentioned(TABLES[n]) for n in frontier)) - needed
    parts = [f"{n} AS MATERIALIZED (\n{TABLES[n]}\n)" for n in TABLES if n in needed]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body.strip()


# ---- bars ---------------------------------------------------------------

define("wk", """
SELECT l_suppkey, date_trunc('week', l_shipdate)::TIMESTAMP AS week,
       avg(l_quantity) AS v, sum(l_quantity) AS qty, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
define("wk_dense", """
SELECT s.l_suppkey, g.week, qty, n,
       coalesce(k.v, last_value(k.v IGNORE NULLS) OVER (
           PARTITION BY s.l_suppkey ORDER BY g.week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 25.5) AS v
FROM (SELECT DISTINCT l_suppkey FROM wk) s
CROSS JOIN (SELECT unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS week FROM wk) g
LEFT JOIN wk k ON k.l_suppkey = s.l_suppkey AND k.week = g.week""")
define("wk_scaled", """
SELECT l_suppkey, week,
       sum(qty) OVER (PARTITION BY l_suppkey ORDER BY week ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS volume,
       sum(n) OVER (PARTITION BY l_suppkey ORDER BY week ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS lines,
       (v - avg(v) OVER (PARTITION BY l_suppkey))
         / nullif(stddev_pop(v) OVER (PARTITION BY l_suppkey), 0) AS x
FROM wk_dense""")
define("wk_own", f"""
SELECT *, avg(x) OVER (PARTITION BY l_suppkey ORDER BY week
                       ROWS BETWEEN {SPAN_WEEKS - 1} PRECEDING AND CURRENT ROW) AS own
FROM wk_scaled""")
define("wk_factor", """
SELECT week, sum(m / sd) OVER (ORDER BY week) AS factor
FROM (SELECT week, m, stddev_samp(m) OVER () AS sd
      FROM (SELECT week, avg(x) AS m FROM wk_own GROUP BY week))""")
define("w_bars", """
SELECT 'S' || lpad(l_suppkey::VARCHAR, 7, '0') AS symbol, week AS bar_ts,
       exp(4.0 + 0.02 * factor + 0.2 * own) AS close, volume::DOUBLE AS volume
FROM wk_own JOIN wk_factor USING (week) WHERE lines > 0""")
define("e_raw", """
SELECT event_type AS symbol, time_bucket(INTERVAL 30 MINUTE, ts) AS bar_ts, value + 1 AS close,
       (user_id + 1)::DOUBLE AS volume, event_id AS file_order
FROM events""")
define("e_bars", """
SELECT symbol, bar_ts, close, volume FROM e_raw
QUALIFY row_number() OVER (PARTITION BY symbol, bar_ts ORDER BY file_order DESC) = 1""")


# ---- panel, folds, universe, train rows ---------------------------------

def market(p: str, bars: str, s: RunSettings, liquid_first: bool = False, shared: str | None = None) -> None:
    """Tables <p>_grid, _panel, _folds, _cov, _uni, _train; ``shared`` reuses another panel."""
    f, e, c = s.folds, s.eligibility, s.clock
    if shared is None:
        define(f"{p}_grid", f"""
SELECT bar_ts, day, row_number() OVER (ORDER BY bar_ts) - 1 AS bar_seq,
       dense_rank() OVER (ORDER BY day) - 1 AS day_idx
FROM (SELECT DISTINCT bar_ts,
             ((bar_ts AT TIME ZONE 'UTC') AT TIME ZONE '{c.zone}')::DATE AS day FROM {bars})""")
        define(f"{p}_panel", f"""
SELECT b.symbol, b.bar_ts, g.day, g.day_idx, g.bar_seq, b.close, b.close * b.volume AS dollar_vol,
       CASE WHEN strftime((b.bar_ts AT TIME ZONE 'UTC') AT TIME ZONE '{c.zone}', '%H:%M') <> '{c.open_time}'
            THEN ln(b.close / q.close) END AS logret,
       ln(b.close / q.close) AS full_ret
FROM {bars} b JOIN {p}_grid g USING (bar_ts)
LEFT JOIN {p}_grid h ON h.bar_seq = g.bar_seq - 1
LEFT JOIN {bars} q ON q.symbol = b.symbol AND q.bar_ts = h.bar_ts""")
        define(f"{p}_days", f"SELECT day, day_idx, min(bar_seq) AS lo, max(bar_seq) AS hi FROM {p}_grid GROUP BY 1, 2")
        define(f"{p}_folds", f"""
SELECT k::INTEGER AS fold_id, a.day AS train_start, b.day AS train_end, c.day AS test_start, d.day AS test_end,
       a.lo AS train_lo, b.hi AS train_hi, c.lo AS test_lo, d.hi AS test_hi
FROM (SELECT unnest(generate_series(0, (max(day_idx) + 1 - {f.train_days + f.test_days}) // {f.roll_days})) AS k
      FROM {p}_days)
JOIN {p}_days a ON a.day_idx = k * {f.roll_days}
JOIN {p}_days b ON b.day_idx = k * {f.roll_days} + {f.train_days - 1}
JOIN {p}_days c ON c.day_idx = k * {f.roll_days} + {f.train_days}
JOIN {p}_days d ON d.day_idx = k * {f.roll_days} + {f.train_days + f.test_days - 1}""")
        define(f"{p}_cov", f"""
SELECT fold_id, symbol, count(close) * 1.0 / any_value(train_hi - train_lo + 1) AS coverage,
       median(dollar_vol) AS median_dv
FROM {p}_panel JOIN {p}_folds ON bar_seq BETWEEN train_lo AND train_hi GROUP BY 1, 2""")
    base = shared or p
    top = e.top_n_liquid or 10 ** 9
    if liquid_first:
        define(f"{p}_uni", f"""
SELECT fold_id, symbol, coverage, median_dv,
       row_number() OVER (PARTITION BY fold_id ORDER BY dv_rank) AS uni_rank,
       count(*) OVER (PARTITION BY fold_id) AS n_universe
FROM (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY median_dv DESC, symbol) AS dv_rank
      FROM {base}_cov) WHERE dv_rank <= {top} AND coverage >= {e.min_coverage}""")
    else:
        define(f"{p}_uni", f"""
SELECT fold_id, symbol, coverage, median_dv,
       CASE WHEN n > {top} THEN dv_rank ELSE name_rank END AS uni_rank, least(n, {top}) AS n_universe
FROM (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY median_dv DESC, symbol) AS dv_rank,
             row_number() OVER (PARTITION BY fold_id ORDER BY symbol) AS name_rank,
             count(*) OVER (PARTITION BY fold_id) AS n
      FROM {base}_cov WHERE coverage >= {e.min_coverage}) WHERE n <= {top} OR dv_rank <= {top}""")
    define(f"{p}_train", f"""
SELECT u.fold_id, u.symbol, u.uni_rank, g.bar_seq, x.close AS raw_close, x.logret AS ret,
       last_value(x.close IGNORE NULLS) OVER (PARTITION BY u.fold_id, u.symbol ORDER BY g.bar_seq
                                              ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS close
FROM {p}_uni u JOIN {base}_folds f USING (fold_id)
JOIN {base}_grid g ON g.bar_seq BETWEEN f.train_lo AND f.train_hi
LEFT JOIN {base}_panel x ON x.symbol = u.symbol AND x.bar_seq = g.bar_seq""")


def correlation(p: str, s: RunSettings) -> None:
    k = s.correlation
    define(f"{p}_corr", f"""
SELECT a.fold_id, a.symbol AS sym_a, b.symbol AS sym_b, a.uni_rank AS rank_a, b.uni_rank AS rank_b,
       corr(a.ret, b.ret) AS train_corr, count(*) AS n_obs
FROM {p}_train a JOIN {p}_train b ON a.fold_id = b.fold_id AND a.bar_seq = b.bar_seq AND a.uni_rank < b.uni_rank
WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL
GROUP BY ALL HAVING count(*) >= {k.min_overlap}""")
    define(f"{p}_cand", f"""
SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY train_corr DESC, rank_a, rank_b) AS cand_rank
FROM {p}_corr WHERE train_corr >= {k.min_corr}
QUALIFY cand_rank <= {k.top_k}""")


P_VALUE = """CASE WHEN bp_stat <= 0 THEN 1.0 ELSE 1 - 2 / sqrt(pi()) * exp(-bp_stat / 2) * list_sum(list_transform(
  range(160), lambda k: exp(2 * k * ln(2.0) + (2 * k + 1) * ln(sqrt(bp_stat / 2)) - lgamma(2 * k + 2.0) + lgamma(k + 1.0)))) END"""


def fits(p: str, candidates: str, train: str, s: RunSettings) -> None:
    """Tables <p>_legs, _ols, _fits, _ok for the pairs of ``candidates``."""
    e = s.eligibility
    define(f"{p}_legs", f"""
SELECT k.fold_id, k.sym_a, k.sym_b, a.bar_seq, ln(a.close) AS la, ln(b.close) AS lb
FROM {candidates} k JOIN {train} a ON a.fold_id = k.fold_id AND a.symbol = k.sym_a
JOIN {train} b ON b.fold_id = k.fold_id AND b.symbol = k.sym_b AND b.bar_seq = a.bar_seq
WHERE a.close IS NOT NULL AND b.close IS NOT NULL""")
    define(f"{p}_ols", f"""
SELECT fold_id, sym_a, sym_b, count(*) AS n_rows, regr_intercept(la, lb) AS alpha, regr_slope(la, lb) AS beta
FROM {p}_legs GROUP BY 1, 2, 3""")
    define(f"{p}_resid", f"""
SELECT fold_id, sym_a, sym_b, bar_seq, lb, alpha, beta, s, s * s AS s2,
       lag(s) OVER (PARTITION BY fold_id, sym_a, sym_b ORDER BY bar_seq) AS s_lag
FROM (SELECT *, la - (alpha + beta * lb) AS s FROM {p}_legs JOIN {p}_ols USING (fold_id, sym_a, sym_b))""")
    define(f"{p}_fit0", f"""
SELECT fold_id, sym_a, sym_b, count(*) AS n_rows, any_value(alpha) AS alpha, any_value(beta) AS beta,
       avg(s) AS mu, stddev_samp(s) AS sigma, regr_slope(s - s_lag, s_lag) AS b,
       CASE WHEN count(*) >= 60 THEN count(*) * regr_r2(s2, lb) END AS bp_stat
FROM {p}_resid GROUP BY 1, 2, 3""")
    define(f"{p}_fits", f"""
SELECT fold_id, sym_a, sym_b, n_rows, alpha, beta, mu, sigma, bp_stat,
       CASE WHEN n_rows >= 20 AND b < 0 AND b > -1 THEN -ln(2.0) / ln(1 + b) END AS half_life,
       {P_VALUE} AS bp_pval
FROM {p}_fit0 WHERE n_rows >= 20 AND beta <> 0 AND sigma > 0""")
    test = ">" if e.bp_strict else ">="
    define(f"{p}_ok", f"""
SELECT f.*, k.cand_rank FROM {p}_fits f JOIN {candidates} k USING (fold_id, sym_a, sym_b)
WHERE beta > 0 AND bp_pval {test} {e.bp_alpha} AND half_life BETWEEN {e.half_life_min} AND {e.half_life_max}
  AND sigma >= {e.min_spread_vol}""")


def chain(p: str, legs: str, s: RunSettings) -> None:
    """Table <p>_bars: z, position, returns and costs of the rows of ``legs``
    (pair, bar_seq, close_a/b, ret_a/b, alpha, beta, mu, sigma, half_life)."""
    r = s.rule
    w = "PARTITION BY fold_id, sym_a, sym_b ORDER BY bar_seq"
    needed = "width" if r.full_window else "greatest(width // 2, 5)"
    define(f"{p}_spread", f"""
SELECT *, ln(close_a) - (alpha + beta * ln(close_b)) AS spread,
       greatest(round_even(half_life * {r.window_per_half_life}, 0)::BIGINT, {r.window_floor}) AS width
FROM {legs}""")
    define(f"{p}_z", f"""
SELECT *, CASE WHEN half_life IS NULL THEN (spread - mu) / nullif(sigma, 0)
               WHEN count(spread) OVER f >= {needed}
               THEN (spread - avg(spread) OVER f) / nullif(stddev_samp(spread) OVER f, 0) END AS z
FROM {p}_spread WINDOW f AS ({w} ROWS BETWEEN width - 1 PRECEDING AND CURRENT ROW)""")
    define(f"{p}_class", f"""
SELECT *, CASE WHEN z IS NULL THEN 'R'
               WHEN abs(z) >= {r.z_entry} AND (abs(z) <= {r.z_exit} OR abs(z) >= {r.z_stop}) THEN 'T'
               WHEN abs(z) >= {r.z_entry} THEN 'E'
               WHEN abs(z) <= {r.z_exit} OR abs(z) >= {r.z_stop} THEN 'R' ELSE 'H' END AS cls
FROM {p}_z""")
    define(f"{p}_group", f"""
SELECT *, sum(CASE WHEN cls IN ('R', 'E') THEN 1 ELSE 0 END) OVER ({w}) AS g FROM {p}_class""")
    define(f"{p}_on", f"""
SELECT *, ((CASE WHEN first_value(cls) OVER k = 'E' THEN 1 ELSE 0 END)
          + sum(CASE WHEN cls = 'T' THEN 1 ELSE 0 END) OVER k) % 2 AS on_
FROM {p}_group WINDOW k AS (PARTITION BY fold_id, sym_a, sym_b, g ORDER BY bar_seq)""")
    define(f"{p}_side", f"""
SELECT *, CASE WHEN on_ = 1 AND coalesce(lag(on_) OVER ({w}), 0) = 0 THEN -sign(z) END AS entry FROM {p}_on""")
    define(f"{p}_pos", f"""
SELECT *, CASE WHEN on_ = 1 THEN last_value(entry IGNORE NULLS) OVER ({w}) ELSE 0 END::INTEGER AS position
FROM {p}_side""")
    define(f"{p}_w", f"""
SELECT *, coalesce(lag(position) OVER ({w}), 0) / (1 + abs(beta)) AS w_a,
       -beta * coalesce(lag(position) OVER ({w}), 0) / (1 + abs(beta)) AS w_b
FROM {p}_pos""")
    define(f"{p}_bars", f"""
SELECT *, turnover * {r.cost_per_side} AS cost, gross_ret - turnover * {r.cost_per_side} AS net_ret
FROM (SELECT *, w_a * coalesce(ret_a, 0) + w_b * coalesce(ret_b, 0) AS gross_ret,
             abs(w_a - coalesce(lag(w_a) OVER ({w}), 0)) + abs(w_b - coalesce(lag(w_b) OVER ({w}), 0)) AS turnover
      FROM {p}_w)""")


def sharpe(column: str, bars_per_year: int) -> str:
    return (f"CASE WHEN count({column}) < 2 OR stddev_samp({column}) = 0 THEN 0.0 "
            f"ELSE avg({column}) / stddev_samp({column}) * sqrt({bars_per_year}) END")


def bundle(keys: str, src: str, bars_per_year: int) -> str:
    """Metrics per ``keys`` of a table with ret, turnover and dd."""
    return f"""SELECT {keys}, {sharpe('ret', bars_per_year)} AS sharpe_annualized,
       product(1 + ret) - 1 AS return_total,
       CASE WHEN product(1 + ret) <= 0 THEN -1.0 ELSE pow(product(1 + ret), {bars_per_year}.0 / count(*)) - 1 END AS return_annualized,
       min(dd) AS max_drawdown,
       coalesce(avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret < 0 THEN 0.0 END), 0.0) AS hit_rate_bars,
       count(*) AS n_bars, avg(turnover) * {bars_per_year} AS turnover_annualized, avg(turnover) AS turnover_per_bar
FROM {src} GROUP BY {keys}"""


TRADE_STATS = """count(*) AS n_trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS trade_win_rate,
       avg(holding_bars) AS avg_holding_bars, avg(pnl) AS avg_trade_pnl"""


def trading(p: str, arm: str, base: str, s: RunSettings) -> None:
    """Test side of an arm from <p>_pairs: _bars, _port, _trades, _fm, _oos, _agg."""
    bpy = s.clock.bars_per_year
    define(f"{p}_t_legs", f"""
SELECT k.*, g.bar_seq, a.logret AS ret_a, b.logret AS ret_b,
       last_value(a.close IGNORE NULLS) OVER fill AS close_a, last_value(b.close IGNORE NULLS) OVER fill AS close_b
FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY fold_id) AS weight FROM {p}_pairs) k
JOIN {base}_folds f USING (fold_id)
JOIN {base}_grid g ON g.bar_seq BETWEEN f.test_lo AND f.test_hi
LEFT JOIN {base}_panel a ON a.symbol = k.sym_a AND a.bar_seq = g.bar_seq
LEFT JOIN {base}_panel b ON b.symbol = k.sym_b AND b.bar_seq = g.bar_seq
WINDOW fill AS (PARTITION BY k.fold_id, sym_a, sym_b ORDER BY g.bar_seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
    chain(f"{p}_t", f"{p}_t_legs", s)
    define(f"{p}_port", f"""
SELECT f.fold_id, g.bar_seq, coalesce(sum(net_ret * weight), 0) AS ret, coalesce(sum(turnover * weight), 0) AS turnover
FROM {base}_folds f JOIN {base}_grid g ON g.bar_seq BETWEEN f.test_lo AND f.test_hi
LEFT JOIN {p}_t_bars b ON b.fold_id = f.fold_id AND b.bar_seq = g.bar_seq GROUP BY 1, 2""")
    define(f"{p}_runs", f"""
SELECT *, sum(CASE WHEN position <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY fold_id, sym_a, sym_b ORDER BY bar_seq) AS run
FROM (SELECT *, coalesce(lag(position) OVER (PARTITION BY fold_id, sym_a, sym_b ORDER BY bar_seq), 0) AS prev FROM {p}_t_bars)""")
    define(f"{p}_spans", f"""
SELECT fold_id, sym_a, sym_b, any_value(position) AS side, any_value(weight) AS weight, min(bar_seq) AS entry_seq,
       least(max(bar_seq) + 1, any_value(test_hi)) AS exit_seq
FROM {p}_runs JOIN {base}_folds USING (fold_id) WHERE position <> 0 GROUP BY fold_id, sym_a, sym_b, run""")
    define(f"{p}_trades", f"""
SELECT '{arm}' AS arm, t.fold_id, t.sym_a, t.sym_b, t.side, x.bar_ts AS entry_ts, y.bar_ts AS exit_ts,
       t.exit_seq - t.entry_seq AS holding_bars, t.weight,
       sum(CASE WHEN b.bar_seq > t.entry_seq THEN b.gross_ret ELSE 0 END) - sum(b.cost) AS pnl
FROM {p}_spans t JOIN {p}_t_bars b ON b.fold_id = t.fold_id AND b.sym_a = t.sym_a AND b.sym_b = t.sym_b
     AND b.bar_seq BETWEEN t.entry_seq AND t.exit_seq
JOIN {base}_grid x ON x.bar_seq = t.entry_seq JOIN {base}_grid y ON y.bar_seq = t.exit_seq
GROUP BY ALL""")
    define(f"{p}_fold_eq", f"""
SELECT *, eq / max(eq) OVER (PARTITION BY fold_id ORDER BY bar_seq) - 1 AS dd
FROM (SELECT *, product(1 + ret) OVER (PARTITION BY fold_id ORDER BY bar_seq) AS eq FROM {p}_port)""")
    define(f"{p}_active", f"""
SELECT f.fold_id, count(k.sym_a)::DOUBLE AS n_active_pairs
FROM {base}_folds f LEFT JOIN {p}_pairs k USING (fold_id) GROUP BY 1""")
    define(f"{p}_fm0", bundle("fold_id", f"{p}_fold_eq", bpy))
    define(f"{p}_ts", f"SELECT fold_id, {TRADE_STATS} FROM {p}_trades GROUP BY 1")
    define(f"{p}_fm", f"""
SELECT '{arm}' AS arm, m.*, train_start, train_end, test_start, test_end,
       n_trades, trade_win_rate, avg_holding_bars, avg_trade_pnl, n_active_pairs
FROM {p}_fm0 m JOIN {base}_folds USING (fold_id) LEFT JOIN {p}_ts USING (fold_id) JOIN {p}_active USING (fold_id)""")
    define(f"{p}_oos", f"""
SELECT *, eq / max(eq) OVER (ORDER BY bar_seq) - 1 AS dd, max(eq) OVER (ORDER BY bar_seq) AS peak
FROM (SELECT '{arm}' AS arm, fold_id, bar_seq, bar_ts, ret, turnover, product(1 + ret) OVER (ORDER BY bar_seq) AS eq
      FROM (SELECT * FROM {p}_port QUALIFY row_number() OVER (PARTITION BY bar_seq ORDER BY fold_id) = 1)
      JOIN {base}_grid USING (bar_seq))""")
    define(f"{p}_agg0", bundle("arm", f"{p}_oos", bpy))
    define(f"{p}_agg", f"""
SELECT m.*, n_trades, trade_win_rate, avg_holding_bars, avg_trade_pnl, n_active_pairs
FROM {p}_agg0 m LEFT JOIN (SELECT '{arm}' AS arm, {TRADE_STATS} FROM {p}_trades) USING (arm)
CROSS JOIN (SELECT avg(n_active_pairs) AS n_active_pairs FROM {p}_active)""")


def in_sample(p: str, train: str, s: RunSettings) -> None:
    """Tables <p>_scored and, capped, <p>_pairs from <p>_ok."""
    e = s.eligibility
    if e.rank_by == "half_life":
        define(f"{p}_pairs", f"""
SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY half_life, cand_rank) AS rank
FROM {p}_ok QUALIFY rank <= {e.max_pairs}""")
        return
    define(f"{p}_i_legs", f"""
SELECT k.*, a.bar_seq, a.close AS close_a, b.close AS close_b, a.ret AS ret_a, b.ret AS ret_b
FROM {p}_ok k JOIN {train} a ON a.fold_id = k.fold_id AND a.symbol = k.sym_a
JOIN {train} b ON b.fold_id = k.fold_id AND b.symbol = k.sym_b AND b.bar_seq = a.bar_seq""")
    chain(f"{p}_i", f"{p}_i_legs", s)
    define(f"{p}_scored", f"""
SELECT k.*, x.train_sharpe FROM {p}_ok k JOIN (
  SELECT fold_id, sym_a, sym_b, {sharpe('net_ret', s.clock.bars_per_year)} AS train_sharpe
  FROM {p}_i_bars GROUP BY 1, 2, 3) x USING (fold_id, sym_a, sym_b)""")
    define(f"{p}_pairs", f"""
SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY train_sharpe DESC, cand_rank) AS rank
FROM {p}_scored QUALIFY rank <= {e.max_pairs}""")


market("w", "w_bars", WEEKLY)
market("o", "w_bars", OPEN, shared="w")
market("e", "e_bars", EVENTS)
market("b", "w_bars", WEEKLY_BASELINE, liquid_first=True, shared="w")

correlation("w", WEEKLY)
fits("c", "w_cand", "w_train", WEEKLY)
in_sample("c", "w_train", WEEKLY)
trading("c", "classic", "w", WEEKLY)

correlation("o", OPEN)
fits("oc", "o_cand", "o_train", OPEN)

correlation("b", WEEKLY_BASELINE)
fits("h", "b_cand", "b_train", WEEKLY_BASELINE)
in_sample("h", "b_train", WEEKLY_BASELINE)
trading("h", "baseline", "w", WEEKLY_BASELINE)

# ---- an arm on given vectors: the mean tumbling window of each symbol ----
def windows(p: str) -> None:
    """Tables <p>_pos, _windows, _mean and _vec of <p>_train."""
    spec = WEEKLY.autoencoder
    define(f"{p}_pos", f"""
SELECT fold_id, symbol, ret, bar_seq - min(bar_seq) OVER (PARTITION BY fold_id, symbol) AS pos,
       count(*) OVER (PARTITION BY fold_id, symbol) AS n FROM {p}_train""")
    define(f"{p}_windows", f"""
SELECT fold_id, symbol, (pos // {spec.seq_len})::INTEGER AS window_id,
       list(coalesce(ret, 0.0) ORDER BY pos) AS x
FROM {p}_pos WHERE pos < n // {spec.seq_len} * {spec.seq_len}
GROUP BY 1, 2, 3 HAVING count(ret) * 1.0 / {spec.seq_len} >= {spec.min_valid_share}""")
    define(f"{p}_mean", f"""
SELECT fold_id, symbol, i, avg(v) AS v, count(*) AS n
FROM (SELECT fold_id, symbol, unnest(x) AS v, unnest(range(12)) AS i FROM {p}_windows) GROUP BY 1, 2, 3""")
    define(f"{p}_vec", f"""
SELECT fold_id, symbol, i, v / sqrt(sum(v * v) OVER (PARTITION BY fold_id, symbol)) AS v
FROM {p}_mean WHERE n >= {spec.min_windows}""")


def neighbours(p: str, vectors: str) -> None:
    """Tables <p>_dist, _near and _cand of the symbol vectors."""
    search = WEEKLY.autoencoder.neighbours
    define(f"{p}_dist", f"""
SELECT a.fold_id, a.symbol, b.symbol AS neighbour, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS distance
FROM {vectors} a JOIN {vectors} b ON a.fold_id = b.fold_id AND a.i = b.i AND a.symbol <> b.symbol GROUP BY 1, 2, 3""")
    define(f"{p}_near", f"""
SELECT * FROM {p}_dist QUALIFY row_number() OVER (PARTITION BY fold_id, symbol ORDER BY distance, neighbour)
  <= {search.k}""")
    define(f"{p}_cand", f"""
SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY emb_distance, sym_a, sym_b) AS cand_rank
FROM (SELECT fold_id, least(symbol, neighbour) AS sym_a, greatest(symbol, neighbour) AS sym_b,
             min(distance) AS emb_distance FROM {p}_near GROUP BY 1, 2, 3)
QUALIFY cand_rank <= {search.cap}""")


def autoregression(p: str, lags: int, cutoff: float, margin: int) -> None:
    """Tables <p>_lag_products and _ar_fits of <p>_train; the normal equations are solved by a recursive query."""
    values = ["ret AS l0", *[f"lag(ret, {i}) OVER t AS l{i}" for i in range(1, lags + 1)]]
    rows = ", ".join("[" + ", ".join(f"sum(l{i} * l{j})" for j in range(lags + 1)) + "]" for i in range(lags + 1))
    define(f"{p}_lag_products", f"""
SELECT fold_id, symbol, count(*) AS n, [{rows}] AS p
FROM (SELECT fold_id, symbol, {", ".join(values)} FROM {p}_train WHERE ret IS NOT NULL
      WINDOW t AS (PARTITION BY fold_id, symbol ORDER BY bar_seq))
WHERE l{lags} IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {margin}""")
    define(f"{p}_ar_fits", f"""
SELECT fold_id, symbol, coefs,
       greatest(list_max(list_transform(range(1, {lags + 1}), lambda i: CASE WHEN abs(coefs[i]) >= {cutoff} THEN i ELSE 0 END)), 1) AS lookback
FROM (WITH RECURSIVE steps AS (
        SELECT fold_id, symbol, 1 AS k, list_transform(p[2:], lambda row: row[2:] || row[1:1]) AS m FROM {p}_lag_products
        UNION ALL
        SELECT fold_id, symbol, k + 1,
               list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda v: v / m[k][k])
                   ELSE list_transform(row, lambda v, j: v - row[k] / m[k][k] * m[k][j]) END)
        FROM steps WHERE k <= {lags})
      SELECT fold_id, symbol, list_transform(m, lambda row: row[{lags + 1}]) AS coefs FROM steps WHERE k = {lags + 1})""")


windows("w")
windows("o")
autoregression("o", WEEKLY.gru.max_lags, WEEKLY.gru.ar_cutoff, WEEKLY.gru.ar_margin)
neighbours("v", "w_vec")
neighbours("ov", "o_vec")
fits("v", "v_cand", "w_train", WEEKLY)
in_sample("v", "w_train", WEEKLY)
trading("v", "window_mean", "w", WEEKLY)
