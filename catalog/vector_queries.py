"""Neighbours, training windows, autoregression and the network arms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from spreadloom.config import AutoencoderSpec, GruSpec, NeighbourSearch, TrainerSpec
from spreadloom.operators import autoregression as ar, neighbours as nb, windows as wn
from spreadloom.operators.training import encode_windows, gradient_sums, pack_blocks
from spreadloom.plans import selection as sl

from . import inputs as I
from .pair_queries import FITS, FOLD_METRICS, METRICS
from .registry import query

NEAR = """
SELECT a.label AS fold_id, 'V' || lpad(a.vec_id::VARCHAR, 7, '0') AS symbol,
       'V' || lpad(b.vec_id::VARCHAR, 7, '0') AS neighbour,
       list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
QUALIFY row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY distance, neighbour) <= 8"""


@query("fold_id:i symbol neighbour distance:d", NEAR)
def nearest_vectors(spark, sf_dir):
    return nb.nearest_neighbours(I.labelled_vectors(spark, sf_dir), 8, tile=16)


@query("fold_id:i sym_a sym_b emb_distance:d cand_rank:i", f"""
SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY emb_distance, sym_a, sym_b) AS cand_rank FROM (
  SELECT fold_id, least(symbol, neighbour) AS sym_a, greatest(symbol, neighbour) AS sym_b,
         min(distance) AS emb_distance FROM ({NEAR}) GROUP BY 1, 2, 3)
QUALIFY cand_rank <= 300""")
def neighbour_candidates(spark, sf_dir):
    return nb.neighbour_pairs(I.labelled_vectors(spark, sf_dir), NeighbourSearch(8, 300))


@query("fold_id:i sym_a sym_b emb_distance:d cand_rank:i", "SELECT * FROM ov_cand")
def window_mean_candidates(spark, sf_dir):
    return nb.neighbour_pairs(I.window_vectors(I.open_weekly_market(spark, sf_dir)), I.WEEKLY.autoencoder.neighbours)


@query(f"{FITS.replace('n_rows:i ', '')} cand_rank:i train_sharpe:d rank:i", "SELECT * FROM v_pairs")
def vector_pairs(spark, sf_dir):
    return I.vector_arm(spark, sf_dir).pairs


def _windows(spark, sf_dir):
    return wn.tumbling_windows(I.open_weekly_market(spark, sf_dir).train.series, I.WEEKLY.autoencoder)


@query("fold_id:i symbol window_id:i i:i v:d",
       "SELECT fold_id, symbol, window_id, unnest(range(12)) AS i, unnest(x) AS v FROM o_windows")
def tumbling_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select(
        "fold_id", "symbol", "window_id", F.posexplode("x").alias("i", "v"))


INTRADAY_GRID = """
SELECT s.fold_id, s.symbol, g.bar_seq - s.train_lo AS pos, s.train_hi - s.train_lo + 1 AS n, p.logret AS ret
FROM (SELECT DISTINCT fold_id, symbol, train_lo, train_hi FROM e_panel JOIN e_folds
      ON bar_seq BETWEEN train_lo AND train_hi) s
JOIN e_grid g ON g.bar_seq BETWEEN s.train_lo AND s.train_hi
LEFT JOIN e_panel p ON p.symbol = s.symbol AND p.bar_seq = g.bar_seq"""


@query("fold_id:i symbol window_id:i i:i v:d", f"""
SELECT fold_id, symbol, window_id, unnest(range(12)) AS i, unnest(x) AS v FROM (
  SELECT fold_id, symbol, pos // 12 AS window_id, list(coalesce(ret, 0.0) ORDER BY pos) AS x
  FROM ({INTRADAY_GRID}) WHERE pos < n // 12 * 12 GROUP BY 1, 2, 3 HAVING count(ret) >= 6)""")
def intraday_tumbling_windows(spark, sf_dir):
    series = I.event_market(spark, sf_dir).train.series
    return wn.tumbling_windows(series, AutoencoderSpec()).select(
        "fold_id", "symbol", "window_id", F.posexplode("x").alias("i", "v"))


def _given_lookbacks(spark, sf_dir):
    """A lookback from 1 to 15 by place in the universe."""
    return I.open_weekly_market(spark, sf_dir).universe.select(
        "fold_id", "symbol", (F.col("uni_rank") % 15 + 1).cast("int").alias("lookback"))


@query("fold_id:i symbol bar_pos:i width:i n_zeros:i weighed:d target:d", """
SELECT t.fold_id, t.symbol, t.pos AS bar_pos, 15 AS width, any_value(t.ret) AS target,
       15 - count(*) + count(*) FILTER (WHERE h.ret = 0) AS n_zeros,
       sum(h.ret * (16 - (t.pos - h.pos))) AS weighed
FROM o_pos t JOIN o_uni u USING (fold_id, symbol)
JOIN o_pos h ON h.fold_id = t.fold_id AND h.symbol = t.symbol
     AND h.pos BETWEEN t.pos - (u.uni_rank % 15 + 1) AND t.pos - 1
GROUP BY 1, 2, 3, u.uni_rank HAVING count(h.ret) = u.uni_rank % 15 + 1""")
def sliding_windows(spark, sf_dir):
    # One row per window: its width, its zeros, and its values weighed by place.
    series = I.open_weekly_market(spark, sf_dir).train.series
    rows = wn.sliding_windows(series, _given_lookbacks(spark, sf_dir), GruSpec())
    weighed = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.select(
        "fold_id", "symbol", "bar_pos", "target", F.size("x").alias("width"),
        F.size(F.filter("x", lambda v: v == 0)).alias("n_zeros"), weighed.alias("weighed"))


LAGS = " ".join(f"lag_{i}:d" for i in range(1, 16))


@query(f"fold_id:i symbol bar_seq:i r:d {LAGS}", f"""
SELECT * FROM (SELECT fold_id, symbol, bar_seq, ret AS r,
  {", ".join(f"lag(ret, {i}) OVER t AS lag_{i}" for i in range(1, 16))}
FROM o_train WHERE ret IS NOT NULL WINDOW t AS (PARTITION BY fold_id, symbol ORDER BY bar_seq)) WHERE lag_15 IS NOT NULL""")
def lag_matrix(spark, sf_dir):
    return ar.lag_matrix(I.open_weekly_market(spark, sf_dir).train.series, 15)


@query("fold_id:i scale_mean:d scale_std:d n_values:i", """
SELECT fold_id, avg(v) AS scale_mean, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1.0 END AS scale_std,
       count(*) AS n_values
FROM (SELECT fold_id, unnest(x) AS v FROM o_windows) GROUP BY 1""")
def window_scale(spark, sf_dir):
    return wn.window_scale(_windows(spark, sf_dir))


@query("fold_id:i symbol window_id:i i:i v:d", """
SELECT fold_id, symbol, window_id, i, (v - avg(v) OVER f) / CASE WHEN stddev_pop(v) OVER f > 0 THEN stddev_pop(v) OVER f ELSE 1 END AS v
FROM (SELECT fold_id, symbol, window_id, unnest(range(12)) AS i, unnest(x) AS v FROM o_windows)
WINDOW f AS (PARTITION BY fold_id)""")
def standardized_windows(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    return wn.standardize(windows, wn.window_scale(windows)).select(
        "fold_id", "symbol", "window_id", F.posexplode("x").alias("i", "v"))


@query("fold_id:i symbol i:i v:d", "SELECT fold_id, symbol, i, v FROM o_vec")
def pooled_codes(spark, sf_dir):
    return I.window_vectors(I.open_weekly_market(spark, sf_dir)).select("fold_id", "symbol", F.posexplode("embedding").alias("i", "v"))


@query("fold_id:i symbol i:i v:d", """
SELECT fold_id, symbol, i, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY fold_id, symbol)), 0) AS v FROM (
  SELECT fold_id, symbol, i, avg(v / CASE WHEN norm > 0 THEN norm ELSE 1 END) AS v FROM (
    SELECT fold_id, symbol, unnest(range(12)) AS i, unnest(x) AS v,
           sqrt(list_sum(list_transform(x, lambda y: y * y))) AS norm FROM o_windows)
  GROUP BY 1, 2, 3 HAVING count(*) >= 5)""")
def pooled_unit_codes(spark, sf_dir):
    codes = _windows(spark, sf_dir).withColumnRenamed("x", "code")
    return wn.pool_codes(codes, 5, unit_rows=True).select(
        "fold_id", "symbol", F.posexplode("embedding").alias("i", "v"))


@query("fold_id:i symbol window_id:i", """
SELECT fold_id, symbol, window_id FROM (SELECT *, count(*) OVER (PARTITION BY fold_id) AS n FROM o_windows) WHERE n >= 450""")
def folds_with_enough_windows(spark, sf_dir):
    return wn.enough(_windows(spark, sf_dir), 450)


@query("fold_id:i symbol n:i i:i j:i p:d", """
SELECT fold_id, symbol, n, i, unnest(range(i, 16)) AS j, unnest(row[i + 1:]) AS p
FROM (SELECT fold_id, symbol, n, unnest(range(16)) AS i, unnest(p) AS row FROM o_lag_products)""")
def lag_products(spark, sf_dir):
    rows = ar.lag_products(I.open_weekly_market(spark, sf_dir).train.series, I.WEEKLY.gru)
    # The outer form asks for no filter on the sizes, which would compute all sums twice more.
    return (rows.select("fold_id", "symbol", "n", F.posexplode_outer("products").alias("i", "row"))
            .select("fold_id", "symbol", "n", "i", F.posexplode_outer("row").alias("j", "p")).filter("j >= i"))


@query("fold_id:i symbol lag:i coef:d lookback:i", """
SELECT fold_id, symbol, unnest([0, 1]) AS lag, unnest([c1, c2]) AS coef, CASE WHEN abs(c2) >= 0.1 THEN 2 ELSE 1 END AS lookback
FROM (SELECT fold_id, symbol, (p01 * p22 - p02 * p12) / (p11 * p22 - p12 * p12) AS c1,
             (p02 * p11 - p01 * p12) / (p11 * p22 - p12 * p12) AS c2
      FROM (SELECT fold_id, symbol, sum(r * l1) AS p01, sum(r * l2) AS p02, sum(l1 * l1) AS p11, sum(l1 * l2) AS p12, sum(l2 * l2) AS p22
            FROM (SELECT fold_id, symbol, ret AS r, lag(ret, 1) OVER t AS l1, lag(ret, 2) OVER t AS l2
                  FROM o_train WHERE ret IS NOT NULL WINDOW t AS (PARTITION BY fold_id, symbol ORDER BY bar_seq))
            WHERE l2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30))""")
def ar_fits_of_two_lags(spark, sf_dir):
    """The same solver on a size that has a closed form."""
    # Written first: a filter on the fits of a plan would compute them all again.
    fits = I.stage(ar.ar_fits(I.open_weekly_market(spark, sf_dir).train.series, I.SHORT_AR), "short-fits")
    return fits.filter("coefs IS NOT NULL").select("fold_id", "symbol", "lookback", F.posexplode("coefs").alias("lag", "coef"))


@query("fold_id:i symbol lag:i coef:d lookback:i",
       "SELECT fold_id, symbol, unnest(range(15)) AS lag, unnest(coefs) AS coef, lookback FROM o_ar_fits")
def ar_fits(spark, sf_dir):
    return I.fitted_lags(spark, sf_dir).filter("coefs IS NOT NULL").select(
        "fold_id", "symbol", "lookback", F.posexplode("coefs").alias("lag", "coef"))


@query("fold_id:i symbol lag:i left_over:d", """
SELECT fold_id, symbol, unnest(range(1, 16)) AS lag, 0.0 AS left_over FROM o_lag_products""")
def ar_normal_equations(spark, sf_dir):
    """What the normal equations leave over at the fitted coefficients, as a share of the lag's own sum: nothing."""
    fits = I.fitted_lags(spark, sf_dir).filter("coefs IS NOT NULL")
    sums = ar.lag_products(I.open_weekly_market(spark, sf_dir).train.series, I.WEEKLY.gru)
    rows = fits.join(sums, ["fold_id", "symbol"]).select("fold_id", "symbol", "coefs", F.posexplode_outer("products").alias("lag", "row"))
    told = F.aggregate(F.zip_with(F.slice("row", 2, 15), "coefs", lambda p, c: p * c), F.lit(0.0), lambda total, v: total + v)
    return rows.filter("lag > 0").select(
        "fold_id", "symbol", "lag", ((F.get("row", F.lit(0)) - told) / F.get("row", F.col("lag"))).alias("left_over"))


@query("fold_id:i symbol lookback:i", """
SELECT fold_id, symbol, coalesce(lookback, 5) AS lookback FROM o_uni LEFT JOIN o_ar_fits USING (fold_id, symbol)""")
def effective_lookbacks(spark, sf_dir):
    return ar.lookbacks(I.fitted_lags(spark, sf_dir))


@query("fold_id:i n_symbols:i avg_lookback:d median_lookback:d", """
SELECT fold_id, count(*) AS n_symbols, avg(lookback) AS avg_lookback, median(lookback) AS median_lookback
FROM o_ar_fits GROUP BY 1""")
def lookback_summary(spark, sf_dir):
    return ar.lookback_summary(I.fitted_lags(spark, sf_dir))


@query("lookback:i n_symbols:i", "SELECT lookback, count(*) AS n_symbols FROM o_ar_fits GROUP BY 1")
def lookback_histogram(spark, sf_dir):
    return ar.lookback_histogram(I.fitted_lags(spark, sf_dir))


@query("pooled_mean:d suggested_lookback:i", """
SELECT avg(lookback) AS pooled_mean, round_even(avg(lookback), 0) AS suggested_lookback FROM o_ar_fits""")
def suggested_lookback(spark, sf_dir):
    return ar.suggested_lookback(I.fitted_lags(spark, sf_dir))


@query("fold_id:i lag:i avg_coef:d", """
SELECT fold_id, lag, avg(coef) AS avg_coef
FROM (SELECT fold_id, unnest(range(1, 16)) AS lag, unnest(coefs) AS coef FROM o_ar_fits) GROUP BY 1, 2""")
def mean_ar_coefficients(spark, sf_dir):
    return ar.mean_coefficients(I.fitted_lags(spark, sf_dir))


# Encoders with given weights: the forward pass in SQL. Weight k is ((37 k) mod 64 - 32) / 64.

def _w(k: str) -> str:
    return f"((37 * ({k})) % 64 - 32) / 64.0"


def _given_weights(spark, sf_dir, net):
    size = sum(math.prod(shape) for shape, _ in net.shapes())
    values = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: ((k * 37 % 64 - 32) / 64).cast("float"))
    return I.open_weekly_market(spark, sf_dir).folds.select("fold_id", values.alias("weights"))


def _code_sums(codes):
    return codes.groupBy("fold_id", "symbol").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("code")[e]).alias(f"code_{e}") for e in (0, 1)])


@query("fold_id:i symbol n:i code_0:d code_1:d", f"""
SELECT fold_id, symbol, count(*) AS n, {", ".join(f"sum({' + '.join(f'h{j} * {_w(39 + 2 * j + e)}' for j in range(3))} + {_w(45 + e)}) AS code_{e}" for e in (0, 1))}
FROM (SELECT fold_id, symbol, {", ".join(f"tanh({_w(36 + j)} + list_sum(list_transform(range(12), lambda i: x[i + 1] * ({_w(f'3 * i + {j}')})))) AS h{j}" for j in range(3))}
      FROM o_windows) GROUP BY 1, 2""")
def autoencoder_codes(spark, sf_dir):
    net = sl.Autoencoder(AutoencoderSpec(hidden=3, emb_dim=2))
    return _code_sums(encode_windows(_windows(spark, sf_dir), _given_weights(spark, sf_dir, net), net))


# The chain rule for the same network, with 3 hidden values and codes of 2; slope k belongs to weight k.

def _plus(terms) -> str:
    return " + ".join(terms)


_HIDDEN, _CODE, _AT = range(3), range(2), range(12)
_FORWARD_1 = ", ".join(f"tanh({_w(36 + j)} + {_plus(f'x[{i + 1}] * ({_w(3 * i + j)})' for i in _AT)}) AS h{j}" for j in _HIDDEN)
_FORWARD_2 = ", ".join(f"{_w(45 + e)} + {_plus(f'h{j} * ({_w(39 + 2 * j + e)})' for j in _HIDDEN)} AS c{e}" for e in _CODE)
_FORWARD_3 = ", ".join(f"tanh({_w(53 + j)} + {_plus(f'c{e} * ({_w(47 + 3 * e + j)})' for e in _CODE)}) AS k{j}" for j in _HIDDEN)
_BACK_1 = ", ".join(f"2.0 * ({_w(92 + i)} + {_plus(f'k{j} * ({_w(56 + 12 * j + i)})' for j in _HIDDEN)} - x[{i + 1}]) / 12 AS o{i}" for i in _AT)
_BACK_2 = ", ".join(f"({_plus(f'o{i} * ({_w(56 + 12 * j + i)})' for i in _AT)}) * (1 - k{j} * k{j}) AS dk{j}" for j in _HIDDEN)
_BACK_3 = ", ".join(f"{_plus(f'dk{j} * ({_w(47 + 3 * e + j)})' for j in _HIDDEN)} AS dc{e}" for e in _CODE)
_BACK_4 = ", ".join(f"({_plus(f'dc{e} * ({_w(39 + 2 * j + e)})' for e in _CODE)}) * (1 - h{j} * h{j}) AS dh{j}" for j in _HIDDEN)
_SLOPES = ", ".join(f"avg({v})" for v in [
    *[f"x[{i + 1}] * dh{j}" for i in _AT for j in _HIDDEN], *[f"dh{j}" for j in _HIDDEN],
    *[f"h{j} * dc{e}" for j in _HIDDEN for e in _CODE], *[f"dc{e}" for e in _CODE],
    *[f"c{e} * dk{j}" for e in _CODE for j in _HIDDEN], *[f"dk{j}" for j in _HIDDEN],
    *[f"k{j} * o{i}" for j in _HIDDEN for i in _AT], *[f"o{i}" for i in _AT]])


@query("fold_id:i weight:i slope:d", f"""
SELECT fold_id, unnest(range(104)) AS weight, unnest([{_SLOPES}]) AS slope
FROM (SELECT *, {_BACK_4} FROM (SELECT *, {_BACK_3} FROM (SELECT *, {_BACK_2} FROM (SELECT *, {_BACK_1} FROM (
      SELECT *, {_FORWARD_3} FROM (SELECT *, {_FORWARD_2} FROM (SELECT fold_id, x, {_FORWARD_1} FROM o_windows))))))) GROUP BY fold_id""")
def autoencoder_gradient(spark, sf_dir):
    """The gradient that one training step sums over all blocks, at given weights."""
    net = sl.Autoencoder(AutoencoderSpec(hidden=3, emb_dim=2))
    samples = _windows(spark, sf_dir).select(
        "fold_id", "symbol", F.col("window_id").alias("sample_id"), "x", F.lit(0.0).alias("target"))
    spec = TrainerSpec(validation_share=0.0, most_batches=1, block_samples=256)
    weights = {r.fold_id: np.array([(k * 37 % 64 - 32) / 64 for k in range(104)])
               for r in I.open_weekly_market(spark, sf_dir).folds.select("fold_id").collect()}
    sums = gradient_sums(pack_blocks(samples, spec, "float64").rdd, net, weights, "float64")
    rows = [(f, (s.gradient / s.n_fit).tolist()) for f, s in sums.items()]
    return spark.createDataFrame(rows, "fold_id int, slopes array<double>").select(
        "fold_id", F.posexplode("slopes").alias("weight", "slope"))


def _gate(k: int, x: str = "s.x") -> tuple[str, str]:
    return (f"({x} * ({_w(k)}) + {_w(18 + k)})",
            f"(g.h0 * ({_w(6 + k)}) + g.h1 * ({_w(12 + k)}) + {_w(24 + k)})")


def _next_state(j: int) -> str:
    reset, keep, new = _gate(j), _gate(2 + j), _gate(4 + j)
    sigmoid = "1 / (1 + exp(-({0} + {1})))"
    kept = sigmoid.format(*keep)
    return f"(1 - {kept}) * tanh({new[0]} + {sigmoid.format(*reset)} * {new[1]}) + {kept} * g.h{j} AS h{j}"


@query("fold_id:i symbol n:i code_0:d code_1:d", f"""
WITH RECURSIVE ends AS (
    SELECT fold_id, symbol, pos, uni_rank % 15 + 1 AS back, pos - (uni_rank % 15 + 1) AS first
    FROM o_pos JOIN o_uni USING (fold_id, symbol)),
steps AS (
    SELECT e.fold_id, e.symbol, e.pos, 16 - (e.pos - h.pos) AS step, h.ret AS x
    FROM ends e JOIN o_pos h ON h.fold_id = e.fold_id AND h.symbol = e.symbol AND h.pos BETWEEN e.first AND e.pos - 1),
whole AS (
    SELECT fold_id, symbol, pos FROM steps s JOIN ends USING (fold_id, symbol, pos)
    GROUP BY 1, 2, 3 HAVING count(x) = any_value(back)),
grid AS (
    SELECT w.fold_id, w.symbol, w.pos, k.step, coalesce(s.x, 0.0) AS x
    FROM whole w CROSS JOIN (SELECT unnest(generate_series(1, 15)) AS step) k
    LEFT JOIN steps s ON s.fold_id = w.fold_id AND s.symbol = w.symbol AND s.pos = w.pos AND s.step = k.step),
g AS (
    SELECT fold_id, symbol, pos, 0 AS step, 0.0::DOUBLE AS h0, 0.0::DOUBLE AS h1 FROM whole
    UNION ALL
    SELECT g.fold_id, g.symbol, g.pos, s.step, {_next_state(0)}, {_next_state(1)}
    FROM g JOIN grid s ON s.fold_id = g.fold_id AND s.symbol = g.symbol AND s.pos = g.pos AND s.step = g.step + 1)
SELECT fold_id, symbol, count(*) AS n, {", ".join(f"sum(greatest(h0 * ({_w(30 + e)}) + h1 * ({_w(32 + e)}) + {_w(34 + e)}, 0)) AS code_{e}" for e in (0, 1))}
FROM g WHERE step = 15 GROUP BY 1, 2""")
def gru_codes(spark, sf_dir):
    net = sl.GruRegressor(GruSpec(hidden=2, emb_dim=2))
    series = I.open_weekly_market(spark, sf_dir).train.series
    windows = wn.sliding_windows(series, _given_lookbacks(spark, sf_dir), GruSpec())
    return _code_sums(encode_windows(windows, _given_weights(spark, sf_dir, net), net))


# Fits whose numbers SQL cannot give; tests check them against loops and invariants.

@query("fold_id:i n_samples:i epochs_run:i first_loss:d val_loss:d")
def autoencoder_fits(spark, sf_dir):
    samples = sl.autoencoder_samples(I.open_weekly_market(spark, sf_dir).train.series, I.WEEKLY)
    spec = I.WEEKLY.autoencoder
    return sl.fit_folds(samples, sl.Autoencoder(spec), spec.trainer)


@query("fold_id:i symbol i:i v:d")
def autoencoder_embeddings(spark, sf_dir):
    return sl.autoencoder_embeddings(I.open_weekly_market(spark, sf_dir).train.series, I.WEEKLY).select(
        "fold_id", "symbol", F.posexplode("embedding").alias("i", "v"))


@query("fold_id:i symbol i:i v:d")
def gru_embeddings(spark, sf_dir):
    return sl.gru_embeddings(I.open_weekly_market(spark, sf_dir).train.series, I.WEEKLY).select(
        "fold_id", "symbol", F.posexplode("embedding").alias("i", "v"))


@query(FOLD_METRICS)
def autoencoder_fold_metrics(spark, sf_dir):
    return I.autoencoder_arm(spark, sf_dir).fold_metrics


@query(FOLD_METRICS)
def gru_fold_metrics(spark, sf_dir):
    return I.gru_arm(spark, sf_dir).fold_metrics


@query(f"arm {METRICS}")
def autoencoder_walk_forward(spark, sf_dir):
    return I.autoencoder_arm(spark, sf_dir).aggregate


@query(f"arm {METRICS}")
def gru_walk_forward(spark, sf_dir):
    return I.gru_arm(spark, sf_dir).aggregate
