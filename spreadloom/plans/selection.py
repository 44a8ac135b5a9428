"""Pair selectors: from the train windows of all folds to their tradeable pairs.

A selector is any callable from ``TrainData`` to a pairs DataFrame with the columns
of ``PAIR_COLUMNS``; it sees train data only, all folds at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, functions as F

from ..config import RunSettings
from ..functions.nets import Autoencoder, GruRegressor
from ..operators.autoregression import ar_fits, lookbacks
from ..operators.correlation import correlated_pairs
from ..operators.metrics import sharpe
from ..operators.neighbours import neighbour_pairs
from ..operators.pairstats import (
    PAIR, cap_pairs, eligible_pairs, pair_grid, pair_statistics, with_p_value)
from ..operators.signal import evaluate_pairs
from ..operators.training import encode_and_pool, fit_folds
from ..operators.windows import (
    enough, sliding_windows, standardize, tumbling_windows, window_scale)
from ..sources.results import config_key, fit_with_cache, save_folds
from ..staging import stage

SCORES = ("cand_rank", "train_corr", "emb_distance")
PAIR_COLUMNS = (*PAIR, "alpha", "beta", "mu", "sigma", "half_life", "bp_stat", "bp_pval",
                "train_sharpe", *SCORES, "rank")


@dataclass(frozen=True)
class TrainData:
    """Train side of a run: packed series of each fold's universe."""

    series: DataFrame
    folds: DataFrame


Selector = Callable[[TrainData], DataFrame]


def pair_fits(candidates: DataFrame, series: DataFrame) -> DataFrame:
    """Statistics of every candidate pair, with its search scores carried along."""
    blank = {c: F.lit(None).cast("double") for c in SCORES if c not in candidates.columns}
    pairs = candidates.withColumns(blank).select(*PAIR, *SCORES)
    return with_p_value(pair_statistics(
        pair_grid(pairs, series, returns=False), carry=SCORES))


def train_sharpes(fits: DataFrame, series: DataFrame, settings: RunSettings) -> DataFrame:
    """Add ``train_sharpe``: the net Sharpe of trading the pair on its own train window."""
    bars = evaluate_pairs(pair_grid(fits, series), settings.rule)
    kept = [c for c in fits.columns if c not in PAIR]
    return bars.groupBy(*PAIR).agg(
        *[F.first(c).alias(c) for c in kept],
        sharpe(F.col("net_ret"), settings.clock.bars_per_year).alias("train_sharpe"))


def choose_pairs(candidates: DataFrame, series: DataFrame, settings: RunSettings) -> DataFrame:
    """Eligible candidates, ranked and capped.

    The cheap filters are written out before the in-sample back-test, so that only
    their survivors are traded.
    """
    rule = settings.eligibility
    fits = stage(eligible_pairs(pair_fits(candidates, series), rule), "eligible")
    if rule.rank_by == "train_sharpe":
        scored = train_sharpes(fits, series, settings)
    else:
        scored = fits.withColumn("train_sharpe", F.lit(None).cast("double"))
    return cap_pairs(scored, rule).select(*PAIR_COLUMNS)


def selection_counts(folds: DataFrame, candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fold_id, n_candidates, n_selected) of every fold."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("fold_id").agg(F.count(F.lit(1)).alias(name))

    names = ("n_candidates", "n_selected")
    joined = folds.select("fold_id")
    for df, name in zip((candidates, pairs), names):
        joined = joined.join(counted(df, name), "fold_id", "left")
    return joined.select("fold_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def _choose(candidates: DataFrame, train: TrainData, settings: RunSettings, arm: str, out: str | None) -> DataFrame:
    """The chosen pairs; with ``out`` the counts of each fold are saved with the arm's results."""
    candidates = stage(candidates, "candidates")
    pairs = choose_pairs(candidates, train.series, settings)
    if out is not None:
        pairs = stage(pairs, f"{arm}-chosen")
        save_folds({"selection": selection_counts(train.folds, candidates, pairs)}, out, arm)
    return pairs


def correlation_selector(settings: RunSettings, out: str | None = None, arm: str = "classic") -> Selector:
    def select(train: TrainData) -> DataFrame:
        return _choose(correlated_pairs(train.series, settings.correlation), train, settings, arm, out)

    return select


def select_by_vectors(vectors: DataFrame, train: TrainData, settings: RunSettings, search,
                      arm: str = "vectors", out: str | None = None) -> DataFrame:
    """Pairs of near neighbours among given symbol vectors."""
    return _choose(neighbour_pairs(vectors, search), train, settings, arm, out)


def _weights(samples: DataFrame, net, settings: RunSettings, arm: str,
             cache: str | None) -> DataFrame:
    """Fitted weights; ``cache`` is the folder of weights fitted before, known by settings and samples."""
    def fit(rows: DataFrame) -> DataFrame:
        return fit_folds(rows, net, net.spec.trainer)

    if cache is None:
        return stage(fit(samples), f"{arm}-weights")
    samples = stage(samples, f"{arm}-samples")
    return fit_with_cache(samples, fit, cache, arm, config_key(arm, settings.snapshot()))


def autoencoder_samples(series: DataFrame, settings: RunSettings) -> DataFrame:
    """Standardized windows of the folds that have enough of them."""
    spec = settings.autoencoder
    windows = tumbling_windows(series, spec)
    scaled = standardize(windows, window_scale(windows))
    return enough(scaled, spec.min_samples).select(
        "fold_id", "symbol", F.col("window_id").alias("sample_id"), "x",
        F.lit(0.0).alias("target"))


def autoencoder_embeddings(series: DataFrame, settings: RunSettings,
                           cache: str | None = None) -> DataFrame:
    spec = settings.autoencoder
    net = Autoencoder(spec)
    samples = stage(autoencoder_samples(series, settings), "ae-samples")
    weights = _weights(samples, net, settings, "autoencoder", cache)
    return encode_and_pool(samples, weights, net, spec.min_windows, unit_rows=False)


def gru_lookbacks(series: DataFrame, settings: RunSettings) -> DataFrame:
    return lookbacks(ar_fits(series, settings.gru), settings.gru)


def gru_embeddings(series: DataFrame, settings: RunSettings, cache: str | None = None,
                   backs: DataFrame | None = None) -> DataFrame:
    spec = settings.gru
    net = GruRegressor(spec)
    if backs is None:
        backs = gru_lookbacks(series, settings)
    # Lookback windows of every symbol, with and without a known next return.
    windows = stage(
        sliding_windows(series, backs, spec).withColumnRenamed("bar_pos", "sample_id"), "gru-windows")
    samples = enough(windows.filter(F.col("target").isNotNull()), spec.min_samples)
    weights = _weights(samples, net, settings, "gru", cache)
    return encode_and_pool(windows, weights, net, spec.min_windows, unit_rows=True, dtype="float32")


def autoencoder_selector(settings: RunSettings, cache: str | None = None,
                         out: str | None = None) -> Selector:
    """``out`` also saves each fold's embeddings with the arm's results."""
    def select(train: TrainData) -> DataFrame:
        vectors = stage(autoencoder_embeddings(train.series, settings, cache), "ae-embeddings")
        if out is not None:
            save_folds({"embeddings": vectors}, out, "autoencoder")
        return select_by_vectors(vectors, train, settings, settings.autoencoder.neighbours, "autoencoder", out)

    return select


def gru_selector(settings: RunSettings, cache: str | None = None,
                 out: str | None = None) -> Selector:
    """``out`` also saves each fold's lookbacks and embeddings with the arm's results."""
    def select(train: TrainData) -> DataFrame:
        backs = stage(gru_lookbacks(train.series, settings), "lookbacks")
        vectors = stage(gru_embeddings(train.series, settings, cache, backs), "gru-embeddings")
        if out is not None:
            save_folds({"lookbacks": backs, "embeddings": vectors}, out, "gru")
        return select_by_vectors(vectors, train, settings, settings.gru.neighbours, "gru", out)

    return select


BASELINE = "baseline"
SELECTORS = {
    "classic": lambda settings, cache=None, out=None: correlation_selector(settings, out),
    "autoencoder": autoencoder_selector,
    "gru": gru_selector,
    BASELINE: lambda settings, cache=None, out=None: correlation_selector(settings, out, BASELINE),
}
