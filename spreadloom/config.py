"""Settings of a walk-forward run.

All settings are small frozen dataclasses on the driver; functions take them as
arguments, so one process can run several configurations side by side.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from statistics import NormalDist

# The market calendar and the thresholds that define the results.
INTRADAY_RETURNS_PER_DAY = 12
TRADING_DAYS_PER_YEAR = 252
DEFAULT_SEED = 42


# The defaults of the settings below define the results as well.
@dataclass(frozen=True)
class MarketClock:
    zone: str = "America/New_York"
    open_time: str = "09:30"
    bars_per_year: int = INTRADAY_RETURNS_PER_DAY * TRADING_DAYS_PER_YEAR


@dataclass(frozen=True)
class FoldPlan:
    train_days: int = 252
    test_days: int = 63
    roll_days: int = 63


@dataclass(frozen=True)
class TradeRule:
    z_entry: float = 2.5
    z_exit: float = 0.5
    z_stop: float = 4.0
    cost_per_side: float = 0.0005
    window_per_half_life: float = 2.0
    window_floor: int = 5
    # False: half a window (at least `window_floor` bars) is enough for a z-score.
    # True: the whole window must be filled.
    full_window: bool = False
    # False: always z-score against the train mean and deviation.
    rolling: bool = True


@dataclass(frozen=True)
class Eligibility:
    min_spread_vol: float = 0.005
    max_pairs: int = 20
    min_coverage: float = 0.95
    top_n_liquid: int | None = 150
    bp_alpha: float = 0.05
    # True drops a pair whose p-value equals bp_alpha, False keeps it.
    bp_strict: bool = False
    half_life_min: float = 1.0
    half_life_max: float = 150.0
    rank_by: str = "train_sharpe"

    @property
    def bp_critical(self) -> float:
        """Upper bp_alpha quantile of a chi-square with one degree of freedom."""
        return NormalDist().inv_cdf(1.0 - self.bp_alpha / 2.0) ** 2


@dataclass(frozen=True)
class CorrelationSearch:
    top_k: int | None = 300
    min_corr: float | None = 0.5
    min_overlap: int = 50


@dataclass(frozen=True)
class NeighbourSearch:
    k: int = 8
    cap: int = 300


@dataclass(frozen=True)
class TrainerSpec:
    epochs: int = 40
    batch_size: int = 256
    lr: float = 1e-3
    weight_decay: float = 1e-5
    patience: int = 6
    min_gain: float = 1e-6
    validation_share: float = 0.15
    # Steps of an epoch at most; a larger fold takes larger batches.
    most_batches: int = 8
    # Samples of a block, which is what one task holds of a fold.
    block_samples: int = 256


@dataclass(frozen=True)
class AutoencoderSpec:
    seq_len: int = 12
    hidden: int = 64
    emb_dim: int = 16
    min_valid_share: float = 0.5
    min_windows: int = 5
    min_samples: int = 10
    trainer: TrainerSpec = field(default_factory=TrainerSpec)
    neighbours: NeighbourSearch = field(default_factory=NeighbourSearch)


@dataclass(frozen=True)
class GruSpec:
    max_lags: int = 15
    ar_cutoff: float = 0.01
    ar_margin: int = 30
    default_lookback: int = 5
    hidden: int = 64
    emb_dim: int = 16
    min_windows: int = 5
    min_samples: int = 50
    trainer: TrainerSpec = field(default_factory=TrainerSpec)
    neighbours: NeighbourSearch = field(default_factory=NeighbourSearch)


@dataclass(frozen=True)
class RunSettings:
    clock: MarketClock = field(default_factory=MarketClock)
    folds: FoldPlan = field(default_factory=FoldPlan)
    rule: TradeRule = field(default_factory=TradeRule)
    eligibility: Eligibility = field(default_factory=Eligibility)
    correlation: CorrelationSearch = field(default_factory=CorrelationSearch)
    autoencoder: AutoencoderSpec = field(default_factory=AutoencoderSpec)
    gru: GruSpec = field(default_factory=GruSpec)

    def snapshot(self) -> dict:
        return asdict(self)


def baseline_settings() -> RunSettings:
    """The exploratory variant: full coverage, strict BP, half-life ranking."""
    return RunSettings(
        rule=TradeRule(full_window=True),
        eligibility=Eligibility(
            min_coverage=1.0, bp_strict=True, half_life_min=10.0, rank_by="half_life"
        ),
    )
