"""All tunable settings of the engine, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Mapping

# The forecast horizons, in surviving rows after the anchor row.
HORIZONS: Mapping[str, int] = MappingProxyType({"1m": 21, "3m": 63, "6m": 126})

# The quantile levels every forecast carries, lowest first.
QUANTILES: tuple[float, ...] = (0.1, 0.5, 0.9)

# The model order of the comparison view.
MODELS: tuple[str, ...] = ("random_walk", "baseline", "gbm", "series_vol", "ensemble")

# One-sided cost grid of the backtest, in basis points.
COST_GRID_BPS: tuple[int, ...] = (0, 5, 10, 20, 30)


@dataclass(frozen=True)
class ForecastConfig:
    horizons: Mapping[str, int] = field(default_factory=lambda: dict(HORIZONS))
    quantiles: tuple[float, ...] = QUANTILES
    window: int = 252
    # quality gate
    max_null_share: float = 0.05
    min_rows: int = 200
    spike: float = 0.5
    # walk-forward folds
    n_folds: int = 4
    min_train_dates: int = 252
    embargo: int | None = None
    purge: str = "busdays"
    # calibration and backtest
    alpha: float = 0.2
    blend_steps: int = 20
    decile: float = 0.1
    min_names: int = 30
    min_track: int = 12
    price_history_days: int = 180
    # A group up to this many rows may be ranked by a plain window; larger ones take the
    # range-partitioned path in panelcast.plans.ranking.
    max_group_rows: int = 1_000_000

    @property
    def max_horizon(self) -> int:
        return max(self.horizons.values())

    @property
    def embargo_days(self) -> int:
        return self.max_horizon if self.embargo is None else self.embargo

    @property
    def min_feature_rows(self) -> int:
        return self.window + self.max_horizon

    @property
    def label_cols(self) -> list[str]:
        return [f"y_{name}" for name in self.horizons]


DEFAULTS = ForecastConfig()
