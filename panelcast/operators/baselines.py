"""Unconditional forecasters, fitted for all folds and horizons at once.

Every forecaster has `fit(train)` and `predict(rows)`. Training tables are long, with
(fold, horizon, y); rows to predict are long too, with (fold, horizon), and come back with
a sorted array column of quantiles named after the model.
"""

from __future__ import annotations

from statistics import NormalDist
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from panelcast.config import DEFAULTS, ForecastConfig
from panelcast.operators.cv import Fold, fold_roles
from panelcast.plans.quantiles import exact_quantiles


class Forecaster(Protocol):
    name: str

    def fit(self, train: DataFrame) -> "Forecaster": ...

    def predict(self, rows: DataFrame) -> DataFrame: ...


def long_labels(rows: DataFrame, cfg: ForecastConfig = DEFAULTS, keep: list[str] | None = None) -> DataFrame:
    """One row per (row, horizon) with its label y; keeps the named columns."""
    keep = [c for c in rows.columns if c not in cfg.label_cols] if keep is None else keep
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y_{h}").alias("y")) for h in cfg.horizons])
    return rows.select(*keep, F.explode(each).alias("__l")).select(*keep, "__l.horizon", "__l.y")


def training_labels(panel: DataFrame, folds: list[Fold], cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """(fold, horizon, y) over the training rows of every fold."""
    slim = panel.select("end_date", *[c for c in ("label_end",) if c in panel.columns], *cfg.label_cols)
    train = fold_roles(slim, folds).where(F.col("role") == "train")
    return long_labels(train, cfg, keep=["fold"])


class RandomWalk:
    """Zero expected return; a Gaussian band as wide as the training labels vary."""

    name = "random_walk"

    def __init__(self, cfg: ForecastConfig = DEFAULTS):
        self.cfg = cfg
        self.sigma: DataFrame | None = None  # (fold, horizon, sigma)

    def fit(self, train: DataFrame) -> "RandomWalk":
        self.sigma = train.groupBy("fold", "horizon").agg(F.stddev_samp("y").alias("sigma"))
        return self

    def bands(self) -> DataFrame:
        z = [0.0 if q == 0.5 else NormalDist().inv_cdf(q) for q in self.cfg.quantiles]
        return self.sigma.select("fold", "horizon", F.array(*[F.col("sigma") * v for v in z]).alias(self.name))

    def predict(self, rows: DataFrame) -> DataFrame:
        return attach(rows, self.bands())


class HistoricalQuantile:
    """The empirical quantiles of the training labels."""

    name = "baseline"

    def __init__(self, cfg: ForecastConfig = DEFAULTS):
        self.cfg = cfg
        self.table: DataFrame | None = None  # (fold, horizon, level, n, y)

    def fit(self, train: DataFrame) -> "HistoricalQuantile":
        self.table = exact_quantiles(train, ["fold", "horizon"], "y", list(self.cfg.quantiles))
        return self

    def bands(self) -> DataFrame:
        by_level = F.sort_array(F.collect_list(F.struct("level", "y")))  # one entry per level
        return self.table.groupBy("fold", "horizon").agg(F.transform(by_level, lambda s: s["y"]).alias(self.name))

    def predict(self, rows: DataFrame) -> DataFrame:
        return attach(rows, self.bands())


def attach(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Put fitted per-(fold, horizon) values on the rows they apply to.

    The fitted side has one row per fold and horizon, a configured number.
    """
    return rows.join(F.broadcast(fitted), ["fold", "horizon"], "left")
