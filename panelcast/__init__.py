"""Probabilistic forecasting on panels of daily series, built on Spark DataFrames."""

from panelcast.config import DEFAULTS, ForecastConfig

__all__ = ["DEFAULTS", "ForecastConfig"]
