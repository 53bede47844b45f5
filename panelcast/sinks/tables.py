"""Parquet sinks: bar cache, panel, drift reference and market series."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelcast.operators.metrics import drift_reference


def write_bars(bars: DataFrame, path: str) -> None:
    """Write-through of the bar cache: one table, clustered by ticker.

    Files hold ranges of tickers in order, so reading a few tickers skips the rest by file
    statistics, however many tickers there are.
    """
    clustered = bars.repartitionByRange("ticker", "date").sortWithinPartitions("ticker", "date")
    clustered.write.mode("overwrite").parquet(path)


def write_market(market: DataFrame, path: str) -> None:
    market.write.mode("overwrite").parquet(path)


def write_panel(panel: DataFrame, path: str) -> str:
    """The modelling panel. Values round-trip exactly; files stay in ticker order so that
    later per-ticker scans skip row groups."""
    panel.sortWithinPartitions("ticker", "end_date").write.mode("overwrite").parquet(path)
    return path


def write_drift_reference(panel: DataFrame, path: str) -> None:
    drift_reference(panel).write.mode("overwrite").parquet(path)
