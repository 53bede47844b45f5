"""End-to-end jobs: train and evaluate, backtest, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.config import DEFAULTS, ForecastConfig
from panelcast.operators.backtest import (
    backtest_report,
    monthly_returns,
    require_signal,
    signal_from_predictions,
    track_record,
)
from panelcast.operators.baselines import HistoricalQuantile, RandomWalk, long_labels, training_labels
from panelcast.operators.cv import Fold, require_folds, scored_anchors, walk_forward_folds
from panelcast.operators.ensemble import apply_ensemble, fit_ensemble
from panelcast.operators.metrics import score_table
from panelcast.operators.features import flagged_columns
from panelcast.operators.panel import features_of, latest_rows, modelling_table, month_end_anchors, panel_of
from panelcast.operators.quality import clean, skip_report
from panelcast.operators.series_vol import SeriesVol
from panelcast.operators.trees import LeafQuantileForest, TreeForecaster
from panelcast.operators.views import forecast_header, forecast_records, forecast_rows, price_arrays, price_history
from panelcast.plans.materialize import materialize
from panelcast.schemas import FEATURES
from panelcast.sinks.documents import metrics_document, write_model_card, write_one_document, write_records
from panelcast.sinks.tables import write_drift_reference, write_panel
from panelcast.sources.reference_data import read_metrics_params

BASELINES = ["random_walk", "baseline"]  # then the tree model, the series model and the ensemble


@dataclass
class Training:
    folds: list[Fold]
    preds: DataFrame  # wide: key columns, y and one quantile array per model
    params: DataFrame | None  # (horizon, w, delta)
    scores: DataFrame  # (model, horizon, metrics...)
    forest: TreeForecaster


@dataclass
class Build:
    table: DataFrame  # features with labels, see modelling_table
    panel: DataFrame
    skipped: DataFrame  # (ticker, reason)


def run_build(
    bars: DataFrame, market: DataFrame | None, universe: DataFrame | None = None, cfg: ForecastConfig = DEFAULTS, out_dir: str | None = None,
) -> Build:
    """From bars to the panel in one plan and one write, and a reason for every ticker that has no panel rows."""
    table = materialize(modelling_table(flagged_columns(clean(bars, cfg), market), cfg), "modelling")
    panel, skipped = panel_of(table, cfg), materialize(skip_report(bars, features_of(table), universe, cfg), "skipped")
    if out_dir:
        write_panel(panel, f"{out_dir}/panel")
        write_records(skipped, f"{out_dir}/skipped")
    return Build(table, panel, skipped)


def anchor_rows(panel: DataFrame, folds: list[Fold], cfg: ForecastConfig = DEFAULTS, keep: list[str] | None = None) -> DataFrame:
    """Test anchors in long form: (fold, split, ticker, end_date, horizon, y) plus kept columns."""
    anchors = scored_anchors(month_end_anchors(panel), folds)
    return long_labels(anchors, cfg, keep=["fold", "split", "ticker", "end_date", *(keep or [])])


def predict_anchors(
    panel: DataFrame, bars: DataFrame | None, folds: list[Fold], cfg: ForecastConfig = DEFAULTS, rows: DataFrame | None = None
) -> DataFrame:
    """Out-of-sample predictions of the models that need no features, side by side."""
    train = training_labels(panel, folds, cfg)
    rows = anchor_rows(panel, folds, cfg) if rows is None else rows
    rows = RandomWalk(cfg).fit(train).predict(rows)
    rows = HistoricalQuantile(cfg).fit(train).predict(rows)
    return rows if bars is None else SeriesVol(cfg).fit(bars).predict(rows)


def run_training(
    panel: DataFrame, bars: DataFrame | None, cfg: ForecastConfig = DEFAULTS, out_dir: str | None = None,
    forest: TreeForecaster | None = None,
) -> Training:
    """Fit every model per fold, predict the test anchors, blend, calibrate and score.

    `forest` is any TreeForecaster; it is reported under its own name.

    `panel` should be a written table: every fit scans it. Without bars the price-history
    model and the ensemble are left out; bars that hold none of the panel's tickers are an error.
    """
    if bars is not None and panel.join(bars.select("ticker"), "ticker", "left_semi").isEmpty():
        raise ValueError("no ticker of the panel has bars")
    folds = require_folds(walk_forward_folds(panel, cfg))
    forest = (forest or LeafQuantileForest(cfg)).fit_folds(panel, folds)
    # One row per anchor and horizon, about 1/7 of the panel; every forest scans its part.
    rows = materialize(anchor_rows(panel, folds, cfg, keep=FEATURES), "anchors")
    preds = predict_anchors(panel, bars, folds, cfg, forest.predict(rows).drop(*FEATURES))
    preds = materialize(preds, "predictions")
    models, params = [*BASELINES, forest.name], None
    if bars is not None:
        params = materialize(fit_ensemble(preds, "series_vol", forest.name, cfg).repartition(1), "params")
        preds = apply_ensemble(preds, params, "series_vol", forest.name)
        models = [*models, "series_vol", "ensemble"]
    scores = materialize(score_table(preds, models, cfg).repartition(1), "scores")
    if out_dir:
        forest.save(f"{out_dir}/forest")
        write_drift_reference(panel, f"{out_dir}/feature_reference")
        write_one_document(metrics_document(scores, params), f"{out_dir}/metrics")
        write_model_card(scores, f"{out_dir}/model_card", params)
    return Training(folds, preds, params, scores, forest)


def out_of_sample_signal(panel: DataFrame, cfg: ForecastConfig = DEFAULTS, horizon: str = "1m",
                         forest: TreeForecaster | None = None) -> DataFrame:
    """The tree model's predicted median against realized return on all test anchors."""
    folds = require_folds(walk_forward_folds(panel, cfg))
    forest = (forest or LeafQuantileForest(cfg)).fit_folds(panel, folds, [horizon])
    rows = materialize(anchor_rows(panel, folds, cfg, keep=FEATURES).where(F.col("horizon") == horizon), "anchors")
    return signal_from_predictions(forest.predict(rows), forest.name, horizon, cfg)


def run_backtest(panel: DataFrame, cfg: ForecastConfig = DEFAULTS, out_dir: str | None = None, horizon: str = "1m",
                 forest: TreeForecaster | None = None) -> DataFrame:
    """The backtest report (one nested row) on the tree model's signal."""
    forest = forest or LeafQuantileForest(cfg)
    signal = materialize(require_signal(out_of_sample_signal(panel, cfg, horizon, forest)), "signal")
    monthly = materialize(monthly_returns(signal, cfg).repartition(1), "monthly")
    report = backtest_report(monthly, horizon, cfg, forest.name)
    if out_dir:
        write_one_document(report, f"{out_dir}/backtest")
        write_records(track_record(signal, cfg), f"{out_dir}/stock_track")
    return report


def run_export(
    spark: SparkSession, features: DataFrame, raw_bars: DataFrame, artifacts: str, out_dir: str,
    meta: DataFrame | None = None, cfg: ForecastConfig = DEFAULTS, use_series_model: bool = True,
    kind: type[TreeForecaster] = LeafQuantileForest,
) -> DataFrame:
    """Live forecasts for every ticker's latest row, price histories and the metrics copy.

    Without the series model the forest's own quantiles are exported as they are: no blend,
    no calibration.
    """
    latest = materialize(latest_rows(features, cfg), "latest")
    if latest.isEmpty():
        raise ValueError("no usable tickers to forecast")
    forest = kind.load(spark, f"{artifacts}/forest", cfg)
    horizons = F.explode(F.array(*[F.lit(h) for h in cfg.horizons])).alias("horizon")
    rows = latest.select("*", F.lit(0).alias("fold"), horizons)
    scored = forest.predict(rows)
    band = forest.name
    if use_series_model:
        scored = SeriesVol(cfg).fit(raw_bars).predict(scored)
        params = read_metrics_params(spark, f"{artifacts}/metrics", cfg)
        scored, band = apply_ensemble(scored, params, "series_vol", forest.name), "ensemble"
    forecasts = forecast_rows(scored, band, meta, cfg)
    write_records(forecast_records(forecasts, cfg), f"{out_dir}/forecasts")
    write_one_document(forecast_header(forecasts, cfg), f"{out_dir}/forecasts_header")
    write_records(price_arrays(price_history(raw_bars, latest, cfg.price_history_days)), f"{out_dir}/prices")
    spark.read.text(f"{artifacts}/metrics", wholetext=True).repartition(1).write.mode("overwrite").text(f"{out_dir}/metrics")
    return forecasts
