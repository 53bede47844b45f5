"""Inputs derived from the given tables, written once per session and data folder."""

from __future__ import annotations

from functools import wraps
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelcast.config import DEFAULTS, ForecastConfig
from panelcast.functions.windows import full_frame
from panelcast.operators.backtest import monthly_returns
from panelcast.operators.cv import Fold, scored_anchors, walk_forward_folds
from panelcast.operators.ensemble import apply_ensemble, fit_ensemble
from panelcast.operators.features import compute_features, flagged_columns
from panelcast.operators.metrics import score_table
from panelcast.operators.panel import (
    is_labelled, is_newest, latest_of, modelling_table, month_end_anchors, panel_of,
)
from panelcast.operators.quality import clean
from panelcast.operators.series_vol import SeriesVol
from panelcast.operators.views import forecast_rows
from panelcast.plans.dealing import dealt, write_dealt
from panelcast.plans.materialize import materialize
from panelcast.plans.training import predict_anchors
from panelcast.schemas import FEATURES
from panelcast.sources.bars import bars_along, daily_bars, walk_bars, walk_days
from panelcast.sources.market import derive_market

CFG = DEFAULTS
# At the smallest scale there are only ten tickers, so the demonstration books are small.
BOOK = ForecastConfig(min_names=5, decile=0.2)
SHORT_SERIES = ForecastConfig(min_rows=480)

_made: dict[tuple, object] = {}


def once(build: Callable):
    """Reuse a result within one Spark application and data folder."""

    @wraps(build)
    def cached(spark: SparkSession, sf: str):
        key = (spark.sparkContext.applicationId, sf, build.__name__)
        if key not in _made:
            _made[key] = build(spark, sf)
        return _made[key]

    return cached


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def supplier_ticker(c: str):
    return F.concat(F.lit("S"), F.lpad(F.col(c).cast("string"), 7, "0"))


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        supplier_ticker("l_suppkey").alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
    )


def line_order():
    """Order lines within a day, as one number."""
    return F.col("l_orderkey") * 16 + F.col("l_linenumber")


@once
def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Dense bars, stretched where they are read from the written walk, which is dealt by ticker for all its readers."""
    return bars_along(write_dealt(walk_days(ticks(spark, sf)), "walk"))


def index_bars(spark: SparkSession, sf: str) -> DataFrame:
    return walk_bars(ticks(spark, sf).withColumn("ticker", F.lit("INDEX")))


def index_close(spark: SparkSession, sf: str) -> DataFrame:
    return index_bars(spark, sf).select("date", "Close")


def volatility_close(index: DataFrame) -> DataFrame:
    """A stand-in volatility index with some dates missing, to exercise the forward fill."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    moves = index.withColumn("r", F.col("Close") / F.lag("Close").over(w) - 1)
    vol = moves.select("date", (full_frame(F.stddev_samp("r"), "r", w, 21) * 100).alias("Close"))
    return vol.where(~F.dayofmonth("date").isin(13, 27))


@once
def market(spark: SparkSession, sf: str) -> DataFrame:
    index = materialize(index_close(spark, sf).repartition(1), "index")
    return materialize(derive_market(index, volatility_close(index)).repartition(1), "market")


def raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars straight from ticks, with missing and negative closes by a rule on volume."""
    lines = table(spark, sf, "lineitem").withColumns({"ticker": supplier_ticker("l_suppkey"), "line": line_order()})
    daily = daily_bars(lines, "ticker", "l_shipdate", "l_extendedprice", "l_quantity", "line")
    spoiled = F.when(F.col("Volume") % 23 == 0, F.lit(None)).when(F.col("Volume") % 29 == 0, -F.col("Close"))
    return daily.withColumn("Close", F.when(F.col("Volume") % 23 != 0, F.coalesce(spoiled, F.col("Close"))))


def modelling(spark: SparkSession, sf: str) -> DataFrame:
    """Features with labels, from bars in one pass. It is not written: who reads it once computes it."""
    return modelling_table(flagged_columns(clean(dealt(bars(spark, sf)), CFG), market(spark, sf)), CFG)


def complete_modelling(spark: SparkSession, sf: str) -> DataFrame:
    """The complete rows of `modelling`, for queries that read no others."""
    return modelling_table(compute_features(clean(dealt(bars(spark, sf)), CFG), market(spark, sf)), CFG)


def all_features(spark: SparkSession, sf: str) -> DataFrame:
    """All feature columns, warm-up rows included."""
    return modelling(spark, sf).select("ticker", "date", *FEATURES)


def features(spark: SparkSession, sf: str) -> DataFrame:
    """The complete feature rows, as features_of(modelling) has them."""
    return compute_features(clean(dealt(bars(spark, sf)), CFG), market(spark, sf))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return panel_of(complete_modelling(spark, sf), CFG)


@once
def written_features(spark: SparkSession, sf: str) -> DataFrame:
    """The features, for queries that scan them more than once."""
    return materialize(features(spark, sf), "features")


@once
def written_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The whole panel, for models that scan its features many times."""
    return materialize(panel(spark, sf), "panel")


@once
def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The panel without its features but the momentum of month ends, and the newest row of each ticker, in one narrow table."""
    momentum = F.when(F.col("month_end"), F.col("ROC_21")).alias("ROC_21")
    rows = complete_modelling(spark, sf).withColumns({"labelled": is_labelled(CFG), "newest": is_newest(CFG)}).where("labelled OR newest")
    close = F.when(F.col("newest"), F.col("base_close")).alias("base_close")
    return materialize(rows.select(
        "ticker", F.col("date").alias("end_date"), *CFG.label_cols, "label_end", "month_end", momentum, close, "labelled", "newest"), "labels")


@once
def labels(spark: SparkSession, sf: str) -> DataFrame:
    """All that folds, the models of labels and the books read."""
    return label_rows(spark, sf).where("labelled").select("ticker", "end_date", *CFG.label_cols, "label_end", "month_end", "ROC_21")


@once
def latest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest row of each ticker, from the label table where that is made already."""
    if (spark.sparkContext.applicationId, sf, "label_rows") in _made:
        return label_rows(spark, sf).where("newest").select("ticker", "end_date", "base_close")
    return materialize(latest_of(complete_modelling(spark, sf), CFG).select("ticker", "end_date", "base_close"), "latest")


@once
def folds(spark: SparkSession, sf: str) -> list[Fold]:
    return walk_forward_folds(labels(spark, sf), CFG)


@once
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(predict_anchors(labels(spark, sf), bars(spark, sf), folds(spark, sf), CFG), "predictions")


@once
def params(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(fit_ensemble(predictions(spark, sf), "series_vol", "baseline", CFG).repartition(1), "params")


def ensembled(spark: SparkSession, sf: str) -> DataFrame:
    return apply_ensemble(predictions(spark, sf), params(spark, sf), "series_vol", "baseline")


MODELS = ["random_walk", "baseline", "series_vol", "ensemble"]


@once
def scores(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(score_table(ensembled(spark, sf), MODELS, CFG).repartition(1), "scores")


@once
def signal(spark: SparkSession, sf: str) -> DataFrame:
    """A momentum signal on the test anchors: 21-day change against the one-month label."""
    anchors = scored_anchors(month_end_anchors(labels(spark, sf)), folds(spark, sf))
    return materialize(anchors.select("end_date", "ticker", F.col("ROC_21").alias("pred"), F.col("y_1m").alias("realized")), "signal")


@once
def monthly(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(monthly_returns(signal(spark, sf), BOOK).repartition(1), "monthly")


def constituent_table(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier dimension in the shape of a constituents page; every seventh one is missing."""
    nation = table(spark, sf, "nation")
    return (
        table(spark, sf, "supplier").where(F.col("s_suppkey") % 7 != 3)
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(supplier_ticker("s_suppkey").alias("Symbol"), F.col("s_name").alias("Security"),
                F.lit("x").alias("x"), F.col("n_name").alias("GICS Sector"))
    )


@once
def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Live forecasts of the price-history model at each ticker's latest row."""
    from panelcast.sources.reference_data import constituents

    horizons = F.explode(F.array(*[F.lit(h) for h in CFG.horizons])).alias("horizon")
    scored = SeriesVol(CFG).fit(bars(spark, sf)).predict(latest(spark, sf).select("*", horizons))
    return materialize(forecast_rows(scored, "series_vol", constituents(constituent_table(spark, sf)), CFG), "forecasts")
