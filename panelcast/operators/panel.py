"""Windows, forward-return labels, the modelling panel and its anchors."""

from __future__ import annotations

from functools import reduce
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelcast.config import DEFAULTS, ForecastConfig
from panelcast.functions.dates import month_of
from panelcast.functions.numbers import safe_div
from panelcast.functions.vectors import ratio, shifted
from panelcast.functions.windows import series
from panelcast.operators.features import compute_features
from panelcast.operators.quality import clean
from panelcast.plans.along import Series, along_series, doubles
from panelcast.schemas import FEATURES

Featuriser = Callable[[DataFrame, "DataFrame | None"], DataFrame]


def with_labels(features: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """Forward returns per horizon, counted in surviving feature rows.

    Rows are kept from the end of the first full window to the last row whose longest
    horizon exists. `label_end` is the date on which the longest label is known.
    """
    w = series()
    ahead = [(safe_div(F.lead("Close", h).over(w), F.col("Close")) - 1).alias(f"y_{name}") for name, h in cfg.horizons.items()]
    labelled = features.select(
        "*", *ahead,
        F.col("Close").alias("base_close"),
        F.lead("date", cfg.max_horizon).over(w).alias("label_end"),
        F.row_number().over(w).alias("__rn"),
    )
    return (
        labelled.where((F.col("__rn") >= cfg.window) & F.col("label_end").isNotNull())
        .drop("__rn")
        .withColumnRenamed("date", "end_date")
    )


def sliding_windows(features: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """One row per window: X (window x features, float), labels, end_date and base_close.

    Meant for models that need the full window; everything else should use the panel, which
    never builds it. The steps of a series are stacked once, and each window is cut out of them where it is read.
    """
    window, labels = cfg.window, list(cfg.horizons.values())

    def stacked(s: Series) -> dict | None:
        ahead = labels_ahead(s, cfg)
        at = np.flatnonzero((np.arange(len(s["date"])) >= window - 1) & ~np.isnan(ahead["label_end"]))
        if not len(at):
            return None
        steps = _nested(np.stack([s[c] for c in FEATURES], 1))
        values = lambda x, kind: pa.array(x, kind, from_pandas=True)
        y = _nested(np.stack([ahead[c][at] for c in cfg.label_cols], 1))
        rows = pa.StructArray.from_arrays(
            [pa.array(at + 2 - window, pa.int32()), values(s["date"][at], pa.float64()).cast(pa.int32()).cast(pa.date32()), y, values(s["Close"][at].astype(np.float32), pa.float32())],
            ["start", "end_date", "y_ret", "base_close"])
        return {"steps": _whole(steps), "rows": _whole(rows)}

    floats = T.ArrayType(T.FloatType())
    row = T.StructType([T.StructField("start", T.IntegerType()), features_date(features, "end_date"), T.StructField("y_ret", floats), T.StructField("base_close", T.FloatType())])
    whole = along_series(features, stacked, [T.StructField("steps", T.ArrayType(floats)), T.StructField("rows", T.ArrayType(row))])
    each = whole.select("ticker", "steps", F.explode("rows").alias("__w"))
    # The one-row generator keeps readers from taking the cut apart: it is made once a row, and the steps go no further.
    cut = F.struct(F.slice("steps", F.col("__w.start"), F.lit(window)).alias("X"))
    return each.select("ticker", "__w", F.inline(F.array(cut))).select("ticker", "__w.end_date", "X", "__w.y_ret", "__w.base_close")


def features_date(features: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, features.schema["date"].dataType)


def _nested(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists of floats, null for NaN."""
    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel().astype(np.float32), pa.float32(), from_pandas=True))


def _whole(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def labels_ahead(s: Series, cfg: ForecastConfig = DEFAULTS) -> Series:
    """Forward returns of one series per horizon, counted in its rows, and `label_end`: see with_labels."""
    close = s["Close"]
    ahead = {f"y_{name}": ratio(shifted(close, -h), close) - 1 for name, h in cfg.horizons.items()}
    return ahead | {"base_close": close, "label_end": shifted(s["date"], -cfg.max_horizon)}


def build_panel(
    bars: DataFrame, market: DataFrame | None, cfg: ForecastConfig = DEFAULTS, featurise: Featuriser = compute_features
) -> DataFrame:
    """Clean, featurise and label all tickers in one plan.

    Series that fail the gates simply have no rows; an empty result keeps the schema.
    `featurise` may be replaced by any function of (bars, market) with the same columns.
    """
    return panel_from_features(featurise(clean(bars, cfg), market), cfg)


def panel_from_features(features: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """Labelled rows of every usable series.

    `month_end` marks a ticker's last row in a calendar month, so that picking anchors later is a filter.
    """
    return panel_of(modelling_table(features, cfg), cfg)


def modelling_table(rows: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """Every feature row with nullable labels, in the plan that computes the features.

    rows: (ticker, date, complete, features), warm-up rows included, with positive closes. Adds, among the complete
    rows of a ticker: labels, base_close, label_end, `row` (from 1), `n_rows` and month_end. All of it is told along the series, in
    the pass that computes the features, so bars reach this table through one exchange; written once, it serves
    features_of, panel_of and latest_of as filtered reads. Rows without the column `complete` are complete ones only.
    """
    def work(s: Series) -> Series:
        flags = s.get("complete", np.ones(len(s["date"]))) == 1
        placed = {"complete": flags}
        for group in (flags, ~flags):
            at = np.flatnonzero(group)
            if len(at):
                for c, x in _placed({c: s[c][at] for c in ("date", "Close")}, cfg).items():
                    placed.setdefault(c, np.empty(len(flags)))[at] = x
        return s | placed

    extra = [features_date(rows, "label_end"), T.StructField("row", T.IntegerType()), T.StructField("n_rows", T.LongType()), T.StructField("month_end", T.BooleanType())]
    fields = [features_date(rows, "date"), T.StructField("complete", T.BooleanType()), *doubles([*FEATURES, *cfg.label_cols, "base_close"]), *extra]
    return along_series(rows, work, fields)


def _placed(s: Series, cfg: ForecastConfig) -> Series:
    """Labels and places of one series' complete rows."""
    n, row = len(s["date"]), np.arange(1, len(s["date"]) + 1)
    known = ~np.isnan(s["date"])
    month = np.where(known, s["date"], 0).astype("datetime64[D]").astype("datetime64[M]")
    ends = np.ones(n, bool)
    ends[:-1] = (month[1:] != month[:-1]) & known[:-1] | ~known[1:]
    ends |= row == n - cfg.max_horizon
    return labels_ahead(s, cfg) | {"row": row, "n_rows": np.full(n, n), "month_end": ends}


def features_of(table: DataFrame) -> DataFrame:
    """The complete feature rows of a modelling table."""
    return table.where("complete").select("ticker", "date", *FEATURES)


def is_labelled(cfg: ForecastConfig = DEFAULTS) -> Column:
    """Whether a row of a modelling table belongs to the panel."""
    placed = F.col("complete") & (F.col("n_rows") >= cfg.min_feature_rows) & (F.col("row") >= cfg.window)
    # As na.drop has it: a label that is not a number is missing too.
    known = [F.col(c).isNotNull() & ~F.isnan(c) for c in cfg.label_cols]
    return F.coalesce(reduce(Column.__and__, known, placed & F.col("label_end").isNotNull()), F.lit(False))


def is_newest(cfg: ForecastConfig = DEFAULTS) -> Column:
    """Whether a row of a modelling table is its ticker's newest, with enough history."""
    return F.col("complete") & (F.col("row") == F.col("n_rows")) & (F.col("n_rows") >= cfg.min_feature_rows)


def panel_of(table: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """The panel of a modelling table: what panel_from_features makes of its complete rows."""
    return table.where(is_labelled(cfg)).select(
        "ticker", F.col("date").alias("end_date"), *FEATURES, *cfg.label_cols, "base_close", "label_end", "month_end")


def latest_of(table: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """The newest complete row of each ticker with enough history: what latest_rows finds."""
    return table.where(is_newest(cfg)).select("ticker", F.col("date").alias("end_date"), *FEATURES, "base_close")


def month_end_anchors(panel: DataFrame) -> DataFrame:
    """The last panel row of each ticker in each calendar month."""
    if "month_end" in panel.columns:
        return panel.where("month_end")
    by_month = Window.partitionBy("ticker", month_of("end_date")).orderBy(F.desc("end_date"))
    return panel.withColumn("__rn", F.row_number().over(by_month)).where(F.col("__rn") == 1).drop("__rn")


def latest_rows(features: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """Each ticker's most recent feature row, the anchor of a live forecast.

    `features` should be a written table. Only keys and dates are aggregated over the whole
    of it; the wide rows are read from the earliest last date on, usually a few days.
    """
    last = (
        features.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("date"))
        .where(F.col("n") >= cfg.min_feature_rows)
        .select("ticker", "date")
    )
    recent = features.where(F.col("date") >= last.select(F.min("date")).scalar())
    return recent.join(last, ["ticker", "date"], "left_semi").select(
        "ticker", F.col("date").alias("end_date"), *FEATURES, F.col("Close").alias("base_close")
    )
