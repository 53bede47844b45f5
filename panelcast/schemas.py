"""Column lists and explicit schemas of the tables that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T

from panelcast.config import DEFAULTS, ForecastConfig

OHLCV = ["Open", "High", "Low", "Close", "Volume"]
MARKET_COLS = ["vix_close", "sp500_ret_21d", "sp500_ret_63d"]

# The feature columns in the order models and reports expect them.
FEATURES = [
    "Open", "High", "Low", "Close", "Volume",
    "SMA_10", "SMA_50", "SMA_200", "MACD", "MACD_signal",
    "RSI_14", "MOM_5", "ROC_21", "Williams_R",
    "ATR_14", "BB_upper", "BB_lower", "BB_width",
    "OBV_norm", "Volume_SMA_20", "Volume_ratio",
    "body_size", "upper_shadow", "lower_shadow", "body_pct",
    "doji", "hammer", "shooting_star", "engulfing",
    "pct_from_52w_high", "pct_from_52w_low", "price_range_pct",
    "vix_close", "sp500_ret_21d", "sp500_ret_63d",
]


def _doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


_KEY = [T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType())]
_ANCHOR = [T.StructField("ticker", T.StringType()), T.StructField("end_date", T.DateType())]

BARS = T.StructType(_KEY + _doubles(OHLCV))
MARKET = T.StructType([T.StructField("date", T.DateType())] + _doubles(MARKET_COLS))
FEATURE_TABLE = T.StructType(_KEY + _doubles(FEATURES))
SIGNAL = T.StructType(
    [T.StructField("end_date", T.DateType()), T.StructField("ticker", T.StringType())]
    + _doubles(["pred", "realized"])
)
META = T.StructType([T.StructField(n, T.StringType()) for n in ("ticker", "name", "sector")])


def panel_schema(cfg: ForecastConfig = DEFAULTS) -> T.StructType:
    return T.StructType(_ANCHOR + _doubles(FEATURES + cfg.label_cols + ["base_close"]))


# Metrics document: model -> y_<horizon> -> metric, plus per-horizon scalars.
METRICS_DOC = T.StructType(
    [
        T.StructField("blend_weight", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("conformal_delta", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
