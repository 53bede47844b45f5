"""The 35 causal features, computed along each series in one pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from panelcast.functions.vectors import Powers, ewm, powers_of, ratio, rolling_deviation, rolling_extreme, rolling_mean, shifted
from panelcast.functions.windows import forward_fill, series
from panelcast.plans.along import Series, along_series, doubles, picked
from panelcast.schemas import FEATURES, MARKET_COLS, OHLCV

TINY = 1e-9
LONGEST = 252  # rows of the longest frame
FAST, SLOW, SIGNAL = 12, 26, 9  # spans of the moving averages


def join_market(bars: DataFrame, market: DataFrame | None) -> DataFrame:
    """Attach the market columns by exact date, then carry them forward along the ticker's
    own rows (never backward). Missing columns become null.

    The market table has one row per calendar day, which bounds the broadcast.
    """
    if market is None:
        return bars.withColumns({c: F.lit(None).cast("double") for c in MARKET_COLS})
    have = [c for c in MARKET_COLS if c in market.columns]
    joined = bars.join(F.broadcast(market.select("date", *have)), "date", "left")
    filled = {c: forward_fill(c, series()) if c in have else F.lit(None).cast("double") for c in MARKET_COLS}
    return joined.withColumns(filled)


def compute_features(bars: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """(ticker, date, 35 features), keeping only rows where every feature is present.

    Equal to `complete_rows(feature_columns(...))`.
    """
    return _along(bars, market, _complete_rows, [])


def complete_rows(features: DataFrame) -> DataFrame:
    return features.na.drop(subset=FEATURES).select("ticker", "date", *FEATURES)


def feature_columns(bars: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """All feature columns before the completeness filter (warm-up rows carry nulls)."""
    return _along(bars, market, series_features, [])


def flagged_columns(bars: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """feature_columns with `complete`: whether the row would survive the completeness filter."""
    return _along(bars, market, series_features, [T.StructField("complete", T.BooleanType())])


def _along(bars: DataFrame, market: DataFrame | None, work, flags: list[T.StructField]) -> DataFrame:
    joined = join_market(bars.select("ticker", "date", *OHLCV), market).select("ticker", "date", *OHLCV, *MARKET_COLS)
    powers = powers_of(bars.sparkSession, (FAST, SLOW, SIGNAL))
    return along_series(joined, lambda s: work(s, powers), [bars.schema["date"], *flags, *doubles(FEATURES)])


def series_features(s: Series, powers: Powers) -> Series:
    """The features of one series, by row, and whether all of them are present.

    Bars are complete, as `clean` leaves them, so a frame is full where its rows exist. What may still be missing are ratios, for
    want of a divisor, and the market.
    """
    inputs = trend_inputs(s)
    inputs |= rolling_inputs(s, inputs)
    return {"date": s["date"], "complete": _all_there(s, inputs)} | derived_columns(s, inputs, powers)


def _complete_rows(s: Series, powers: Powers) -> Series:
    found = series_features(s, powers)
    return picked(found, found["complete"])


def _all_there(s: Series, inputs: Series) -> np.ndarray:
    there = ~np.isnan(s["Close"])
    before = np.cumsum(there)
    before[LONGEST:] -= before[:-LONGEST].copy()
    full = before == LONGEST
    for c in (*(s[c] for c in (*OHLCV, *MARKET_COLS)), inputs["ROC_21"], inputs["gain14"]):
        full &= ~np.isnan(c)
    return full & (inputs["loss14"] != 0)


def trend_inputs(s: Series) -> Series:
    """Row-to-row quantities: lags, gains and losses, true range, signed volume."""
    close, high, low = s["Close"], s["High"], s["Low"]
    before = shifted(close, 1)
    change = close - before
    return {
        "prev_close": before, "prev_open": shifted(s["Open"], 1),
        "MOM_5": close - shifted(close, 5), "ROC_21": ratio(close, shifted(close, 21)) - 1,
        # A null first change stays null: it is neither a gain nor a loss.
        "gain": np.maximum(change, 0), "loss": np.maximum(-change, 0),
        "range": np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before)),
        "obv": np.cumsum(np.nan_to_num(np.sign(change) * s["Volume"])),
    }


def rolling_inputs(s: Series, inputs: Series) -> Series:
    """Rolling means, extremes and deviations."""
    close, sma50 = s["Close"], rolling_mean(s["Close"], 50)
    highest, lowest = (lambda x, n, op=op: rolling_extreme(x, op, n) for op in (np.maximum, np.minimum))
    return {
        "SMA_10": rolling_mean(close, 10), "SMA_50": sma50, "SMA_200": rolling_mean(close, 200), "prev_sma50": shifted(sma50, 1),
        "sma20": rolling_mean(close, 20), "sd20": rolling_deviation(close, 20),
        "gain14": rolling_mean(inputs["gain"], 14), "loss14": rolling_mean(inputs["loss"], 14), "ATR_14": rolling_mean(inputs["range"], 14),
        "Volume_SMA_20": rolling_mean(s["Volume"], 20),
        "high14": highest(s["High"], 14), "low14": lowest(s["Low"], 14), "high252": highest(s["High"], LONGEST), "low252": lowest(s["Low"], LONGEST),
        "obv252": highest(inputs["obv"], LONGEST),
    }


def derived_columns(s: Series, inputs: Series, powers: Powers) -> Series:
    """The features from the prepared inputs, row by row but for the moving averages."""
    open_, high, low, close, volume = (s[c] for c in OHLCV)
    macd = ewm(close, FAST, powers) - ewm(close, SLOW, powers)
    body, full = close - open_, np.where(high - low == 0, TINY, high - low)
    size, upper, lower = np.abs(body), high - np.maximum(close, open_), np.minimum(close, open_) - low
    peak = np.abs(np.where(inputs["obv252"] == 0, 1.0, inputs["obv252"]))
    upper_band, lower_band = inputs["sma20"] + inputs["sd20"] * 2, inputs["sma20"] - inputs["sd20"] * 2
    prev_close, prev_open, prev_trend = inputs["prev_close"], inputs["prev_open"], inputs["prev_sma50"]
    small = size < full * 0.3
    flag = lambda told: told.astype(float)
    found = {
        "Open": open_, "High": high, "Low": low, "Close": close, "Volume": volume,
        **{c: inputs[c] for c in ("SMA_10", "SMA_50", "SMA_200", "MOM_5", "ROC_21", "ATR_14", "Volume_SMA_20")},
        "MACD": macd, "MACD_signal": ewm(macd, SIGNAL, powers),
        "RSI_14": 100 - 100 / (1 + ratio(inputs["gain14"], inputs["loss14"])),
        "Williams_R": -100 * (inputs["high14"] - close) / (inputs["high14"] - inputs["low14"] + TINY),
        "BB_upper": upper_band, "BB_lower": lower_band, "BB_width": (upper_band - lower_band) / (inputs["sma20"] + TINY),
        "OBV_norm": inputs["obv"] / peak, "Volume_ratio": volume / (inputs["Volume_SMA_20"] + TINY),
        "body_size": size, "upper_shadow": upper, "lower_shadow": lower, "body_pct": body / full,
        "doji": flag(size < full * 0.1),
        "hammer": flag((prev_close < prev_trend) & small & (lower > size * 2) & (upper < full * 0.1)),
        "shooting_star": flag((prev_close > prev_trend) & small & (upper > size * 2) & (lower < full * 0.1)),
        "engulfing": flag((body > 0) & (prev_close - prev_open < 0) & (close > prev_open) & (open_ < prev_close)),
        "pct_from_52w_high": (close - inputs["high252"]) / (inputs["high252"] + TINY),
        "pct_from_52w_low": (close - inputs["low252"]) / (inputs["low252"] + TINY),
        "price_range_pct": full / (close + TINY),
        **{c: s[c] for c in MARKET_COLS},
    }
    return {c: found[c] for c in FEATURES}
