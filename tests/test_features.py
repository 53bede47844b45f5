"""Features restated row by row from their definitions, and tests of what a row may depend on."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators.features import complete_rows, compute_features, feature_columns
from panelcast.schemas import FEATURES
from panelcast.sources.market import derive_market


class Rows:
    """A series as lists, asked about one row at a time; frames that start before the series are None."""

    def __init__(self, bars: pd.DataFrame):
        self.o, self.h, self.l, self.c, self.v = (bars[k].tolist() for k in ("Open", "High", "Low", "Close", "Volume"))

    def frame(self, values, i, n):
        return None if i + 1 < n else values[i + 1 - n : i + 1]

    def mean(self, values, i, n):
        part = self.frame(values, i, n)
        return None if part is None else math.fsum(part) / n

    def weighted(self, values, i, span):
        """Exponential weights written out: the first value keeps the whole weight of the past."""
        keep = 1 - 2 / (span + 1)
        return keep**i * values[0] + (1 - keep) * math.fsum(keep ** (i - j) * values[j] for j in range(1, i + 1))

    def strength(self, i):
        if i < 14:
            return None
        moves = [self.c[j] - self.c[j - 1] for j in range(i - 13, i + 1)]
        rises, falls = sum(m for m in moves if m > 0), -sum(m for m in moves if m < 0)
        return None if falls == 0 else 100 - 100 / (1 + rises / falls)

    def true_range(self, i):
        gaps = [self.h[i] - self.l[i]]
        if i:
            gaps += [abs(self.h[i] - self.c[i - 1]), abs(self.l[i] - self.c[i - 1])]
        return max(gaps)

    def signed_volume(self):
        total, out = 0.0, []
        for i, v in enumerate(self.v):
            total += 0 if i == 0 else v * ((self.c[i] > self.c[i - 1]) - (self.c[i] < self.c[i - 1]))
            out.append(total)
        return out


def checks(r: Rows):
    """name -> function of a row number, from the definition of each feature."""
    fast_slow = [r.weighted(r.c, i, 12) - r.weighted(r.c, i, 26) for i in range(len(r.c))]
    ranges, flow = [r.true_range(i) for i in range(len(r.c))], r.signed_volume()

    def deviation(i):
        part = r.frame(r.c, i, 20)
        if part is None:
            return None
        mean = math.fsum(part) / 20
        return math.sqrt(math.fsum((x - mean) ** 2 for x in part) / 19)

    def band(i, side):
        return None if deviation(i) is None else r.mean(r.c, i, 20) + side * 2 * deviation(i)

    def williams(i):
        if i < 13:
            return None
        top, low = max(r.frame(r.h, i, 14)), min(r.frame(r.l, i, 14))
        return -100 * (top - r.c[i]) / (top - low + 1e-9)

    def year(values, i, pick):
        return None if i < 251 else pick(r.frame(values, i, 252))

    def balance(i):
        peak = year(flow, i, max)
        return None if peak is None else flow[i] / (abs(peak) if peak else 1.0)

    return {
        "SMA_10": lambda i: r.mean(r.c, i, 10), "SMA_50": lambda i: r.mean(r.c, i, 50), "SMA_200": lambda i: r.mean(r.c, i, 200),
        "MACD": lambda i: fast_slow[i], "MACD_signal": lambda i: r.weighted(fast_slow, i, 9), "RSI_14": r.strength,
        "MOM_5": lambda i: None if i < 5 else r.c[i] - r.c[i - 5], "ROC_21": lambda i: None if i < 21 else r.c[i] / r.c[i - 21] - 1,
        "Williams_R": williams, "ATR_14": lambda i: r.mean(ranges, i, 14), "BB_upper": lambda i: band(i, 1), "BB_lower": lambda i: band(i, -1),
        "BB_width": lambda i: None if i < 19 else (band(i, 1) - band(i, -1)) / r.mean(r.c, i, 20), "OBV_norm": balance,
        "Volume_SMA_20": lambda i: r.mean(r.v, i, 20),
        "pct_from_52w_high": lambda i: None if i < 251 else r.c[i] / year(r.h, i, max) - 1,
        "pct_from_52w_low": lambda i: None if i < 251 else r.c[i] / year(r.l, i, min) - 1,
    }


def test_columns_and_completeness(features):
    assert features.columns == ["ticker", "date", *FEATURES]
    assert features.count() == features.na.drop().count() > 100


def test_values_agree_with_their_definitions(ohlcv, market, to_bars):
    got = feature_columns(to_bars(ohlcv), market).orderBy("date").toPandas()
    for name, at in checks(Rows(ohlcv)).items():
        for i in [*range(0, 30), 49, 50, 141, 199, 200, 250, 251, 252, 300, 377, len(ohlcv) - 1]:
            want, have = at(i), got[name][i]
            assert (want is None and pd.isna(have)) or have == pytest.approx(want, rel=1e-7, abs=1e-7), (name, i)


# One candle before, one candle now (open, high, low, close), and the pattern's flag; the trend is set by the walk before.
CANDLES = [
    ("hammer", "falling", (90, 91, 88, 89), (88.0, 88.6, 84.0, 88.5), 1.0),
    ("hammer", "rising", (121, 123, 120, 122), (120.0, 120.6, 116.0, 120.5), 0.0),
    ("shooting_star", "rising", (121, 123, 120, 122), (122.0, 126.0, 121.9, 122.5), 1.0),
    ("shooting_star", "falling", (90, 91, 88, 89), (89.0, 93.0, 88.9, 89.5), 0.0),
    ("engulfing", "rising", (121, 122, 118, 119), (118.0, 124.0, 117.0, 123.0), 1.0),
    ("engulfing", "rising", (119, 122, 118, 121), (118.0, 124.0, 117.0, 123.0), 0.0),
    ("doji", "rising", (121, 122, 118, 119), (120.0, 122.0, 118.0, 120.1), 1.0),
]


@pytest.mark.parametrize("name, trend, before, now, want", CANDLES)
def test_candle_patterns(to_bars, market, name, trend, before, now, want):
    closes = np.linspace(100, 110, 60) if trend == "rising" else np.linspace(110, 100, 60)
    walk = [(c, c + 1, c - 1, c) for c in closes] + [before, now]
    bars = pd.DataFrame(walk, columns=["Open", "High", "Low", "Close"]).astype(float)
    bars = bars.assign(ticker="K", date=pd.bdate_range("2017-03-06", periods=len(bars)).date, Volume=1.0)
    assert feature_columns(to_bars(bars), market).orderBy(F.desc("date")).first()[name] == want


def test_early_filter_equals_dropping_incomplete_rows(ohlcv, market, to_bars):
    calm = ohlcv.copy()
    calm.loc[330:352, ["Open", "High", "Low", "Close"]] = [42.0, 43.0, 41.0, 42.0]  # no losing day: strength undefined
    bars = to_bars(calm)
    early, late = compute_features(bars, market), complete_rows(feature_columns(bars, market))
    assert early.count() == late.count() < len(calm) - 251
    assert early.exceptAll(late).count() == 0


@pytest.mark.parametrize("kept", [270, 333, 409])
@pytest.mark.parametrize("fate", ["gone", "shuffled"])
def test_rows_depend_on_the_past_only(ohlcv, market, to_bars, features, kept, fate):
    future = ohlcv.iloc[kept:].copy()
    if fate == "shuffled":
        values = ["Open", "High", "Low", "Close", "Volume"]
        future[values] = future[values].sample(frac=1, random_state=kept).to_numpy()
    other = pd.concat([ohlcv.iloc[:kept], future if fate == "shuffled" else future.iloc[:0]])
    last = F.lit(ohlcv.date[kept - 1])
    ours, theirs = (d.where(F.col("date") <= last).orderBy("date").toPandas() for d in (features, compute_features(to_bars(other), market)))
    assert len(ours) == len(theirs) > 0
    np.testing.assert_allclose(ours[FEATURES].astype(float), theirs[FEATURES].astype(float), rtol=1e-7, atol=1e-8)


def test_market_reaches_only_later_rows(ohlcv, market, to_bars):
    from_day = ohlcv.date[340]
    rows = compute_features(to_bars(ohlcv), market.where(F.col("date") >= F.lit(from_day)))
    assert rows.agg(F.min("date")).first()[0] >= from_day and rows.count() > 50


def test_no_market_means_no_complete_rows(ohlcv, to_bars):
    assert compute_features(to_bars(ohlcv)).count() == 0


def test_market_derivation(spark):
    days = pd.bdate_range("2019-05-01", periods=90).date
    index = spark.createDataFrame([(d, 200.0 * 1.01**i) for i, d in enumerate(days)], "date date, Close double")
    vol = spark.createDataFrame([(days[i], 10.0 + i) for i in (0, 4, 5, 30)], "date date, Close double")
    out = derive_market(index, vol).orderBy("date").toPandas()
    assert out.sp500_ret_21d.isna().sum() == 21 and out.sp500_ret_63d.isna().sum() == 63
    assert out.vix_close.tolist()[:7] == [10.0] * 4 + [14.0, 15.0, 15.0] and out.vix_close.tolist()[30:] == [40.0] * 60
    assert out.sp500_ret_63d[70] == pytest.approx(1.01**63 - 1)
