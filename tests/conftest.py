import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("panelcast-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def make_ohlcv(n: int = 430, seed: int = 21, ticker: str = "T0", start: str = "2017-03-06") -> pd.DataFrame:
    """A log-price walk in quiet and rough spells, with a two-week halt and a move at each reopening.

    Days of the halt are missing, so dates are not evenly spaced.
    """
    rng = np.random.default_rng(seed)
    spell = np.where(np.arange(n) // 45 % 2 == 0, 0.006, 0.02)
    log_close = np.log(40.0) + np.cumsum(rng.laplace(0, spell))
    log_open = np.r_[log_close[0], log_close[:-1]] + rng.normal(0, 0.004, n)
    reach = rng.exponential(0.008, (2, n))
    days = pd.bdate_range(start, periods=n + 10)
    return pd.DataFrame({
        "ticker": ticker,
        "date": np.delete(days, np.arange(n // 3, n // 3 + 10)).date if n > 30 else days[:n].date,
        "Open": np.exp(log_open),
        "High": np.exp(np.maximum(log_open, log_close) + reach[0]),
        "Low": np.exp(np.minimum(log_open, log_close) - reach[1]),
        "Close": np.exp(log_close),
        "Volume": np.floor(np.exp(rng.normal(11, 0.7, n))),
    })


def make_market(n: int = 600, start: str = "2016-11-01") -> pd.DataFrame:
    """An index growing with a yearly swing, and a volatility that reverts to its mean."""
    rng = np.random.default_rng(5)
    t = np.arange(n)
    level = pd.Series(900 * np.exp(0.0003 * t + 0.05 * np.sin(t / 40) + rng.normal(0, 0.003, n)))
    vix = 18 + np.convolve(rng.normal(0, 1.2, n), 0.9 ** np.arange(60))[:n]
    return pd.DataFrame({
        "date": pd.bdate_range(start, periods=n).date,
        "vix_close": np.abs(vix) + 5,
        "sp500_ret_21d": level / level.shift(21) - 1,
        "sp500_ret_63d": level / level.shift(63) - 1,
    }).astype(object).where(lambda d: d.notna(), None)


@pytest.fixture(scope="session")
def ohlcv():
    return make_ohlcv()


@pytest.fixture(scope="session")
def market(spark):
    from panelcast.schemas import MARKET

    return spark.createDataFrame(make_market().to_records(index=False).tolist(), MARKET).cache()


@pytest.fixture(scope="session")
def to_bars(spark):
    from panelcast.schemas import BARS

    def convert(pdf: pd.DataFrame):
        rows = pdf[BARS.fieldNames()].astype(object).where(pdf.notna(), None)
        return spark.createDataFrame(rows.to_records(index=False).tolist(), BARS)

    return convert


@pytest.fixture(scope="session")
def features(spark, ohlcv, market, to_bars):
    from panelcast.operators.features import compute_features

    return compute_features(to_bars(ohlcv), market).cache()


@pytest.fixture(scope="session")
def planted_panel(spark):
    """Four tickers of unequal length; all labels rise with the first feature and scatter more at longer horizons."""
    from panelcast.plans.materialize import materialize
    from panelcast.schemas import FEATURES, panel_schema

    rng = np.random.default_rng(17)
    rows = []
    for k, ticker in enumerate(("ALFA", "BETA", "GAMA", "DELT")):
        days = pd.bdate_range("2014-06-02", periods=760 + 60 * k)
        x = rng.uniform(-1.8, 1.8, (len(days), len(FEATURES)))
        for i, d in enumerate(days):
            y = [float(0.025 * x[i, 0] + rng.logistic(0, 0.006 * (h + 1))) for h in range(3)]
            rows.append((ticker, d.date(), *map(float, x[i]), *y, 50.0 + k))
    return materialize(spark.createDataFrame(rows, panel_schema()), "planted")
