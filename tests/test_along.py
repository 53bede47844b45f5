"""Series worked on whole, in one pass."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.config import ForecastConfig
from panelcast.functions.numbers import rounded_double
from panelcast.functions.vectors import decayed, ewm, powers_of, rolling_deviation, rolling_extreme, rolling_sum, shifted
from panelcast.functions.windows import Rolling, in_blocks, series, with_ewm, with_rolling
from panelcast.operators.features import compute_features, flagged_columns
from panelcast.operators.panel import modelling_table, panel_from_features, sliding_windows
from panelcast.operators.quality import clean
from panelcast.plans.along import along_series, doubles
from panelcast.schemas import FEATURES
from tests.conftest import make_ohlcv

SHORT = ForecastConfig(window=30, horizons={"a": 2, "b": 5}, min_rows=100)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_match_pandas():
    x = np.random.default_rng(9).normal(50, 20, 900)
    x[300] = np.nan
    s = pd.Series(x)
    for n in (1, 2, 7, 14, 20, 50, 200, 252):
        np.testing.assert_allclose(rolling_sum(x, n), s.rolling(n).sum(), rtol=1e-12)
        np.testing.assert_array_equal(rolling_extreme(x, np.maximum, n), s.rolling(n).max())
        np.testing.assert_array_equal(rolling_extreme(x, np.minimum, n), s.rolling(n).min())
    np.testing.assert_allclose(rolling_deviation(x, 20), s.rolling(20).std(), rtol=1e-9)
    np.testing.assert_allclose(ewm(x[301:], 26), s[301:].ewm(span=26, adjust=False).mean(), rtol=1e-12)
    assert np.isnan(ewm(x[300:], 12)[0]) and len(decayed(x[:0], 0.9)) == 0
    np.testing.assert_array_equal(shifted(x[:3], -5), [np.nan] * 3)


def test_vectors_are_the_windows_to_the_last_bit(spark):
    """The forest draws rows by a hash of their features."""
    x = np.round(np.random.default_rng(3).normal(50, 20, 1100), 4)
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], "ticker string, date int, x double")
    rolled = with_rolling(df, [Rolling(f"s{n}", "sum", "x", n) for n in (10, 14, 20, 50, 200)], series())
    sd = rolled.withColumn("sd", F.when(F.col("date") >= 19, F.stddev_samp("x").over(series().rowsBetween(-19, 0))))
    got = with_ewm(in_blocks(sd), [("e9", "x", 9), ("e26", "x", 26)]).orderBy("date").toPandas()
    for n in (10, 14, 20, 50, 200):
        np.testing.assert_array_equal(got[f"s{n}"].to_numpy(float), rolling_sum(x, n))
    np.testing.assert_array_equal(got.sd.to_numpy(float), rolling_deviation(x, 20))
    for n in (9, 26):
        np.testing.assert_array_equal(got[f"e{n}"].to_numpy(float), ewm(x, n, powers_of(spark, (9, 26))))


def test_a_series_is_whole_however_batches_are_cut(spark):
    rows = [(k, date(2024, 1, 1) + timedelta(days=i), float(i)) for k, n in (("A", 25), (None, 7), ("B", 1), ("C", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "ticker string, date date, x double").repartition(5)

    def ends(s):
        return None if len(s["x"]) == 1 else {"date": s["date"][-1:], "n": np.array([len(s["x"])]), "up": np.array([(np.diff(s["x"]) > 0).all()])}

    fields = [df.schema["date"], *doubles(["n"]), spark.range(1).select((F.col("id") > 0).alias("up")).schema["up"]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.ticker: (r.date.day, r.n, r.up) for r in along_series(df, ends, fields).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {"A": (25, 25.0, True), None: (7, 7.0, True), "C": (9, 40.0, True)}


def test_features_and_labels_are_one_pass_over_the_bars(spark, to_bars, market):
    """A window over every bar costs more than all features of it do here."""
    table = modelling_table(compute_features(clean(to_bars(make_ohlcv()), SHORT), market), SHORT)
    plan = plan_of(table)
    assert plan.count("MapInArrow") == 1 and plan.count("Window [") <= 4 and plan.count("Exchange hashpartitioning") == 1
    assert "Window [" not in plan[: plan.index("MapInArrow")]


def test_one_pass_is_equal_to_two(spark, to_bars, market, ohlcv):
    bars = to_bars(pd.concat([ohlcv, make_ohlcv(380, 3, "T1")]))
    features = compute_features(bars, market)
    apart = modelling_table(features.where("true").select("*"), SHORT)
    fused = modelling_table(features, SHORT)
    assert fused.count() == apart.count() > 100 and fused.exceptAll(apart).isEmpty()
    flagged = modelling_table(flagged_columns(bars, market), SHORT)
    assert flagged.count() == bars.count() and flagged.where("complete").exceptAll(fused).isEmpty()
    panel = panel_from_features(features, SHORT)
    last = fused.where("row = n_rows - 5").select("ticker", F.col("date").alias("end_date"))
    assert panel.join(last, ["ticker", "end_date"]).where("month_end").count() == 2


def test_windows_are_cut_from_steps_stacked_once(spark, features):
    w = sliding_windows(features, SHORT)
    assert "collect_list" not in plan_of(w)
    rows = features.orderBy("date").toPandas()
    got = w.orderBy("end_date").collect()
    assert len(got) == len(rows) - 30 + 1 - 5
    for i in (0, len(got) - 1):
        np.testing.assert_array_equal(np.array(got[i].X, np.float32), rows[FEATURES].to_numpy(np.float32)[i : i + 30])
        close = rows["Close"].to_numpy()
        np.testing.assert_allclose(got[i].y_ret, [close[i + 29 + h] / close[i + 29] - 1 for h in (2, 5)], rtol=1e-6)
        assert got[i].end_date == rows["date"][i + 29]


@pytest.mark.parametrize("digits", [2, 4, 8])
def test_quick_rounding_is_roundings_own(spark, digits):
    odd = [0.0, -0.0, 0.5, -0.5, 0.00005, 0.66375, -1e-9, 1e17, 123456.789, float("nan"), float("inf"), None]
    x = spark.createDataFrame([(v,) for v in odd], "x double").union(spark.range(3000).select(F.round(F.randn(1) * 1000, 5)))
    both = x.select(F.round("x", digits).cast("string").alias("a"), rounded_double("x", digits).cast("string").alias("b"))
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()
    assert "CASE WHEN" in plan_of(x.select(rounded_double("x", digits)))
