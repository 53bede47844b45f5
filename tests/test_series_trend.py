import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.config import ForecastConfig
from panelcast.operators.series_trend import DRIFT_GRID, STATE, SeriesTrend, drift_paths, drift_states
from panelcast.operators.series_vol import SeriesVol, paths_to_returns

CFG = ForecastConfig()


def walks(kind: str, n: int = 700, count: int = 6, seed: int = 8) -> pd.DataFrame:
    """Log-price series: independent moves, a slowly turning drift, or moves that are partly taken back."""
    rng, out = np.random.default_rng(seed), []
    for k in range(count):
        e = rng.normal(0, 0.01, n)
        r = e.copy()
        if kind == "trend":
            drift = 0.0
            for t in range(n):
                r[t] = 0.97 * drift + e[t]
                drift = 0.97 * drift + 0.05 * e[t]
        elif kind == "back":
            r[1:] -= 0.3 * e[:-1]
        out.append(pd.DataFrame({"ticker": f"{kind}{k}", "date": pd.bdate_range("2015-01-01", periods=n).date, "Close": 50 * np.exp(np.cumsum(r))}))
    return pd.concat(out, ignore_index=True)


def plain_state(close: np.ndarray, rows: int = 252):
    """(phi, beta, drift, sigma) after the last close, step by step."""
    r, found = np.diff(np.log(close)), []
    for phi, beta in ((0.0, 0.0), *DRIFT_GRID):
        b, errors = 0.0, []
        for x in r:
            e = x - phi * b
            b = phi * b + beta * e
            errors.append(e)
        found.append((float(np.square(errors).sum()), phi, beta, b, float(np.sqrt(np.square(errors[-rows:]).sum() / rows))))
    best = min(found[1:])
    n = len(r)
    return (best if n * np.log(best[0] / found[0][0]) + 2 * np.log(n) < 0 else found[0])[1:]


@pytest.mark.parametrize("kind", ["still", "trend", "back"])
def test_states_are_those_of_a_plain_recursion(spark, kind):
    data = walks(kind, count=3)
    got = drift_states(spark.createDataFrame(data)).toPandas().sort_values("date").groupby("ticker").last()
    for ticker, one in data.groupby("ticker"):
        np.testing.assert_allclose(got.loc[ticker, STATE[1:]].astype(float), plain_state(one.Close.to_numpy()), rtol=1e-7, atol=1e-12)
    assert (got.phi > 0).any() == (kind != "still")


def test_no_state_sees_a_later_row(spark):
    data = walks("trend", count=2)
    cut = data.date.iloc[500]
    changed = data.assign(Close=np.where(data.date > cut, 3.0, data.Close))
    before, after = (drift_states(spark.createDataFrame(d)).where(F.col("date") <= cut).toPandas().sort_values(["ticker", "date"]) for d in (data, changed))
    pd.testing.assert_frame_equal(before.reset_index(drop=True), after.reset_index(drop=True))


def test_closed_forms_are_those_of_simulated_steps(spark):
    phi, beta, drift, sigma, n = 0.9, 0.15, 0.02, 0.01, 200_000
    rng = np.random.default_rng(3)
    level, b = np.zeros(n), np.full(n, drift)
    state = spark.createDataFrame([("A", 4.0, phi, beta, drift, sigma)], "ticker string, log_price double, phi double, beta double, drift double, sigma double")
    paths = drift_paths(state.withColumn("end_date", F.lit("2020-01-31").cast("date")), 20, CFG).orderBy("step").collect()
    assert [p.step for p in paths] == list(range(1, 21))
    for p in paths:
        e = rng.normal(0, sigma, n)
        level += phi * b + e
        b = phi * b + beta * e
        np.testing.assert_allclose(np.array(p.path) - 4.0, np.quantile(level, CFG.quantiles), atol=4 * level.std() / np.sqrt(n) * 2)


def test_pinball_is_no_worse_on_walks_and_better_where_moves_follow_each_other(spark):
    """Mean loss of both series models a month ahead, from every tenth day on."""
    data = pd.concat([walks(k, count=12) for k in ("still", "trend", "back")], ignore_index=True)
    bars = spark.createDataFrame(data)
    later = data.assign(y=data.groupby("ticker").Close.shift(-21) / data.Close - 1).dropna()
    rows = spark.createDataFrame(later.groupby("ticker").nth(list(range(260, 679, 10)))[["ticker", "date", "y"]].rename(columns={"date": "end_date"}))
    rows = rows.withColumn("horizon", F.lit("1m"))
    both = SeriesTrend(CFG).fit(bars).predict(SeriesVol(CFG).fit(bars).predict(rows)).toPandas()
    q, loss = np.array(CFG.quantiles), {}
    for model in ("series_vol", "series_trend"):
        miss = both.y.to_numpy()[:, None] - np.array(both[model].tolist())
        loss[model] = pd.Series(np.maximum(q * miss, (q - 1) * miss).mean(axis=1)).groupby(both.ticker.str.rstrip("0123456789")).mean()
    ratio = loss["series_trend"] / loss["series_vol"]
    assert ratio["still"] <= 1.01 and ratio["trend"] < 1 and ratio["back"] < 1, ratio.to_dict()


def test_paths_read_at_the_horizons_are_the_predictions(spark):
    bars = spark.createDataFrame(walks("trend", count=2))
    last = drift_states(bars).groupBy("ticker").agg(F.max_by(F.struct("date", *STATE), "date").alias("s")).select("ticker", "s.*").withColumnRenamed("date", "end_date")
    read = paths_to_returns(drift_paths(last, list(CFG.horizons.values()), CFG), CFG)
    predicted = SeriesTrend(CFG).fit(bars).predict(read.select("ticker", "end_date", "horizon"))
    for r in read.join(predicted, ["ticker", "end_date", "horizon"]).collect():
        np.testing.assert_allclose(r.q, r.series_trend, rtol=1e-9)


def test_short_dead_null_and_empty_series(spark):
    days = pd.bdate_range("2015-01-01", periods=300).date
    data = [("DEAD", d, 5.0) for d in days] + [("SHORT", d, 5.0 + i % 3) for i, d in enumerate(days[:100])]
    data += [("HOLES", d, [None, 0.0, -1.0][i % 3] if i % 5 == 0 else 9.0 + i % 2) for i, d in enumerate(days)]
    bars = spark.createDataFrame(data, "ticker string, date date, Close double")
    rows = spark.createDataFrame([(t, days[-1], "1m") for t in ("DEAD", "SHORT", "HOLES", "NONE")], "ticker string, end_date date, horizon string")
    got = {r.ticker: r.series_trend for r in SeriesTrend(CFG).fit(bars).predict(rows).collect()}
    assert got["DEAD"] == [0.0, 0.0, 0.0]
    assert all(v is None for t in ("SHORT", "HOLES", "NONE") for v in got[t])
    assert drift_states(bars.limit(0)).count() == 0
