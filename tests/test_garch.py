import numpy as np
import pandas as pd
import pytest

from panelcast.operators.garch import MOST_PERSISTENCE, garch_fit
from panelcast.operators.series_vol import GARCH_GRID


def simulated(omega, alpha, beta, n=1500, seed=4):
    rng, s, x, out = np.random.default_rng(seed), omega / (1 - alpha - beta), 0.0, []
    for _ in range(n):
        r = rng.normal(0, np.sqrt(s))
        out.append(r)
        s = omega + alpha * r * r + beta * s
    return np.array(out)


def path(r, omega, alpha, beta):
    s = [np.mean(r * r)]
    for x in r * r:
        s.append(omega + alpha * x + beta * s[-1])
    return np.array(s)


def loss(r, omega, alpha, beta):
    s = path(r, omega, alpha, beta)[:-1]
    return float(np.sum(np.log(s) + r * r / s))


TRUE = {"CALM": (2e-6, 0.06, 0.90), "ROUGH": (4e-5, 0.20, 0.70), "JUMPY": (1e-5, 0.15, 0.80)}


@pytest.fixture(scope="module")
def fitted(spark):
    series = {t: simulated(*p, seed=i) for i, (t, p) in enumerate(TRUE.items())}
    days = pd.bdate_range("2010-01-01", periods=1500).date
    rows = [(t, d, float(x)) for t, r in series.items() for d, x in zip(days, r)]
    rows += [("DEAD", d, 0.0) for d in days[:50]] + [("DEAD", days[60], None), ("ONE", days[0], 0.01)]
    df = spark.createDataFrame(rows, "ticker string, date date, r double")
    return series, garch_fit(df, 21).toPandas().set_index("ticker")


def test_loss_and_volatility_are_those_of_a_plain_recursion(fitted):
    series, got = fitted
    for t, r in series.items():
        p = got.loc[t, ["omega", "alpha", "beta"]].astype(float)
        assert got.loss[t] == pytest.approx(loss(r, *p), rel=1e-9)
        s, total = path(r, *p)[-1], 0.0
        for _ in range(21):
            total += s
            s = p.omega + (p.alpha + p.beta) * s
        assert got.volatility[t] == pytest.approx(np.sqrt(total), rel=1e-9)


def test_no_ticker_ends_below_the_grid(fitted):
    series, got = fitted
    for t, r in series.items():
        v = float(np.mean(r * r))
        targeted = min(loss(r, v * (1 - a - b), a, b) for a, b in GARCH_GRID if a + b < MOST_PERSISTENCE)
        assert got.loss[t] <= got.grid_loss[t] <= targeted + 1e-6


def test_search_is_as_good_as_a_fine_grid_at_its_beta(fitted):
    series, got = fitted
    for t, r in series.items():
        beta, v = got.beta[t], float(np.mean(r * r))
        fine = min(loss(r, v * m * (1 - a - beta), a, beta) for a in np.geomspace(0.01, 0.29, 25) if a + beta < MOST_PERSISTENCE
                   for m in np.geomspace(0.3, 3, 25))
        assert got.loss[t] <= fine + 0.05


def test_constant_term_beats_its_target_on_the_true_process(fitted):
    series, got = fitted
    for t, r in series.items():
        assert got.loss[t] <= loss(r, *TRUE[t]) + 1.0  # as likely as the process itself, but for the beta grid


def test_dead_short_and_empty_series(spark, fitted):
    got = fitted[1]
    assert got.volatility["DEAD"] == 0.0 and np.isnan(got.alpha["DEAD"])
    assert got.alpha["ONE"] > 0
    assert garch_fit(spark.createDataFrame([], "ticker string, date date, r double"), 21).count() == 0


def test_all_rounds_of_a_ticker_run_in_one_pass(spark):
    """No round is a scan of its own, and nothing is written between them."""
    import os

    from panelcast.plans.materialize import run_folder

    os.makedirs(run_folder(spark), exist_ok=True)
    before = set(os.listdir(run_folder(spark)))
    series = {t: simulated(*p, n=300, seed=i) for i, (t, p) in enumerate(TRUE.items())}
    rows = [(t, d, float(x)) for t, r in series.items() for d, x in zip(pd.bdate_range("2010-01-01", periods=300).date, r)]
    fit = garch_fit(spark.createDataFrame(rows, "ticker string, date date, r double"), 21)
    assert fit._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r.ticker: r for r in fit.collect()}
    for t, r in series.items():
        assert got[t].loss == pytest.approx(loss(r, got[t].omega, got[t].alpha, got[t].beta), rel=1e-9)
    assert set(os.listdir(run_folder(spark))) == before


def test_a_series_without_a_ticker_keeps_its_grid_point(spark):
    r = simulated(*TRUE["CALM"], n=200)
    rows = [(None, d, float(x)) for d, x in zip(pd.bdate_range("2010-01-01", periods=200).date, r)]
    got = garch_fit(spark.createDataFrame(rows, "ticker string, date date, r double"), 21).first()
    assert got.omega is None and got.alpha in (0.03, 0.05, 0.10, 0.18) and got.volatility == pytest.approx(np.std(r, ddof=1) * 21**0.5)
