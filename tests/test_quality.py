"""The gate, the repair and what becomes of bad series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.config import ForecastConfig
from panelcast.operators.features import compute_features
from panelcast.operators.panel import build_panel
from panelcast.operators.quality import (
    TOO_MANY_NULLS, clean, enough_history, rejects, short_history, skip_report,
)
from panelcast.sinks.tables import write_bars
from panelcast.sources.bars import normalise_symbol, read_bars, tidy_bars
from tests.conftest import make_ohlcv

VALUES = ["Open", "High", "Low", "Close", "Volume"]


def in_order(df):
    return df.orderBy("ticker", "date").toPandas()


@pytest.mark.parametrize("share, passes", [(0.0, True), (0.02, True), (0.05, True), (0.06, False), (0.4, False)])
@pytest.mark.parametrize("missing", [None, float("nan")])
def test_share_of_missing_closes(to_bars, share, passes, missing):
    series = make_ohlcv(300, seed=int(100 * share))
    gaps = np.random.default_rng(1).choice(300, int(300 * share), replace=False)
    at = F.col("date").isin([series.date[i] for i in gaps]) if len(gaps) else F.lit(False)
    bars = to_bars(series).withColumn("Close", F.when(at, F.lit(missing).cast("double")).otherwise(F.col("Close")))
    assert clean(bars).count() == (300 - len(gaps) if passes else 0)


def test_every_reason_is_reported_once(spark, to_bars, market):
    wild = make_ohlcv(430, 3, "WILD")  # repaired, and kept
    wild["Close"] = np.resize([50.0, 300.0, 80.0, 20.0], 430)
    bare = make_ohlcv(240, 8, "BARE")  # passes the gate, and has no complete feature row
    holes = make_ohlcv(430, 4, "HOLES")
    holes.loc[np.arange(0, 430, 7), "Close"] = np.nan
    bars = to_bars(pd.concat([wild, holes, make_ohlcv(90, 5, "BRIEF"), make_ohlcv(230, 6, "YOUNG"), make_ohlcv(430, 7, "FINE"), bare]))
    cfg = ForecastConfig(window=60, horizons={"1m": 21})
    universe = spark.createDataFrame([(t,) for t in ("WILD", "HOLES", "BRIEF", "YOUNG", "FINE", "BARE", "NOWHERE")], "ticker string")
    features = compute_features(clean(bars, cfg), market)
    found = skip_report(bars, features, universe, cfg).collect()
    reasons = {r.ticker: r.reason for r in found}
    assert len(found) == len(reasons)
    young = features.where("ticker = 'YOUNG'").count()
    assert reasons["HOLES"] == TOO_MANY_NULLS and reasons["BRIEF"] == f"90 usable rows of {cfg.min_rows}" and reasons["NOWHERE"] == "no bars"
    assert reasons["BARE"] == f"0 feature rows of {cfg.min_feature_rows}" and not {"WILD", "FINE"} & set(reasons) and ("YOUNG" not in reasons or young < cfg.min_feature_rows)


def test_negative_and_zero_closes_go(to_bars):
    series = make_ohlcv(260, 9)
    series.loc[[31, 77, 200], "Close"] = [0.0, -3.5, -1e-9]
    out = in_order(clean(to_bars(series)))
    assert out.date.tolist() == series.drop([31, 77, 200]).date.tolist()


@pytest.mark.parametrize("seed", range(4))
def test_repair_against_a_running_product(to_bars, seed):
    rng = np.random.default_rng(seed)
    series = make_ohlcv(250, seed)
    places = np.sort(rng.choice(np.arange(1, 250), 3, replace=False))
    for p in places:  # a lasting jump, up or down
        series.loc[p:, "Close"] *= rng.choice([0.2, 0.4, 1.8, 4.0])
    want, previous = [series.Close[0]], series.Close[0]
    for c in series.Close[1:]:
        want.append(want[-1] * (1 + min(0.5, max(-0.5, c / previous - 1))))
        previous = c
    out = in_order(clean(to_bars(series)))
    np.testing.assert_allclose(out.Close, want, rtol=1e-9)
    for row, old in zip(out.itertuples(), series.itertuples()):
        assert row.High == pytest.approx(max(old.Open, old.High, old.Low, row.Close)) and row.Low == pytest.approx(min(old.Open, old.High, old.Low, row.Close))
        assert (row.Open, row.Volume) == (old.Open, old.Volume)


def test_calm_series_pass_bit_by_bit(to_bars):
    series = make_ohlcv(280, 12)
    assert clean(to_bars(series)).exceptAll(to_bars(series)).count() == 0 and clean(to_bars(series)).count() == 280


def test_bad_neighbours_leave_a_good_series_alone(to_bars, market):
    good, cfg = make_ohlcv(430, 13, "GOOD"), ForecastConfig(window=60, horizons={"1m": 21})
    falling = make_ohlcv(430, 14, "FALLS")
    falling["Close"] = 100 * 0.94 ** np.arange(430)
    falling.loc[5, "Close"] *= 0.3  # one spike, so the whole series is rebuilt
    patchy = make_ohlcv(430, 15, "PATCHY")
    patchy.loc[215, "High"] = np.nan
    alone = build_panel(to_bars(good), market, cfg)
    together = build_panel(to_bars(pd.concat([falling, good, patchy])), market, cfg)
    ours = together.where("ticker = 'GOOD'")
    assert ours.count() == alone.count() > 0 and ours.exceptAll(alone).count() == 0
    patched = in_order(clean(to_bars(patchy)))
    assert len(patched) == 429 and not patched[VALUES].isna().any().any()


def test_vanishing_and_soaring_series_are_kept(to_bars):
    down, up = make_ohlcv(1500, 16, "DOWN"), make_ohlcv(2500, 17, "UP")
    down["Close"] = np.maximum(100 * 0.4 ** np.arange(1500), 1e-300)
    up["Close"] = np.minimum(100 * 1.9 ** np.arange(2500), 1e300)
    for series, factor in ((down, 0.5), (up, 1.5)):
        out = in_order(clean(to_bars(series)))
        old = series.Close.to_numpy()
        steps = np.log(np.r_[1.0, np.where(np.abs(old[1:] / old[:-1] - 1) > 0.5, factor, old[1:] / old[:-1])])
        want = np.clip(np.log(old[0]) + np.cumsum(steps), -700, 700)
        assert len(out) == len(series) and (out.Close > 0).all() and np.isfinite(out.Close).all()
        np.testing.assert_allclose(np.log(out.Close), want, rtol=1e-9)


def test_build_job_reads_everything_from_one_table(spark, to_bars, market, tmp_path):
    from panelcast.operators.panel import latest_of, latest_rows, panel_from_features
    from panelcast.plans.training import run_build

    cfg = ForecastConfig(window=60, horizons={"1w": 5, "1m": 21})
    bars = to_bars(pd.concat([make_ohlcv(430, 3, "A"), make_ohlcv(410, 4, "B"), make_ohlcv(210, 5, "C")]))
    built = run_build(bars, market, None, cfg, str(tmp_path))
    features = compute_features(clean(bars, cfg), market)
    want = panel_from_features(features, cfg)
    assert built.panel.columns == want.columns and want.count() > 100
    assert built.panel.exceptAll(want).count() == want.exceptAll(built.panel).count() == 0
    assert latest_of(built.table, cfg).exceptAll(latest_rows(features, cfg)).count() == 0 and latest_of(built.table, cfg).count() == 2
    assert [r.ticker for r in built.skipped.collect()] == ["C"] and spark.read.json(str(tmp_path / "skipped")).count() == 1
    assert spark.read.parquet(str(tmp_path / "panel")).count() == want.count()


def test_history_gate(features):
    short = ForecastConfig(window=60, horizons={"1m": 21})
    n = features.count()
    assert enough_history(features, short).count() == n and enough_history(features).count() == 0
    assert short_history(features).first().reason == f"{n} feature rows of {ForecastConfig().min_feature_rows}"


def test_incomplete_rows_are_untidy(to_bars, ohlcv):
    at = F.col("date") == F.lit(ohlcv.date[17])
    for column in VALUES:
        raw = to_bars(ohlcv).withColumn(column, F.when(at, float("nan")).otherwise(F.col(column)))
        assert tidy_bars(raw).count() == len(ohlcv) - 1


def test_symbols_and_bar_cache(spark, to_bars, tmp_path):
    assert [spark.range(1).select(normalise_symbol(F.lit(s))).first()[0] for s in ("rds.a", "x", "A.b.C")] == ["RDS-A", "X", "A-B-C"]
    one, two = make_ohlcv(50, 1, "AB"), make_ohlcv(70, 2, "CD")
    bars = to_bars(pd.concat([one, two]))
    write_bars(bars, str(tmp_path / "cache"))
    back = read_bars(spark, str(tmp_path / "cache"))
    assert back.exceptAll(bars).count() == 0 and back.count() == 120
    (tmp_path / "files").mkdir()
    for name, part in (("AB", one), ("CD", two)):
        part.drop(columns="ticker").to_parquet(tmp_path / "files" / f"{name}.parquet", index=False)
    named = read_bars(spark, str(tmp_path / "files"), ticker_from_file=True)
    assert {r.ticker: r["count"] for r in named.groupBy("ticker").count().collect()} == {"AB": 50, "CD": 70}


def test_rejects_need_no_universe(to_bars):
    assert [r.ticker for r in rejects(to_bars(make_ohlcv(40, ticker="TINY"))).collect()] == ["TINY"]


def test_clean_is_gate_and_repair_with_one_window_less(spark):
    """Spikes, missing and negative closes, incomplete rows and rows without ticker or date."""
    import datetime as dt
    import random

    from panelcast.operators import quality
    from panelcast.schemas import OHLCV

    draw = random.Random(3)
    rows = []
    for ticker in ("A", "B", "C", None):
        for i in range(260):
            close = 100 * 1.01 ** (i % 40) * (5.0 if ticker == "B" and i in (50, 51, 200) else 1.0)
            odd = draw.random()
            close = None if odd < 0.02 else -close if odd < 0.04 else float("nan") if odd < 0.05 else close
            day = None if i == 30 and ticker != "C" else dt.date(2020, 1, 1) + dt.timedelta(days=i)
            rows.append((ticker, day, 1.0, None if odd > 0.97 else 200.0, 0.5, close, 10.0))
    bars = spark.createDataFrame(rows, "ticker string, date date, Open double, High double, Low double, Close double, Volume double")
    want = quality.repair(quality.gate(quality.without_nan(bars)).na.drop(subset=OHLCV))
    got = quality.clean(bars)
    assert got.columns == want.columns and got.count() == want.count() > 600
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plans = [df._jdf.queryExecution().optimizedPlan().toString().count("Window [") for df in (got, want)]
    assert plans == [2, 3]
