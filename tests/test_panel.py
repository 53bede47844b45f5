import numpy as np
import pandas as pd

from panelcast.config import ForecastConfig
from panelcast.operators.panel import build_panel, latest_rows, month_end_anchors, panel_from_features, sliding_windows, with_labels
from panelcast.schemas import FEATURES
from panelcast.sinks.tables import write_panel

from tests.conftest import make_ohlcv

SHORT = ForecastConfig(window=60, horizons={"1w": 5, "1m": 21})


def test_window_shapes_and_labels(features):
    base = features.orderBy("date").toPandas()
    w = sliding_windows(features, SHORT).orderBy("end_date").collect()
    assert len(w) == len(base) - 60 - 21 + 1
    assert len(w[0].X) == 60 and len(w[0].X[0]) == len(FEATURES)
    assert w[0].end_date == base.date[59]
    np.testing.assert_allclose(w[3].X, base.loc[3:62, FEATURES].to_numpy(), rtol=1e-5, atol=1e-6)
    assert abs(w[0].y_ret[0] - (base.Close[64] / base.Close[59] - 1)) < 1e-6


def test_labels_count_surviving_rows(features):
    kept = features.where("day(date) % 2 = 0")
    base = kept.orderBy("date").toPandas()
    cfg = ForecastConfig(window=10, horizons={"a": 3})
    out = with_labels(kept, cfg).orderBy("end_date").toPandas()
    np.testing.assert_allclose(out.y_a[0], base.Close[12] / base.Close[9] - 1)
    assert out.label_end[0] == base.date[12]


def test_panel_skips_bad_tickers_and_round_trips(spark, to_bars, market, tmp_path, ohlcv):
    bars = to_bars(pd.concat([ohlcv, make_ohlcv(60, 4, "TINY")]))
    panel = build_panel(bars, market, SHORT)
    assert {r.ticker for r in panel.select("ticker").distinct().collect()} == {"T0"}
    assert panel.columns == ["ticker", "end_date", *FEATURES, "y_1w", "y_1m", "base_close", "label_end", "month_end"]
    write_panel(panel, str(tmp_path / "panel"))
    back = spark.read.parquet(str(tmp_path / "panel"))
    assert back.count() == panel.count() and back.exceptAll(panel).count() == 0


def test_empty_panel_keeps_its_columns(features):
    empty = panel_from_features(features)  # too little history for the default settings
    assert empty.count() == 0 and "y_6m" in empty.columns


def test_anchors_and_latest_row(features):
    panel = panel_from_features(features, SHORT)
    days = panel.toPandas()
    want = days.groupby(pd.to_datetime(days.end_date).dt.to_period("M")).end_date.max()
    assert sorted(r.end_date for r in month_end_anchors(panel).collect()) == sorted(want)
    by_window = month_end_anchors(panel.drop("month_end"))
    assert sorted(r.end_date for r in by_window.collect()) == sorted(want)
    last = latest_rows(features, SHORT).collect()
    assert len(last) == 1 and last[0].end_date == features.agg({"date": "max"}).first()[0]
    assert last[0].end_date > days.end_date.max()
