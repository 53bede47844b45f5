"""Whole jobs on a small planted panel, and the registered queries against their SQL."""

import json
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.config import ForecastConfig
from panelcast.operators.trees import LeafQuantileForest
from panelcast.plans.training import run_backtest, run_export, run_training
from verification.compare import compare, connect

CFG = ForecastConfig(n_folds=2, min_names=3)
SMALL = "/root/testdata/sf0.001"
TICKERS = ("ALFA", "BETA", "GAMA", "DELT")


@pytest.fixture(scope="module")
def raw_bars(spark):
    """Bars of the planted panel's tickers, from a year before it to after its end."""
    from panelcast.schemas import BARS

    rng = np.random.default_rng(9)
    rows = []
    for t in TICKERS:
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 1300)))
        for d, p in zip(pd.bdate_range("2013-05-01", periods=1300), price):
            rows.append((t, d.date(), *[float(p)] * 4, 1000.0))
    return spark.createDataFrame(rows, BARS)


@pytest.fixture(scope="module")
def training(planted_panel, raw_bars, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("artifacts"))
    return run_training(planted_panel, raw_bars, CFG, out, LeafQuantileForest(CFG, trees=5, depth=3)), out


def test_training_scores_every_model(spark, training):
    t, out = training
    got = {(r.model, r.horizon): r for r in t.scores.collect()}
    assert {m for m, _ in got} == {"random_walk", "baseline", "gbm", "series_vol", "ensemble"} and len(got) == 15
    assert got[("random_walk", "1m")].ic is None
    assert got[("gbm", "1m")].pinball < got[("baseline", "1m")].pinball and got[("gbm", "1m")].ic > 0.3
    assert all(0 <= r.coverage <= 1 for r in got.values())
    doc = json.loads("\n".join(r.value for r in spark.read.text(f"{out}/metrics").collect()))
    assert set(doc) >= {"gbm", "ensemble", "blend_weight", "conformal_delta"}
    assert spark.read.parquet(f"{out}/feature_reference").count() == 35


def test_training_without_bars_skips_the_ensemble(planted_panel):
    t = run_training(planted_panel, None, CFG, None, LeafQuantileForest(CFG, trees=2, depth=2))
    assert {r.model for r in t.scores.collect()} == {"random_walk", "baseline", "gbm"} and t.params is None


def test_backtest_job_writes_its_files(spark, planted_panel, tmp_path):
    report = run_backtest(planted_panel, CFG, str(tmp_path), forest=LeafQuantileForest(CFG, trees=5, depth=3)).first()
    assert report.n_months > 10 and len(report.dates) == report.n_months
    assert json.loads(spark.read.text(str(tmp_path / "backtest")).first().value)["n_months"] == report.n_months
    assert spark.read.json(str(tmp_path / "stock_track")).count() == len(TICKERS)


@pytest.mark.parametrize("blended", [True, False])
def test_export_job(spark, training, planted_panel, raw_bars, tmp_path, blended):
    _, artifacts = training
    features = planted_panel.withColumnRenamed("end_date", "date")
    out = run_export(spark, features, raw_bars, artifacts, str(tmp_path), None, CFG, use_series_model=blended)
    assert out.count() == 3 * len(TICKERS) and out.where("q10 > q50 or q50 > q90").count() == 0
    recs = spark.read.json(str(tmp_path / "forecasts"))
    assert recs.count() == spark.read.json(str(tmp_path / "prices")).count() == len(TICKERS)
    assert "gbm" in spark.read.text(str(tmp_path / "metrics"), wholetext=True).first().value


SAMPLE = ["bars_daily", "bars_walk", "quality_repair", "market_series", "feat_ewm", "panel", "cv_roles", "m_hist_quantile",
          "ens_params", "metrics_scoreboard", "bt_stats", "view_holdings"]


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries

    ours = queries()[name](spark, SMALL).toPandas()
    assert len(ours) > 0
    assert compare(ours, duck.execute(oracle_sql()[name]).df()) == "ok"


@pytest.mark.parametrize("name", ["m_series_paths_anchors", "windows_tensor_full"])
def test_full_path_and_window_queries_match_their_sql(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries

    ours = queries()[name](spark, SMALL).toPandas()
    assert ours.groupby("ticker").end_date.nunique().min() > 12  # many anchors or windows for each ticker
    assert compare(ours, duck.execute(oracle_sql()[name]).df()) == "ok"


def test_bars_of_other_tickers_are_an_error(spark, planted_panel, raw_bars):
    with pytest.raises(ValueError, match="no ticker of the panel has bars"):
        run_training(planted_panel, raw_bars.withColumn("ticker", F.lit("ELSE")), CFG)


# Queries without SQL, and the tests that hold them against something else.
WITHOUT_SQL = {
    "m_leaf_forest": "tests/test_models.py", "m_boosted": "tests/test_models.py", "m_garch_fit": "tests/test_garch.py",
    "op1_licenses": "tests/llm/test_text_operators.py", "op2_quality_gam": "tests/llm/test_models.py",
    "op3_secrets": "tests/llm/test_text_operators.py", "op4_fingerprints": "tests/llm/test_fingerprints.py",
    "op5_bpe": "tests/llm/test_text_operators.py", "op7_html": "tests/llm/test_models.py",
    "op13_toxicity": "tests/llm/test_toxicity.py", "pipeline": "tests/llm/test_pipeline.py",
}


def test_queries_without_sql_are_the_known_ones():
    from __spark_entry__ import oracle_sql, queries

    without = set(queries()) - set(oracle_sql())
    assert without <= set(WITHOUT_SQL)
    assert all((Path(__file__).parent.parent / WITHOUT_SQL[q]).exists() for q in without)
