import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from panelcast.operators import views
from panelcast.sinks.documents import flat_metrics, metrics_document, model_card, write_model_card, write_one_document, write_records
from panelcast.sources.reference_data import constituents, read_metrics_params

DAY = dt.date(2026, 1, 2)


@pytest.fixture(scope="module")
def rows(spark):
    meta = spark.createDataFrame([("AA", "Alpha", "Tech"), ("BB", "Beta corp", "Energy")], "ticker string, name string, sector string")
    data = [(t, DAY, 100.0 + i, h, [-0.1 * k, 0.01 * (i + k), 0.2 * k]) for i, t in enumerate(("BB", "AA", "CC")) for k, h in enumerate(("1m", "3m", "6m"), 1)]
    latest = spark.createDataFrame(data, "ticker string, end_date date, base_close double, horizon string, q array<double>")
    return views.forecast_rows(latest, "q", meta).cache()


def test_records_have_labels_and_horizons(rows):
    recs = {r.ticker: r for r in views.forecast_records(rows).collect()}
    assert recs["CC"].name == "CC" and recs["CC"].sector == "Unknown" and recs["AA"].sector == "Tech"
    assert recs["BB"].anchor_date == "2026-01-02" and recs["BB"].horizons["6m"].q90 == pytest.approx(0.6)


def test_screener_filters_and_orders(rows):
    got = [r.ticker for r in views.screen(rows).orderBy("position").collect()]
    assert got == ["CC", "AA", "BB"]
    assert [r.ticker for r in views.screen(rows, descending=False).orderBy("position").collect()] == got[::-1]
    assert [r.ticker for r in views.screen(rows, search=" beta ").collect()] == ["BB"]
    assert [r.ticker for r in views.screen(rows, sector="Tech").collect()] == ["AA"]
    assert views.screen(rows, sector="Tech", search="beta").count() == 0
    assert [(r.ord, r.sector) for r in views.sector_options(rows).orderBy("ord").collect()] == [(0, "All"), (1, "Energy"), (2, "Tech"), (3, "Unknown")]
    assert views.shared_scale(rows.where("horizon = '3m'")).first().scale == pytest.approx(0.4)
    assert views.shared_scale(rows.where("false")).first().scale == 0.01


def test_holdings_round_half_up(rows):
    got = {(r.side, r.place): r.ticker for r in views.holdings(rows, 0.5).collect()}  # 1.5 names -> 2
    assert got == {("long", 1): "CC", ("long", 2): "AA", ("short", 1): "BB", ("short", 2): "AA"}
    assert views.holdings(rows, 0.01).count() == 2


def test_lookup_and_options(rows):
    pick = lambda *a: {r.ticker for r in views.find_forecast(rows, *a).collect()}
    assert pick("bb") == {"BB"} and pick("zz", "CC") == {"CC"} and pick("zz") == {"AA"}
    one = rows.where("horizon = '1m'")
    assert [r.ticker for r in views.search_options(one, "ENERGY").collect()] == ["BB"]
    assert [r.ticker for r in views.search_options(one, "", 2).collect()] == ["AA", "BB"]


def test_price_views(spark, rows):
    bars = spark.createDataFrame(
        [("AA", DAY - dt.timedelta(days=i), None if i == 3 else 100.0 - i) for i in range(200)] + [("ZZ", DAY, 1.0)],
        "ticker string, date date, Close double",
    )
    hist = views.price_history(bars, rows.select("ticker").distinct())
    arrays = views.price_arrays(hist).first()
    assert len(arrays.dates) == 180 and arrays.dates[-1] == "2026-01-02" and arrays.close[-1] == 100.0
    tail = views.chart_tail(hist)
    assert {r.day for r in tail.collect()} == set(range(-119, 1))
    fan = views.price_fan(rows)
    aa = {r.day: r for r in fan.where("ticker = 'AA'").collect()}
    assert sorted(aa) == [0, 21, 63, 126] and aa[0].p10 == aa[0].p90 == 101.0 and aa[126].p90 == pytest.approx(101 * 1.6)
    ext = {r.ticker: r for r in views.chart_range(tail, fan).collect()}
    assert ext["AA"].y_max == pytest.approx(161.6) and len(ext["AA"].ticks) == 4 and ext["AA"].ticks[3] == pytest.approx(161.6)
    flat = spark.createDataFrame([("F", 0, DAY, 5.0)], "ticker string, day int, date date, close double")
    no_fan = fan.where("false")
    assert views.chart_range(flat, no_fan).first().pad == 1.0
    track = spark.createDataFrame([("AA", [0.1], [0.2])], "ticker string, pred array<double>, realized array<double>")
    page = views.forecast_with_prices(rows, views.price_arrays(hist), track)
    assert page.count() == 9 and page.where("ticker = 'CC' and close is null and track_pred is null").count() == 3


@pytest.fixture(scope="module")
def scores(spark):
    data = [("random_walk", h, 0.02, 0.8, 0.5, None) for h in ("1m", "3m", "6m")] + [("ensemble", h, 0.01, float("nan"), 0.6, 0.03) for h in ("1m", "3m", "6m")]
    return spark.createDataFrame(data, "model string, horizon string, pinball double, coverage double, hit_rate double, ic double")


@pytest.fixture(scope="module")
def params(spark):
    return spark.createDataFrame([("1m", 0.8, 0.5), ("3m", 0.4, None)], "horizon string, w double, delta double")


def test_metrics_document_is_valid_json(spark, scores, params, tmp_path):
    doc = metrics_document(scores, params)
    parsed = json.loads(doc.first().value)
    assert parsed["random_walk"]["y_1m"] == {"pinball": 0.02, "coverage": 0.8, "hit_rate": 0.5, "ic": None}
    assert parsed["ensemble"]["y_3m"]["coverage"] is None and parsed["blend_weight"] == {"1m": 0.8, "3m": 0.4}
    write_one_document(doc, str(tmp_path / "metrics"))
    got = {r.horizon: (r.w, r.delta) for r in read_metrics_params(spark, str(tmp_path / "metrics")).collect()}
    assert got == {"1m": (0.8, 0.5), "3m": (0.4, 0.0), "6m": (1.0, 0.0)}


def test_parameters_default_without_any_entry(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"baseline": {"y_1m": {"ic": null}}}')
    assert {(r.w, r.delta) for r in read_metrics_params(spark, str(tmp_path / "m.json")).collect()} == {(1.0, 0.0)}


def test_model_card_and_metric_log(spark, scores, params, tmp_path):
    write_model_card(scores, str(tmp_path / "card"), params)
    lines = [r.value for r in spark.read.text(str(tmp_path / "card")).collect()]
    assert lines[0].startswith("# Model Card") and lines.index("## random_walk") < lines.index("## ensemble")
    assert "- y_1m: pinball=0.0200, coverage=0.8000, hit_rate=0.5000, ic=n/a" in lines and "- 1m: 0.8000" in lines
    assert lines[lines.index("## ensemble") + 1].startswith("- y_1m")
    log = {r.key: r.value for r in flat_metrics(scores).collect()}
    assert log["ensemble/y_1m/ic"] == 0.03 and log["ensemble/y_1m/coverage"] is None and len(log) == 24
    assert model_card(scores).where(F.col("value").contains("null")).count() == 0


def test_records_sink_keeps_nulls(spark, rows, tmp_path):
    write_records(views.forecast_records(rows), str(tmp_path / "f"))
    text = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert len(text) == 3 and all(set(t["horizons"]) == {"1m", "3m", "6m"} for t in text)


def test_comparison_and_makeup(scores, params):
    piv = {r.hz: r for r in views.model_comparison(scores, "pinball").collect()}
    assert piv["1M"].random_walk == 0.02 and piv["1M"].gbm is None
    make = {r.horizon: r for r in views.ensemble_makeup(params).collect()}
    assert make["1m"].other == pytest.approx(0.2) and make["3m"].delta is None


def test_constituents_prefer_headings(spark):
    good = spark.createDataFrame([("BRK.B", "Berkshire", "x", "Financials")], "Symbol string, Security string, x string, `GICS Sector` string")
    other = spark.createDataFrame([("A", "Agilent", "x", "Health")], "Symbol string, Firm string, x string, Group string")
    assert constituents(good).first() == ("BRK.B", "Berkshire", "Financials")
    assert constituents(other).first() == ("A", "Agilent", "Health")
