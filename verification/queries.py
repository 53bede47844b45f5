"""Registered queries: each takes (spark, data folder) and returns a DataFrame.

Computed columns are rounded where two engines may sum in a different order.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelcast.functions.dates import busday_add
from panelcast.functions.numbers import rounded_double
from panelcast.functions.windows import series
from panelcast.operators import backtest as bt
from panelcast.operators import quality, views
from panelcast.operators.baselines import HistoricalQuantile, RandomWalk, training_labels
from panelcast.operators.boosting import BoostedForecaster
from panelcast.operators.cv import fold_blocks, fold_roles, scored_anchors, walk_forward_folds
from panelcast.operators.ensemble import align_predictions
from panelcast.operators.features import compute_features, join_market
from panelcast.operators.metrics import drift_reference, score_table
from panelcast.operators.panel import latest_rows, month_end_anchors, sliding_windows
from panelcast.operators.garch import garch_fit
from panelcast.operators.series_trend import SeriesTrend, drift_paths, drift_states
from panelcast.operators.series_vol import (
    SeriesVol, garch_volatility, log_prices, paths_to_returns, quantile_paths, realised_volatility, trailing_volatility,
)
from panelcast.operators.trees import LeafQuantileForest
from panelcast.plans.dealing import dealt, still_dealt
from panelcast.plans.materialize import materialize, run_folder
from panelcast.plans.training import anchor_rows
from panelcast.schemas import FEATURES, MARKET_COLS
from panelcast.sinks.bar_cache import BarCache
from panelcast.sinks.documents import flat_metrics, metrics_document, model_card, write_one_document
from panelcast.sinks.tables import write_bars, write_market, write_panel
from panelcast.sources.bars import daily_bars, normalise_symbol, read_bars, tickers, tidy_bars
from panelcast.sources.market import read_market
from panelcast.sources.reference_data import constituents, read_metrics_params
from verification import datasets as ds
from verification.datasets import BOOK, CFG, SHORT_SERIES
from verification.oracles import digits_of, mean_digits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, cols: list[str], digits: int = 4) -> DataFrame:
    doubles = {c for c, kind in df.dtypes if kind == "double"}
    return df.withColumns({c: (rounded_double if c in doubles else F.round)(c, digits_of(c, digits)) for c in cols})


def with_quantiles(df: DataFrame, q: str, *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*keep, *[F.round(F.col(q)[i], digits).alias(n) for i, n in enumerate(("q10", "q50", "q90"))])


# --- sources -------------------------------------------------------------------------------


@query
def bars_daily(spark, sf):
    lines = ds.table(spark, sf, "lineitem").join(
        ds.table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    )
    daily = daily_bars(lines.withColumn("line", ds.line_order()), "p_brand", "l_shipdate", "l_extendedprice", "l_quantity", "line")
    return rounded(daily, ["Volume"])


@query
def bars_hourly_events(spark, sf):
    """Tick resampling on a finer grid: one bar per event type and hour."""
    events = ds.table(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return events.groupBy(F.col("event_type").alias("ticker"), "hour").agg(
        F.min_by("value", "event_id").alias("Open"), F.max("value").alias("High"), F.min("value").alias("Low"),
        F.max_by("value", "event_id").alias("Close"), F.count(F.lit(1)).alias("n"),
    )


@query
def symbol_normalise(spark, sf):
    raw = F.concat_ws(".", F.lower("p_brand"), F.col("p_size").cast("string"))
    return ds.table(spark, sf, "part").groupBy(normalise_symbol(raw).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


@query
def bars_walk(spark, sf):
    return rounded(ds.bars(spark, sf), ["Open", "High", "Low", "Close"])


@query
def bars_cache_scan(spark, sf):
    """Write the per-ticker bar cache, read it back tidy, and list its tickers."""
    path = f"{run_folder(spark)}/cache-{uuid.uuid4().hex}"
    write_bars(ds.raw_bars(spark, sf), path)
    cached = tidy_bars(read_bars(spark, path))
    return tickers(cached).join(cached.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last")), "ticker")


@query
def bars_cache_upsert(spark, sf):
    """A cache filled up to a day, then appended to and corrected for a third of the tickers, then reread."""
    raw = ds.raw_bars(spark, sf)
    cache = BarCache(spark, f"{run_folder(spark)}/cache-{uuid.uuid4().hex}", buckets=64)
    cache.upsert(raw.where("date < '1996-01-01'"))
    third = raw.where(F.substring("ticker", 2, 7).cast("int") % 3 == 0)
    cache.upsert(third.where("date >= '1995-07-01'").withColumn("Open", F.col("Open") * 2))
    return rounded(cache.read(), ["Volume"])


@query
def market_series(spark, sf):
    return rounded(ds.market(spark, sf), MARKET_COLS, 6)


@query
def market_cached(spark, sf):
    """The market sink, read back."""
    path = f"{run_folder(spark)}/market-{uuid.uuid4().hex}"
    write_market(ds.market(spark, sf), path)
    return rounded(read_market(spark, path), MARKET_COLS, 6)


@query
def constituents_meta(spark, sf):
    return constituents(ds.constituent_table(spark, sf))


@query
def metrics_params(spark, sf):
    path = f"{run_folder(spark)}/metrics-{uuid.uuid4().hex}"
    write_one_document(metrics_document(ds.scores(spark, sf), ds.params(spark, sf)), path)
    return rounded(read_metrics_params(spark, path, CFG), ["w", "delta"], 6)


# --- quality -------------------------------------------------------------------------------


@query
def quality_gate(spark, sf):
    return quality.gate(ds.raw_bars(spark, sf), SHORT_SERIES).select("ticker", "date", "Close")


@query
def quality_rejects(spark, sf):
    universe = ds.table(spark, sf, "supplier").select(ds.supplier_ticker("s_suppkey").alias("ticker"))
    extra = ds.table(spark, sf, "nation").select(F.col("n_name").alias("ticker"))
    return quality.rejects(ds.raw_bars(spark, sf), universe.union(extra), SHORT_SERIES)


@query
def quality_repair(spark, sf):
    """Repaired closes as logarithms: the rebuilt walk spans hundreds of orders of magnitude."""
    fixed = quality.repair(quality.gate(ds.raw_bars(spark, sf), SHORT_SERIES), SHORT_SERIES)
    logs = [F.round(F.ln(c), 4).alias(f"ln_{c.lower()}") for c in ("Close", "High", "Low")]
    return fixed.select("ticker", "date", "Open", *logs, "Volume")


@query
def history_gate(spark, sf):
    """Series too short for a window of half the longest one's rows: bars are cut off ticker by ticker."""
    cut = F.date_add(F.lit("1993-01-01").cast("date"), F.pmod(F.substring("ticker", 2, 7).try_cast("int"), F.lit(7)) * 400)
    return quality.short_history(ds.features(spark, sf).where(F.col("date") >= cut), ds.ForecastConfig(window=900))


@query
def quality_skip_report(spark, sf):
    """Every ticker without panel rows and why: unknown ones, those the gate rejects, those with too little history."""
    universe = ds.table(spark, sf, "supplier").select(ds.supplier_ticker("s_suppkey").alias("ticker"))
    extra = ds.table(spark, sf, "nation").select(F.col("n_name").alias("ticker"))
    spoiled = ds.raw_bars(spark, sf).where(F.pmod(F.substring("ticker", 2, 7).try_cast("int"), F.lit(5)) != 4)
    cut = F.date_add(F.lit("1993-01-01").cast("date"), F.pmod(F.substring("ticker", 2, 7).try_cast("int"), F.lit(7)) * 400)
    features = ds.features(spark, sf).where(F.col("date") >= cut)
    return quality.skip_report(spoiled, features, universe.union(extra), ds.ForecastConfig(window=900, min_rows=480))


# --- features ------------------------------------------------------------------------------


def _feature_query(name: str, cols: list[str], digits: int = 4) -> None:
    def run(spark, sf):
        return rounded(ds.all_features(spark, sf).select("ticker", "date", *cols), cols, digits)

    QUERIES[name] = run


FEATURE_GROUPS = {
    "feat_trend": ["SMA_10", "SMA_50", "SMA_200"],
    "feat_ewm": ["MACD", "MACD_signal"],
    "feat_momentum": ["RSI_14", "MOM_5", "ROC_21", "Williams_R"],
    "feat_volatility": ["ATR_14", "BB_upper", "BB_lower", "BB_width"],
    "feat_volume": ["OBV_norm", "Volume_SMA_20", "Volume_ratio"],
    "feat_candles": ["body_size", "upper_shadow", "lower_shadow", "body_pct", "doji", "hammer", "shooting_star", "engulfing"],
    "feat_range52": ["pct_from_52w_high", "pct_from_52w_low", "price_range_pct"],
}
for _name, _cols in FEATURE_GROUPS.items():
    _feature_query(_name, _cols)


@query
def market_join_ffill(spark, sf):
    joined = join_market(ds.bars(spark, sf), ds.market(spark, sf))
    return rounded(joined.select("ticker", "date", *MARKET_COLS), MARKET_COLS, 6)


@query
def features_complete(spark, sf):
    """Which rows survive the completeness filter, per ticker, computed from bars on."""
    done = compute_features(quality.clean(ds.bars(spark, sf), CFG), ds.market(spark, sf))
    return done.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"),
        *[F.round(F.avg(c), mean_digits(c)).alias(c) for c in FEATURES],
    )


# --- windows, labels, panel ----------------------------------------------------------------


@query
def windows_tensor(spark, sf):
    """Shape, corner values and labels of every sliding window."""
    short = ds.ForecastConfig(window=60, horizons={"1w": 5, "1m": 21})
    w = sliding_windows(ds.features(spark, sf), short)
    close_at = FEATURES.index("Close")
    return w.select(
        "ticker", "end_date", F.size("X").alias("rows"), F.size(F.col("X")[0]).alias("cols"),
        F.round(F.col("X")[0][close_at].cast("double"), 2).alias("first_close"),
        F.round(F.element_at("X", -1)[close_at].cast("double"), 2).alias("last_close"),
        F.round(F.col("y_ret")[0].cast("double"), 4).alias("y_1w"), F.round(F.col("y_ret")[1].cast("double"), 4).alias("y_1m"),
    )


@query
def windows_tensor_full(spark, sf):
    """Windows of the library's own length with all of its horizons; the closes of a window are summed as well."""
    w = sliding_windows(ds.features(spark, sf), CFG)
    close_at = FEATURES.index("Close")
    close = lambda x: x[close_at].cast("double")
    return w.select(
        "ticker", "end_date", F.size("X").alias("rows"), F.array_min(F.transform("X", F.size)).alias("cols"),
        F.round(close(F.col("X")[0]), 2).alias("first_close"), F.round(close(F.element_at("X", -1)), 2).alias("last_close"),
        F.round(F.aggregate("X", F.lit(0.0), lambda acc, x: acc + close(x)), 2).alias("sum_close"),
        *[F.round(F.col("y_ret")[i].cast("double"), 4).alias(c) for i, c in enumerate(CFG.label_cols)],
    )


@query
def labels_forward(spark, sf):
    return rounded(ds.panel(spark, sf).select("ticker", "end_date", "base_close", *CFG.label_cols, "label_end"), CFG.label_cols, 6)


@query
def panel(spark, sf):
    cols = [*FEATURES, *CFG.label_cols, "base_close"]
    return rounded(ds.panel(spark, sf).select("ticker", "end_date", *cols), cols)


@query
def panel_written(spark, sf):
    """The panel sink, read back."""
    path = f"{run_folder(spark)}/panel-{uuid.uuid4().hex}"
    write_panel(ds.panel(spark, sf), path)
    return spark.read.parquet(path).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("base_close"), 3).alias("base_close"), F.max("end_date").alias("last")
    )


@query
def month_anchors(spark, sf):
    return rounded(month_end_anchors(ds.panel(spark, sf)).select("ticker", "end_date", "base_close", "y_1m"), ["y_1m"], 6)


@query
def latest_features(spark, sf):
    cols = ["Close", "SMA_50", "RSI_14", "base_close"]
    return rounded(latest_rows(ds.written_features(spark, sf), CFG).select("ticker", "end_date", *cols), cols)


# --- walk-forward folds --------------------------------------------------------------------


@query
def business_days(spark, sf):
    dates = ds.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return dates.select("d", *[busday_add("d", n).alias(f"plus_{n}") for n in (1, 3, 5, 126)])


@query
def cv_fold_bounds(spark, sf):
    return fold_blocks(ds.panel(spark, sf), CFG)


@query
def cv_roles(spark, sf):
    roles = fold_roles(ds.labels(spark, sf).select("ticker", "end_date"), ds.folds(spark, sf))
    return roles.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("end_date").alias("first"), F.max("end_date").alias("last"), F.count_distinct("ticker").alias("tickers")
    )


@query
def cv_roles_rows_purge(spark, sf):
    by_rows = ds.ForecastConfig(purge="rows")
    slim = ds.labels(spark, sf).select("ticker", "end_date", "label_end")
    return fold_roles(slim, walk_forward_folds(slim, by_rows)).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.max("end_date").alias("last")
    )


@query
def cv_scored_anchors(spark, sf):
    anchors = scored_anchors(month_end_anchors(ds.labels(spark, sf)), ds.folds(spark, sf))
    return anchors.select("ticker", "end_date", "fold", "split")


# --- models --------------------------------------------------------------------------------


@query
def m_random_walk(spark, sf):
    model = RandomWalk(CFG).fit(training_labels(ds.labels(spark, sf), ds.folds(spark, sf), CFG))
    return with_quantiles(model.bands(), model.name, "fold", "horizon")


@query
def m_hist_quantile(spark, sf):
    model = HistoricalQuantile(CFG).fit(training_labels(ds.labels(spark, sf), ds.folds(spark, sf), CFG))
    return with_quantiles(model.bands(), model.name, "fold", "horizon")


@query
def m_series_vol(spark, sf):
    rows = anchor_rows(ds.labels(spark, sf), ds.folds(spark, sf), CFG)
    scored = SeriesVol(CFG).fit(ds.bars(spark, sf)).predict(rows)
    return with_quantiles(scored, "series_vol", "fold", "ticker", "end_date", "horizon")


@query
def m_series_vol_asof(spark, sf):
    """Every scored anchor moved on by one to seven days: weekends and days beyond a series' end among them."""
    rows = anchor_rows(ds.labels(spark, sf), ds.folds(spark, sf), CFG)
    rows = rows.withColumn("end_date", F.date_add("end_date", F.dayofmonth("end_date") % 7 + 1))
    bars = ds.bars(spark, sf)
    scored = SeriesVol(CFG).fit(still_dealt(bars.where(F.dayofmonth("date") % 10 != 3), bars)).predict(rows)
    return with_quantiles(scored, "series_vol", "fold", "ticker", "end_date", "horizon")


@query
def m_series_paths(spark, sf):
    """Latest anchors only carry a full step-by-step path; returns are read off at horizons."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    known = trailing_volatility(ds.bars(spark, sf)).withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    paths = quantile_paths(known.withColumnRenamed("date", "end_date"), CFG.max_horizon, CFG)
    return with_quantiles(paths_to_returns(paths, CFG), "q", "ticker", "end_date", "horizon")


@query
def m_series_paths_anchors(spark, sf):
    """The paths of every test anchor of all folds, at the steps of the horizons."""
    anchors = scored_anchors(month_end_anchors(ds.labels(spark, sf)), ds.folds(spark, sf)).select("ticker", "end_date")
    known = trailing_volatility(ds.bars(spark, sf)).withColumnRenamed("date", "end_date")
    paths = quantile_paths(anchors.join(known, ["ticker", "end_date"]), list(CFG.horizons.values()), CFG)
    return with_quantiles(paths_to_returns(paths, CFG), "q", "ticker", "end_date", "horizon")


@query
def m_series_trend(spark, sf):
    """Quantiles with the series' own drift for every scored anchor."""
    rows = anchor_rows(ds.labels(spark, sf), ds.folds(spark, sf), CFG)
    scored = SeriesTrend(CFG).fit(ds.bars(spark, sf)).predict(rows)
    return with_quantiles(scored, "series_trend", "fold", "ticker", "end_date", "horizon")


@query
def m_series_trend_paths(spark, sf):
    """The newest row of each ticker, at every step up to the last horizon."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    known = drift_states(ds.bars(spark, sf)).withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    return with_quantiles(drift_paths(known.withColumnRenamed("date", "end_date"), CFG.max_horizon, CFG), "path", "ticker", "end_date", "step")


@query
def m_log_prices(spark, sf):
    return rounded(log_prices(ds.bars(spark, sf)), ["log_price"], 6)


def _returns(spark, sf):
    return dealt(ds.bars(spark, sf)).select("ticker", "date", (F.col("Close") / F.lag("Close").over(series()) - 1).alias("r"))


@query
def m_realised_vol(spark, sf):
    return rounded(realised_volatility(_returns(spark, sf), 21), ["volatility"], 6)


@query
def m_garch_vol(spark, sf):
    return rounded(garch_volatility(_returns(spark, sf), 21), ["volatility"], 6)


@ds.once
def _garch(spark, sf):
    return materialize(garch_fit(_returns(spark, sf), 21), "garch")


@query
def m_garch_fit(spark, sf):
    return rounded(_garch(spark, sf), ["omega", "alpha", "beta", "loss", "grid_loss", "volatility"], 6)


@query
def m_garch_fit_invariants(spark, sf):
    """A stationary point for every ticker that moves, no less likely than the grid's best; that best and its level are SQL's too."""
    moved = F.col("alpha").isNotNull()
    return _garch(spark, sf).select(
        "ticker", moved.alias("fitted"), F.round("grid_loss", 3).alias("grid_loss"), (moved & (F.col("loss") > F.col("grid_loss"))).alias("below_grid"),
        F.coalesce((F.col("omega") > 0) & (F.col("alpha") > 0) & (F.col("alpha") + F.col("beta") < 1), ~moved).alias("stationary"),
        F.col("volatility").isNull().alias("no_volatility"))


@query
def m_leaf_forest(spark, sf):
    """Forest quantiles of every test anchor, all folds and horizons; pred (the median) and realized are the signal."""
    data = ds.written_panel(spark, sf)
    folds = walk_forward_folds(data, CFG)
    model = LeafQuantileForest(CFG).fit_folds(data, folds)
    rows = materialize(anchor_rows(data, folds, CFG, keep=FEATURES), "anchors")
    scored = model.predict(rows).withColumns({"pred": F.round(F.col("gbm")[1], 6), "realized": F.round("y", 6)})
    return with_quantiles(scored, "gbm", "fold", "ticker", "end_date", "horizon", "pred", "realized")


@ds.once
def _boosted(spark, sf):
    """Boosted quantiles of every test anchor: all folds and horizons."""
    data = ds.written_panel(spark, sf)
    folds = walk_forward_folds(data, CFG)
    model = BoostedForecaster(CFG).fit_folds(data, folds)
    return materialize(model.predict(anchor_rows(data, folds, CFG, keep=FEATURES)).drop(*FEATURES), "boosted")


@query
def m_boosted(spark, sf):
    return with_quantiles(_boosted(spark, sf), "boosted", "fold", "ticker", "end_date", "horizon")


@query
def m_boosted_invariants(spark, sf):
    """What must hold of any quantile forecast: one per anchor, no nulls, no crossings, within the labels trained on."""
    q = F.col("boosted")
    data = ds.written_panel(spark, sf)
    labels = training_labels(data, walk_forward_folds(data, CFG), CFG).groupBy("fold", "horizon").agg(
        F.min("y").alias("least"), F.max("y").alias("most"))
    rows = _boosted(spark, sf).join(F.broadcast(labels), ["fold", "horizon"])  # one row for each fold and horizon
    return rows.groupBy("fold", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.size(q) != 3) | F.exists(q, lambda v: v.isNull())).alias("nulls"),
        F.count_if((q[0] > q[1]) | (q[1] > q[2])).alias("crossings"),
        F.count_if((q[0] < F.col("least")) | (q[2] > F.col("most"))).alias("outside"))


# --- ensemble and scores -------------------------------------------------------------------


@query
def ens_params(spark, sf):
    return rounded(ds.params(spark, sf), ["w", "delta"], 6)


@query
def ens_predictions(spark, sf):
    return with_quantiles(ds.ensembled(spark, sf), "ensemble", "fold", "split", "ticker", "end_date", "horizon")


@query
def ens_aligned(spark, sf):
    """Two separately stored prediction tables matched row for row by key."""
    p = ds.predictions(spark, sf)
    key = ["ticker", "end_date", "horizon"]
    both = align_predictions(p.select(*key, F.col("series_vol").alias("q")), p.select(*key, F.col("baseline").alias("q")), "a", "b")
    return both.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("a")[2] - F.col("b")[2]), 6).alias("gap90")
    )


@query
def metrics_scoreboard(spark, sf):
    table = score_table(ds.ensembled(spark, sf), ds.MODELS, CFG)
    return rounded(table, ["pinball", "coverage", "hit_rate", "ic"], 6)


@query
def metrics_flat(spark, sf):
    return rounded(flat_metrics(ds.scores(spark, sf)), ["value"], 6)


@query
def metrics_card(spark, sf):
    return model_card(ds.scores(spark, sf), ds.params(spark, sf)).select("value")


@query
def metrics_model_pivot(spark, sf):
    return rounded(views.model_comparison(ds.scores(spark, sf), "pinball"), ["random_walk", "baseline", "gbm", "series_vol", "ensemble"], 6)


@query
def ensemble_makeup(spark, sf):
    return rounded(views.ensemble_makeup(ds.params(spark, sf)), ["w", "other", "delta"], 6)


@query
def drift(spark, sf):
    return rounded(drift_reference(ds.written_panel(spark, sf)), ["mean", "std"], 3)


# --- backtest ------------------------------------------------------------------------------


@query
def bt_selection(spark, sf):
    chosen = bt.selections(ds.signal(spark, sf), BOOK)
    return chosen.select("end_date", "ticker", "n", "k", F.col("is_long").cast("int").alias("is_long"), F.col("is_short").cast("int").alias("is_short"))


@query
def bt_monthly(spark, sf):
    cols = ["long_short", "long_only", "benchmark", "turnover"]
    return rounded(bt.monthly_returns(ds.signal(spark, sf), BOOK).select("end_date", *cols), cols, 6)


@query
def bt_monthly_defaults(spark, sf):
    """The library's own book: deciles of months with 30 names or more."""
    cols = ["long_short", "long_only", "benchmark", "turnover"]
    return rounded(bt.monthly_returns(ds.signal(spark, sf), CFG).select("end_date", *cols), cols, 6)


@query
def bt_stats_defaults(spark, sf):
    return bt.book_statistics(materialize(bt.monthly_returns(ds.signal(spark, sf), CFG).repartition(1), "monthly-defaults"))


@query
def bt_stats(spark, sf):
    return bt.book_statistics(ds.monthly(spark, sf))


@query
def bt_equity(spark, sf):
    return bt.equity_curves(ds.monthly(spark, sf))


@query
def bt_costs(spark, sf):
    return bt.cost_sensitivity(ds.monthly(spark, sf))


@query
def bt_cost_lookup(spark, sf):
    return views.cost_at(bt.cost_sensitivity(ds.monthly(spark, sf)), 10)


@query
def bt_header(spark, sf):
    header = bt.report_header(ds.monthly(spark, sf), "1m", BOOK, "momentum")
    return header.withColumns({"period_start": F.col("period")[0], "period_end": F.col("period")[1]}).drop("period")


@query
def bt_equity_chart(spark, sf):
    return views.equity_chart(bt.backtest_report(ds.monthly(spark, sf), "1m", BOOK, "momentum"))


@query
def bt_track_record(spark, sf):
    arrays = F.arrays_zip("pred", "realized")
    return bt.track_record(ds.signal(spark, sf), BOOK).select("ticker", F.posexplode(arrays).alias("i", "z")).select(
        "ticker", "i", "z.pred", "z.realized"
    )


@query
def view_skill(spark, sf):
    return rounded(views.skill(bt.track_record(ds.signal(spark, sf), BOOK)), ["hit_rate", "corr"])


@query
def view_plot_domain(spark, sf):
    return views.plot_domain(bt.track_record(ds.signal(spark, sf), BOOK))


# --- serving views -------------------------------------------------------------------------


@query
def view_forecasts(spark, sf):
    return ds.forecasts(spark, sf)


@query
def view_forecast_records(spark, sf):
    records = views.forecast_records(ds.forecasts(spark, sf), CFG)
    return records.select("ticker", "anchor_price", F.size("horizons").alias("n"), F.col("horizons")["3m"]["q90"].alias("q90_3m"))


@query
def view_forecast_horizons(spark, sf):
    """The header that goes with the forecast records: the horizons and how many records there are."""
    path = f"{run_folder(spark)}/forecast-header-{uuid.uuid4().hex}"
    write_one_document(views.forecast_header(ds.forecasts(spark, sf), CFG), path)
    text = spark.read.text(path)
    shape = "struct<anchor_horizons:array<string>,horizon_rows:array<int>,n_forecasts:bigint>"
    return text.select(F.from_json("value", shape).alias("d")).select(
        F.array_join("d.anchor_horizons", ",").alias("anchor_horizons"), F.array_join(F.col("d.horizon_rows").cast("array<string>"), ",").alias("horizon_rows"),
        F.col("d.n_forecasts").alias("n_forecasts"))


def _history(spark, sf):
    return views.price_history(ds.bars(spark, sf), ds.forecasts(spark, sf).select("ticker").distinct())


@query
def view_price_history(spark, sf):
    return _history(spark, sf)


@query
def view_price_arrays(spark, sf):
    return views.price_arrays(_history(spark, sf)).select(
        "ticker", F.size("dates").alias("n"), F.col("dates")[0].alias("first_date"), F.element_at("close", -1).alias("last_close")
    )


@query
def view_chart_tail(spark, sf):
    return views.chart_tail(_history(spark, sf))


@query
def view_price_fan(spark, sf):
    return rounded(views.price_fan(ds.forecasts(spark, sf), CFG), ["p10", "p50", "p90"])


@query
def view_chart_range(spark, sf):
    extent = views.chart_range(views.chart_tail(_history(spark, sf)), views.price_fan(ds.forecasts(spark, sf), CFG))
    flat = extent.select("ticker", "y_min", "y_max", "pad", F.col("ticks")[1].alias("tick_1"), F.col("ticks")[3].alias("tick_3"))
    return rounded(flat, ["y_min", "y_max", "pad", "tick_1", "tick_3"], 3)


@query
def view_screener(spark, sf):
    return views.screen(ds.forecasts(spark, sf), "3m", search=" supplier#00 ", cfg=CFG).select("position", "ticker", "sector", "q10", "q50", "q90")


@query
def view_screener_sector(spark, sf):
    return views.screen(ds.forecasts(spark, sf), "1m", sector="Unknown", descending=False, cfg=CFG).select("position", "ticker", "name", "q90")


@query
def view_sectors(spark, sf):
    return views.sector_options(ds.forecasts(spark, sf))


@query
def view_scale(spark, sf):
    return views.shared_scale(ds.forecasts(spark, sf).where("horizon = '3m'"))


@query
def view_holdings(spark, sf):
    by_edge = ds.forecasts(spark, sf).withColumn("q50", F.round(F.col("q90") + F.col("q10"), 6))
    return views.holdings(by_edge, 0.1, CFG)


@query
def view_options(spark, sf):
    return views.search_options(ds.forecasts(spark, sf).where("horizon = '1m'"), " S000")


@query
def view_lookup(spark, sf):
    return views.find_forecast(ds.forecasts(spark, sf), "zz", "s0000005".upper()).select("ticker", "horizon", "q10", "q90")


@query
def view_forecast_page(spark, sf):
    ds.label_rows(spark, sf)  # the signal's labels and the forecasts' anchors come from one pass over the bars
    page = views.forecast_with_prices(
        ds.forecasts(spark, sf), views.price_arrays(_history(spark, sf)), bt.track_record(ds.signal(spark, sf), BOOK)
    )
    return page.select("ticker", "horizon", "q90", F.size("close").alias("n_prices"), F.coalesce(F.size("track_pred"), F.lit(-1)).alias("n_track"))
