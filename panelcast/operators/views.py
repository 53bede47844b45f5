"""Batch tables behind the reports: forecasts, price charts, screener, holdings, skill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.config import DEFAULTS, MODELS, ForecastConfig
from panelcast.functions.numbers import half_up, share
from panelcast.operators.metrics import same_direction
from panelcast.plans.ranking import with_position

ALL_SECTORS = "All"
UNKNOWN_SECTOR = "Unknown"
CHART_DAYS = 120
OPTION_LIMIT = 300


# --- forecasts -----------------------------------------------------------------------------


def forecast_rows(latest: DataFrame, band: str, meta: DataFrame | None, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """One row per ticker and horizon: labels, anchor and rounded q10/q50/q90.

    `latest` is long: (ticker, end_date, base_close, horizon, <band>). Missing labels fall
    back to the ticker itself and to an unknown sector.
    """
    if meta is None:
        labelled = latest.withColumns({"name": F.lit(None).cast("string"), "sector": F.lit(None).cast("string")})
    else:
        labelled = latest.join(meta.select("ticker", "name", "sector"), "ticker", "left")
    return labelled.select(
        "ticker",
        F.coalesce("name", "ticker").alias("name"),
        F.coalesce("sector", F.lit(UNKNOWN_SECTOR)).alias("sector"),
        F.date_format("end_date", "yyyy-MM-dd").alias("anchor_date"),
        F.round("base_close", 4).alias("anchor_price"),
        "horizon",
        *[F.round(F.col(band)[i], 6).alias(f"q{round(100 * q)}") for i, q in enumerate(cfg.quantiles)],
    )


def forecast_records(rows: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """One nested record per ticker, horizons as a map."""
    quantiles = F.struct(*[f"q{round(100 * q)}" for q in cfg.quantiles])
    return rows.groupBy("ticker", "name", "sector", "anchor_date", "anchor_price").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("horizon"), quantiles))).alias("horizons")
    )


def forecast_header(rows: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """One row to go with the records: anchor_horizons and their lengths in rows, in the settings' order, and n_forecasts."""
    names = F.array(*[F.lit(h) for h in cfg.horizons])
    steps = F.array(*[F.lit(n) for n in cfg.horizons.values()])
    return rows.agg(F.count_distinct("ticker").alias("n_forecasts")).select(names.alias("anchor_horizons"), steps.alias("horizon_rows"), "n_forecasts")


def find_forecast(rows: DataFrame, requested: str, fallback: str | None = None) -> DataFrame:
    """The requested ticker's rows, else the fallback's, else those of the first ticker."""
    priority = F.when(F.col("ticker") == requested.upper(), 0).when(F.col("ticker") == F.lit(fallback), 1).otherwise(2)
    chosen = rows.select("ticker", priority.alias("p")).orderBy("p", "ticker").limit(1).select("ticker")
    return rows.join(F.broadcast(chosen), "ticker", "left_semi")


# --- prices --------------------------------------------------------------------------------


def price_history(bars: DataFrame, tickers: DataFrame | None = None, days: int = DEFAULTS.price_history_days) -> DataFrame:
    """(ticker, date, close): the last closes of each ticker as traded, before any repair."""
    wanted = bars if tickers is None else bars.join(tickers.select("ticker"), "ticker", "left_semi")
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return (
        wanted.where(F.col("Close").isNotNull())
        .withColumn("__rn", F.row_number().over(newest))
        .where(F.col("__rn") <= days)
        .select("ticker", "date", F.round("Close", 4).alias("close"))
    )


def price_arrays(history: DataFrame) -> DataFrame:
    """(ticker, dates, close) as parallel arrays; their length is the history window."""
    points = F.sort_array(F.collect_list(F.struct("date", "close")))
    return history.groupBy("ticker").agg(points.alias("p")).select(
        "ticker",
        F.transform("p", lambda p: F.date_format(p["date"], "yyyy-MM-dd")).alias("dates"),
        F.transform("p", lambda p: p["close"]).alias("close"),
    )


def chart_tail(history: DataFrame, points: int = CHART_DAYS) -> DataFrame:
    """(ticker, day, date, close) with day running from -(n-1) to 0."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return (
        history.withColumn("__rn", F.row_number().over(newest))
        .where(F.col("__rn") <= points)
        .select("ticker", (F.lit(1) - F.col("__rn")).alias("day"), "date", "close")
    )


def price_fan(rows: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """(ticker, day, p10, p50, p90): price quantiles from the anchor out to each horizon."""
    quantiles = [f"q{round(100 * q)}" for q in cfg.quantiles]
    day = F.element_at(F.create_map(*[F.lit(x) for item in cfg.horizons.items() for x in item]), F.col("horizon"))
    ahead = rows.select(
        "ticker", day.alias("day"), *[(F.col("anchor_price") * (F.lit(1) + F.col(q))).alias("p" + q[1:]) for q in quantiles]
    )
    start = rows.groupBy("ticker").agg(F.max("anchor_price").alias("a")).select(
        "ticker", F.lit(0).alias("day"), *[F.col("a").alias("p" + q[1:]) for q in quantiles]
    )
    return ahead.unionByName(start)


def chart_range(tail: DataFrame, fan: DataFrame) -> DataFrame:
    """(ticker, y_min, y_max, pad, ticks): vertical extent of history and outer band."""
    prices = tail.select("ticker", F.col("close").alias("p")).unionByName(
        fan.select("ticker", F.explode(F.array("p10", "p90")).alias("p"))
    )
    extent = prices.groupBy("ticker").agg(F.min("p").alias("y_min"), F.max("p").alias("y_max"))
    height = F.col("y_max") - F.col("y_min")
    ticks = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("y_min") + height * i / 3)
    return extent.select("ticker", "y_min", "y_max", F.when(height == 0, 1.0).otherwise(height * 0.06).alias("pad"), ticks.alias("ticks"))


def forecast_with_prices(rows: DataFrame, prices: DataFrame, track: DataFrame) -> DataFrame:
    """Forecasts with the ticker's price arrays and track record, null where it has none."""
    return rows.join(prices, "ticker", "left").join(
        track.select("ticker", F.col("pred").alias("track_pred"), F.col("realized").alias("track_realized")), "ticker", "left"
    )


# --- screener and holdings -----------------------------------------------------------------


def screen(rows: DataFrame, horizon: str = "3m", sector: str = ALL_SECTORS, search: str = "", descending: bool = True,
           cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """Forecasts of one horizon, filtered, with their position by expected return."""
    text = search.strip().upper()
    picked = rows.where(F.col("horizon") == horizon)
    if sector != ALL_SECTORS:
        picked = picked.where(F.col("sector") == sector)
    if text:
        picked = picked.where(F.contains("ticker", F.lit(text)) | F.contains(F.upper("name"), F.lit(text)))
    by_return = F.desc("q50") if descending else F.asc("q50")
    return with_position(picked, [], [by_return, F.asc("ticker")], "position", cfg.max_group_rows)


def sector_options(rows: DataFrame) -> DataFrame:
    """(ord, sector): the all-sectors entry, then the sectors present in order."""
    names = rows.select("sector").distinct()  # a classification with a few dozen entries
    ranked = names.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("sector")).alias("ord"), "sector")
    return rows.sparkSession.createDataFrame([(0, ALL_SECTORS)], "ord int, sector string").unionByName(ranked)


def shared_scale(rows: DataFrame) -> DataFrame:
    """One row: the largest absolute band edge among the given rows, at least 0.01."""
    edge = F.greatest(F.max(F.abs("q10")), F.max(F.abs("q90")))
    return rows.agg(F.greatest(F.lit(0.01), edge).alias("scale"))


def holdings(rows: DataFrame, decile: float = DEFAULTS.decile, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """(side, place, ticker, q50): what the strategy would hold now, by one-month median.

    The count rounds halves up. Longs are listed best first, shorts worst first.
    """
    one_month = rows.where(F.col("horizon") == "1m").select("ticker", "q50")
    size = one_month.agg(F.count(F.lit(1)).alias("n"))  # one row
    ranked = with_position(one_month, [], [F.desc("q50"), F.asc("ticker")], "__pos", cfg.max_group_rows)
    sized = ranked.withColumn("n", size.scalar())
    k = F.greatest(F.lit(1), half_up(F.col("n") * decile))
    from_end = F.col("n") - F.col("__pos") + 1
    sides = F.array(
        F.when(F.col("__pos") <= k, F.struct(F.lit("long").alias("side"), F.col("__pos").cast("long").alias("place"))),
        F.when(from_end <= k, F.struct(F.lit("short").alias("side"), from_end.alias("place"))),
    )
    return sized.select("ticker", "q50", F.explode(F.array_compact(sides)).alias("__s")).select(
        "__s.side", "__s.place", "ticker", "q50"
    )


def search_options(rows: DataFrame, query: str, limit: int = OPTION_LIMIT) -> DataFrame:
    """The first matching (ticker, name, sector) entries in ticker order; case is ignored."""
    text = query.strip().lower()
    options = rows.select("ticker", "name", "sector")
    if text:
        hit = [F.contains(F.lower(c), F.lit(text)) for c in options.columns]
        options = options.where(hit[0] | hit[1] | hit[2])
    return options.orderBy("ticker").limit(limit)


# --- backtest and skill --------------------------------------------------------------------


def equity_chart(report: DataFrame) -> DataFrame:
    """One row per month of a report: label yyyy-MM and the three curves."""
    e = F.col("equity")
    zipped = F.arrays_zip(F.col("dates").alias("d"), e["long_short"].alias("ls"), e["long_only"].alias("lo"), e["benchmark"].alias("b"))
    return report.select(F.explode(zipped).alias("z")).select(
        F.col("z.d").alias("date"), F.substr(F.col("z.d"), F.lit(1), F.lit(7)).alias("month"),
        F.col("z.ls").alias("long_short"), F.col("z.lo").alias("long_only"), F.col("z.b").alias("benchmark"),
    )


def cost_at(costs: DataFrame, bps: int = 10) -> DataFrame:
    return costs.where(F.col("bps") == bps)


def skill(track: DataFrame) -> DataFrame:
    """(ticker, hits, n, hit_rate, corr, verdict) from track-record arrays."""
    points = track.select("ticker", F.explode(F.arrays_zip("pred", "realized")).alias("z")).select(
        "ticker", "z.pred", "z.realized"
    )
    flat = (F.min("pred") == F.max("pred")) | (F.min("realized") == F.max("realized"))
    corr = F.covar_pop("pred", "realized") / F.nullif(F.stddev_pop("pred") * F.stddev_pop("realized"), F.lit(0.0))
    right = same_direction(F.col("realized"), F.col("pred"))
    stats = points.groupBy("ticker").agg(
        F.count_if(right).alias("hits"),
        F.count(F.lit(1)).alias("n"),
        share(right).alias("hit_rate"),
        F.coalesce(F.when(~flat, corr), F.lit(0.0)).alias("corr"),
    )
    rate = F.col("hit_rate")
    return stats.withColumn("verdict", F.when(rate >= 0.55, "edge").when(rate >= 0.45, "coin flip").otherwise("below"))


def plot_domain(track: DataFrame) -> DataFrame:
    """(ticker, domain): half-width of the predicted-against-realized plot."""

    def peak(c: str) -> Column:
        return F.array_max(F.transform(c, lambda v: F.abs(v)))

    return track.select("ticker", F.greatest(F.lit(0.02), peak("pred"), peak("realized")).alias("domain"))


def model_comparison(scores: DataFrame, metric: str = "ic", models: tuple[str, ...] = MODELS) -> DataFrame:
    """One row per horizon, one column per model, for the chosen metric."""
    return scores.groupBy(F.upper("horizon").alias("hz")).pivot("model", list(models)).agg(F.first(metric))


def ensemble_makeup(params: DataFrame) -> DataFrame:
    """(horizon, w, other, delta): what each horizon's blend consists of."""
    w = F.coalesce("w", F.lit(1.0))
    return params.select("horizon", w.alias("w"), (F.lit(1.0) - w).alias("other"), "delta")
