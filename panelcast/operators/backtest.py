"""Monthly decile portfolios from a (end_date, ticker, pred, realized) signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.config import COST_GRID_BPS, DEFAULTS, ForecastConfig
from panelcast.functions.numbers import share
from panelcast.functions.windows import so_far
from panelcast.plans.materialize import materialize
from panelcast.plans.ranking import with_position

BOOKS = ("long_short", "long_only", "benchmark")


def signal_from_predictions(preds: DataFrame, model: str, horizon: str = "1m", cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """Out-of-sample signal: predicted median against realized return, all folds."""
    mid = len(cfg.quantiles) // 2
    return preds.where(F.col("horizon") == horizon).select(
        "end_date", "ticker", F.col(model)[mid].alias("pred"), F.col("y").alias("realized")
    )


def require_signal(signal: DataFrame) -> DataFrame:
    if signal.isEmpty():
        raise ValueError("no out-of-sample signal produced")
    return signal


def selections(signal: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """Mark each date's top and bottom names: columns n, k, is_long, is_short.

    Dates with too few names are skipped. k is the decile share of the names, halves rounded
    to even, at least one; ties in pred are ordered by ticker.
    """
    sizes = signal.groupBy("end_date").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cfg.min_names)
    k = F.greatest(F.lit(1), F.bround(F.col("n") * cfg.decile).cast("int"))
    # One row per rebalance date.
    traded = signal.join(F.broadcast(sizes.withColumn("k", k)), "end_date")
    ranked = with_position(traded, ["end_date"], ["pred", "ticker"], "__pos", cfg.max_group_rows)
    return ranked.withColumns(
        {"is_long": F.col("__pos") > F.col("n") - F.col("k"), "is_short": F.col("__pos") <= F.col("k")}
    ).drop("__pos")


def turnover(chosen: DataFrame) -> DataFrame:
    """(end_date, turnover): share of the long book that was not held at the previous
    rebalance; 1 for the first.

    Holding through two rebalances shows as consecutive sequence numbers in a ticker's own
    history, so no set of names is ever gathered.
    """
    dates = chosen.select("end_date").distinct()  # one row per rebalance date
    numbered = dates.withColumn("__seq", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("end_date")))
    longs = chosen.where("is_long").select("end_date", "ticker").join(F.broadcast(numbered), "end_date")
    before = F.lag("__seq").over(Window.partitionBy("ticker").orderBy("__seq"))
    is_new = F.coalesce(before != F.col("__seq") - 1, F.lit(True))
    return longs.withColumn("__new", is_new).groupBy("end_date").agg(share(F.col("__new")).alias("turnover"))


def monthly_returns(signal: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """(end_date, long_short, long_only, benchmark, turnover), one row per rebalance."""
    # Read by both the returns and the turnover: ranked once, written, read twice.
    chosen = materialize(selections(signal, cfg), "selections")
    longs = F.avg(F.when(F.col("is_long"), F.col("realized")))
    shorts = F.avg(F.when(F.col("is_short"), F.col("realized")))
    returns = chosen.groupBy("end_date").agg(
        (longs - shorts).alias("long_short"), longs.alias("long_only"), F.avg("realized").alias("benchmark")
    )
    return returns.join(turnover(chosen), "end_date")


def books(monthly: DataFrame) -> DataFrame:
    """Long form: (end_date, book, r, turnover)."""
    each = F.array(*[F.struct(F.lit(b).alias("book"), F.col(b).alias("r")) for b in BOOKS])
    return monthly.select("end_date", "turnover", F.explode(each).alias("__b")).select(
        "end_date", "__b.book", "__b.r", "turnover"
    )


def with_equity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Append the growth of one unit along end_date and its running peak, per key.

    A product, not a sum of logs: a month may lose everything. The peak starts at the first
    month's value, not at one.
    """
    w = so_far(Window.partitionBy(*keys).orderBy("end_date"))
    grown = rows.withColumn("equity", F.product(F.lit(1) + F.col("r")).over(w))
    return grown.withColumn("peak", F.max("equity").over(w))


def performance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Annualised statistics of monthly returns r per key; null where undefined.

    Twelve months make a year regardless of calendar gaps.
    """
    path = with_equity(rows.where(F.col("r").isNotNull()), keys)
    raw = path.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg("r") * 12).alias("mean"),
        (F.stddev_samp("r") * F.sqrt(F.lit(12.0))).alias("vol"),
        F.max_by("equity", "end_date").alias("final"),
        F.min(F.col("equity") / F.nullif(F.col("peak"), F.lit(0.0)) - 1).alias("drawdown"),
        share(F.col("r") > 0).alias("wins"),
    )
    enough = F.col("n") >= 2
    # A constant series can leave a residue instead of an exact zero deviation.
    vol = F.when(F.col("vol") > 1e-12, F.col("vol"))
    cagr = F.when(F.col("final") > 0, F.pow("final", F.lit(12.0) / F.col("n")) - 1)

    def stat(c: Column, digits: int) -> Column:
        return F.round(F.when(enough, c), digits)

    return raw.select(
        *keys,
        stat(F.col("mean"), 4).alias("ann_return"),
        stat(F.col("vol"), 4).alias("ann_vol"),
        stat(F.col("mean") / vol, 3).alias("sharpe"),
        stat(cagr, 4).alias("cagr"),
        stat(F.col("drawdown"), 4).alias("max_drawdown"),
        stat(F.col("wins"), 3).alias("hit_rate"),
    )


def book_statistics(monthly: DataFrame) -> DataFrame:
    """Statistics per book; the long book's average turnover stands for both trading books."""
    stats = performance(books(monthly), ["book"])
    turn = books(monthly).groupBy("book").agg(F.round(F.avg("turnover"), 3).alias("t"))
    avg_turnover = F.when(F.col("book") != "benchmark", F.col("t"))
    return stats.join(F.broadcast(turn), "book").select(*stats.columns, avg_turnover.alias("avg_turnover"))


def equity_curves(monthly: DataFrame) -> DataFrame:
    """(end_date, book, equity) rounded to four digits."""
    return with_equity(books(monthly), ["book"]).select("end_date", "book", F.round("equity", 4).alias("equity"))


def cost_sensitivity(monthly: DataFrame, grid: tuple[int, ...] = COST_GRID_BPS) -> DataFrame:
    """(bps, sharpe, cagr, ann_return) of the long-short book net of trading costs.

    Each month pays both sides of its turnover.
    """
    priced = monthly.select("end_date", "long_short", "turnover", F.explode(F.array(*[F.lit(b) for b in grid])).alias("bps"))
    net = F.col("long_short") - F.col("turnover") * 2 * (F.col("bps") / 10_000)
    return performance(priced.withColumn("r", net), ["bps"]).select("bps", "sharpe", "cagr", "ann_return")


def report_header(monthly: DataFrame, horizon: str = "1m", cfg: ForecastConfig = DEFAULTS, signal: str = "gbm") -> DataFrame:
    """One row: horizon, signal, decile, months, period and average turnover."""
    return monthly.agg(
        F.count(F.lit(1)).alias("n_months"),
        F.array(F.date_format(F.min("end_date"), "yyyy-MM-dd"), F.date_format(F.max("end_date"), "yyyy-MM-dd")).alias("period"),
        F.round(F.coalesce(F.avg("turnover"), F.lit(0.0)), 3).alias("avg_turnover"),
    ).select(
        F.lit(horizon.removeprefix("y_")).alias("horizon"),
        F.lit(f"{signal} cross-sectional (out-of-sample, walk-forward)").alias("signal"),
        F.lit("monthly").alias("rebalance"),
        F.lit(cfg.decile).alias("decile"),
        "*",
    )


def backtest_report(monthly: DataFrame, horizon: str = "1m", cfg: ForecastConfig = DEFAULTS, signal: str = "gbm") -> DataFrame:
    """The whole report as one nested row. Its size is set by the number of months."""
    curve = [
        F.transform(F.sort_array(F.collect_list(F.when(F.col("book") == b, F.struct("end_date", "equity")))), lambda s: s["equity"]).alias(b)
        for b in BOOKS
    ]
    dates = F.sort_array(F.collect_set(F.date_format("end_date", "yyyy-MM-dd")))
    equity = equity_curves(monthly).agg(dates.alias("dates"), F.struct(*curve).alias("equity"))
    named = F.map_from_entries(F.collect_list(F.struct("book", F.struct(*[c for c in _STATS]))))
    stats = book_statistics(monthly).agg(named.alias("stats"))
    costs = cost_sensitivity(monthly).agg(
        F.sort_array(F.collect_list(F.struct("bps", "sharpe", "cagr", "ann_return"))).alias("cost_sensitivity")
    )
    one_row = report_header(monthly, horizon, cfg, signal).withColumn("__k", F.lit(0))
    for part in (equity, stats, costs):
        one_row = one_row.join(F.broadcast(part.withColumn("__k", F.lit(0))), "__k")
    return one_row.drop("__k")


_STATS = ("ann_return", "ann_vol", "sharpe", "cagr", "max_drawdown", "hit_rate", "avg_turnover")


def track_record(signal: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """(ticker, pred, realized): date-ordered arrays for tickers with enough months.

    A ticker has at most one entry per month.
    """
    entry = F.struct("end_date", F.round("pred", 4).alias("pred"), F.round("realized", 4).alias("realized"))
    history = signal.groupBy("ticker").agg(F.sort_array(F.collect_list(entry)).alias("h"))
    return history.where(F.size("h") >= cfg.min_track).select(
        "ticker",
        F.transform("h", lambda e: e["pred"]).alias("pred"),
        F.transform("h", lambda e: e["realized"]).alias("realized"),
    )
