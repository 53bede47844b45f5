"""Per-series quality gate and spike repair, for all tickers in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.config import DEFAULTS, ForecastConfig
from panelcast.functions.numbers import all_set, nan_to_null, safe_div, share
from panelcast.functions.windows import series, so_far
from panelcast.schemas import OHLCV

TOO_MANY_NULLS = "too many missing closes"
EMPTY = "no bars"
MOST_LOG = 700.0  # rebuilt closes stay within exp(-700) and exp(700), where doubles neither vanish nor overflow


def gate(bars: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """Drop series with too many missing closes or too few usable rows, then unusable rows."""
    return bars.withColumns(_judged()).where(_passes(cfg)).drop(*_judged())


def _judged() -> dict[str, Column]:
    # In the order of dates, so that the windows of the repair and of the features find their rows sorted.
    whole = series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return {"__null_share": share(F.col("Close").isNull()).over(whole), "__usable": F.count_if(F.col("Close") > 0).over(whole)}


def _passes(cfg: ForecastConfig) -> Column:
    return (F.col("__null_share") <= cfg.max_null_share) & (F.col("Close") > 0) & (F.col("__usable") >= cfg.min_rows)


def repair(bars: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """Rebuild the close of any series with a one-day move beyond the spike limit.

    The whole series is rebuilt from clipped returns; High and Low are widened to hold the
    new close. Series without such a move pass unchanged. The running product is a sum of logarithms, so
    that a long fall or rise cannot vanish or overflow; a close of zero or less, which the gate turns away, would have no move.
    """
    return _rebuilt(bars.withColumn("__before", F.lag("Close").over(series())), cfg)


def _rebuilt(bars: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """`repair` of bars that have the close of the ticker's row before as __before."""
    w = series()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.lit(cfg.spike)
    moves = bars.withColumn("__move", safe_div(F.col("Close"), F.col("__before")) - 1).drop("__before")
    # greatest and least skip nulls, so the first row's missing move is set to zero explicitly.
    clipped = F.when(F.col("__move").isNull(), F.lit(0.0)).otherwise(F.greatest(F.least("__move", limit), -limit))
    marked = moves.select(
        *[c for c in bars.columns if c != "__before"],
        F.coalesce(F.bool_or(F.abs("__move") > limit).over(whole), F.lit(False)).alias("__spiky"),
        (F.ln(F.first("Close").over(so_far(w))) + F.sum(F.ln(F.lit(1) + clipped)).over(so_far(w))).alias("__log"),
    )
    bounded = F.greatest(F.least("__log", F.lit(MOST_LOG)), F.lit(-MOST_LOG))
    rebuilt = marked.withColumn("Close", F.when(F.col("__spiky"), F.exp(bounded)).otherwise(F.col("Close")))
    envelope = ("Open", "High", "Low", "Close")
    return rebuilt.select(
        *[c for c in bars.columns if c not in (*OHLCV, "__before")],
        "Open",
        F.when(F.col("__spiky"), F.greatest(*envelope)).otherwise(F.col("High")).alias("High"),
        F.when(F.col("__spiky"), F.least(*envelope)).otherwise(F.col("Low")).alias("Low"),
        "Close",
        "Volume",
    )


def without_nan(bars: DataFrame) -> DataFrame:
    return bars.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in OHLCV})


def clean(bars: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """Gate, drop incomplete rows, repair. NaN counts as missing; a bad series has no rows and
    touches no other series.

    Equal to `repair(gate(without_nan(bars)).na.drop(subset=OHLCV))`. A series passes as a whole, so the close before is already
    known where the series is judged, as the last one of a row that would stay: one window over every bar instead of two.
    """
    usable = all_set([F.col(c) for c in OHLCV]) & (F.col("Close") > 0)
    before = F.last(F.when(usable, F.col("Close")), ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1))
    judged = without_nan(bars).withColumns({**_judged(), "__before": before})
    return _rebuilt(judged.where(_passes(cfg) & usable).drop(*_judged()), cfg)


def rejects(bars: DataFrame, universe: DataFrame | None = None, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """(ticker, reason) for every series the gate turns away.

    With a universe of requested tickers, those without any bar are reported as empty.
    """
    stats = bars.groupBy("ticker").agg(
        share(F.col("Close").isNull()).alias("null_share"), F.count_if(F.col("Close") > 0).alias("usable")
    )
    reason = F.when(F.col("null_share") > cfg.max_null_share, F.lit(TOO_MANY_NULLS)).when(
        F.col("usable") < cfg.min_rows, F.format_string(f"%d usable rows of {cfg.min_rows}", F.col("usable"))
    )
    turned_away = stats.select("ticker", reason.alias("reason"))
    if universe is not None:
        missing = universe.select("ticker").join(stats.select("ticker"), "ticker", "left_anti")
        turned_away = turned_away.union(missing.select("ticker", F.lit(EMPTY).alias("reason")))
    return turned_away.where(F.col("reason").isNotNull())


def enough_history(features: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """Keep series with enough feature rows for one window and the longest horizon."""
    whole = Window.partitionBy("ticker")
    return (
        features.withColumn("__n", F.count(F.lit(1)).over(whole)).where(F.col("__n") >= cfg.min_feature_rows).drop("__n")
    )


def short_history(features: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """(ticker, reason) for series whose feature history is too short to use."""
    n = features.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < cfg.min_feature_rows)
    return n.select("ticker", F.format_string(f"%d feature rows of {cfg.min_feature_rows}", F.col("n")).alias("reason"))


def skip_report(bars: DataFrame, features: DataFrame, universe: DataFrame | None = None, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """(ticker, reason), one row for every series that has no panel rows: turned away by the gate, or for want of
    history, down to none at all. features: the complete rows computed from the cleaned bars."""
    first = rejects(without_nan(bars), universe, cfg)
    rest = tickers(bars).join(first.select("ticker"), "ticker", "left_anti")
    n = rest.join(features.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")), "ticker", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    short = n.where(F.col("n") < cfg.min_feature_rows)
    return first.unionByName(short.select("ticker", F.format_string(f"%d feature rows of {cfg.min_feature_rows}", F.col("n")).alias("reason")))


def tickers(bars: DataFrame) -> DataFrame:
    return bars.select("ticker").distinct()
