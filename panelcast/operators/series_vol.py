"""Forecasts from a ticker's own price history: volatility bands and quantile paths."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.config import DEFAULTS, ForecastConfig
from panelcast.functions.windows import Decay, Rolling, in_blocks, series, with_decay, with_rolling
from panelcast.plans.asof import asof_rows, visible_rows
from panelcast.plans.dealing import dealt

# The (alpha, beta) grid searched by garch_volatility.
GARCH_GRID = tuple((a, b) for b in (0.80, 0.88, 0.94) for a in (0.03, 0.05, 0.10))


def log_prices(bars: DataFrame) -> DataFrame:
    """(ticker, date, log_price) over positive, present closes."""
    return bars.where(F.col("Close") > 0).select("ticker", "date", F.ln("Close").alias("log_price"))


def trailing_volatility(bars: DataFrame, rows: int = 252, anchors: DataFrame | None = None) -> DataFrame:
    """(ticker, date, log_price, sigma): sample sd of the last `rows` one-day log returns.

    From sums of the returns and their squares: the returns sum to the log price less the one `rows` before, the squares
    are a rolling sum. Daily returns are centred near zero, so the subtraction loses no digits, and long sums are cheap to tile. With anchors (ticker, end_date) the rolling
    sums leave out rows that no anchor's sigma is made of; sigma is right on the last row that each anchor sees.
    """
    w = series()
    r, whole = (F.col("log_price") - F.lag("log_price", n).over(w) for n in (1, rows))
    moves = log_prices(dealt(bars)).select("*", r.alias("__r"), whole.alias("__s"), F.lead("date", rows).over(w).alias("__later"))
    if anchors is not None:
        moves = visible_rows(moves, anchors, "__later")
    moves = moves.withColumn("__rr", F.col("__r") * F.col("__r")).drop("__r", "__later")
    sums = with_rolling(moves, [Rolling("__ss", "sum", "__rr", rows)], w)
    spread = F.col("__ss") - F.col("__s") * F.col("__s") / rows
    # Not greatest(spread, 0): it would skip the nulls of the warm-up rows.
    not_negative = F.when(spread > 0, spread).when(spread <= 0, F.lit(0.0))
    return sums.select("ticker", "date", "log_price", F.sqrt(not_negative / (rows - 1)).alias("sigma"))


class SeriesVol:
    """Flat median, band widening with the square root of the horizon.

    `fit` keeps the price history; each anchor sees only rows up to its own date, because
    the volatility comes from a window that ends there.
    """

    name = "series_vol"

    def __init__(self, cfg: ForecastConfig = DEFAULTS, rows: int = 252):
        self.cfg, self.rows = cfg, rows
        self.bars: DataFrame | None = None

    def fit(self, bars: DataFrame) -> "SeriesVol":
        self.bars = bars
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """An anchor on a day without a bar takes the last bar before it; without one its band is null."""
        history = trailing_volatility(self.bars, self.rows, rows)
        known = asof_rows(rows, history, ["sigma"]).select("ticker", "end_date", F.col("sigma").alias("__sigma"))
        joined = rows.join(known, ["ticker", "end_date"], "left")
        steps = F.element_at(F.create_map(*[x for h, n in self.cfg.horizons.items() for x in (F.lit(h), F.lit(float(n)))]), F.col("horizon"))
        return joined.withColumn(self.name, band(F.col("__sigma") * F.sqrt(steps), self.cfg)).drop("__sigma")


def band(spread: Column, cfg: ForecastConfig = DEFAULTS) -> Column:
    """Sorted return quantiles of a log-normal move with the given log standard deviation."""
    z = [0.0 if q == 0.5 else NormalDist().inv_cdf(q) for q in cfg.quantiles]
    return F.sort_array(F.array(*[F.exp(spread * v) - 1 for v in z]))


def quantile_paths(anchors: DataFrame, steps: int | list[int], cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """Step-by-step log-price quantiles (ticker, end_date, step, path) from anchors that carry
    log_price and sigma. `steps` is the last step, or a list of the steps wanted."""
    z = [0.0 if q == 0.5 else NormalDist().inv_cdf(q) for q in cfg.quantiles]
    wanted = F.sequence(F.lit(1), F.lit(steps)) if isinstance(steps, int) else F.array(*[F.lit(s) for s in steps])
    each = anchors.select("ticker", "end_date", "log_price", "sigma", F.explode(wanted).alias("step"))
    path = F.array(*[F.col("log_price") + F.col("sigma") * F.sqrt("step") * v for v in z])
    return each.select("ticker", "end_date", "log_price", "step", path.alias("path"))


def paths_to_returns(paths: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """Return quantiles at each horizon from log-price quantile paths, sorted per row."""
    horizon = reduce(
        lambda out, item: out.when(F.col("step") == item[1], item[0]),
        list(cfg.horizons.items())[1:],
        F.when(F.col("step") == list(cfg.horizons.values())[0], list(cfg.horizons)[0]),
    )
    at_horizon = paths.where(F.col("step").isin(list(cfg.horizons.values())))
    returns = F.transform("path", lambda p: F.exp(p - F.col("log_price")) - 1)
    return at_horizon.select("ticker", "end_date", horizon.alias("horizon"), F.sort_array(returns).alias("q"))


def realised_volatility(returns: DataFrame, horizon: int) -> DataFrame:
    """(ticker, volatility): sample sd of the returns, scaled to the horizon."""
    return returns.where(F.col("r").isNotNull()).groupBy("ticker").agg(
        (F.stddev_samp("r") * F.sqrt(F.lit(float(horizon)))).alias("volatility")
    )


def squared_shocks(returns: DataFrame, betas: list[float], order: str = "date") -> DataFrame:
    """Per return its square __x, the ticker's mean square __v, its number __t from 1, __last for the newest, and for each
    beta i the decayed sum of squares with it (__d{i}) and before it (__l{i})."""
    whole, w = Window.partitionBy("ticker"), series(order=order)
    base = returns.where(F.col("r").isNotNull()).select("ticker", order, "r")
    squared = base.select(
        "*",
        (F.col("r") * F.col("r")).alias("__x"),
        F.avg(F.col("r") * F.col("r")).over(whole).alias("__v"),
        F.row_number().over(w).alias("__t"),
        (F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc(order))) == 1).alias("__last"),
    )
    shocks = with_decay(in_blocks(squared, order=order), [Decay(f"__d{i}", "__x", b) for i, b in enumerate(betas)], order=order)
    return shocks.select("*", *[F.coalesce(F.lag(f"__d{i}").over(w), F.lit(0.0)).alias(f"__l{i}") for i in range(len(betas))])


def garch_volatility(returns: DataFrame, horizon: int, order: str = "date") -> DataFrame:
    """(ticker, alpha, beta, volatility): h-step volatility of a GARCH(1,1) per ticker.

    The long-run variance is the ticker's mean squared return, and (alpha, beta) is the grid
    point of highest Gaussian likelihood. The conditional variance is linear in alpha given
    a decayed sum of squared returns, so one recurrence per beta serves the whole grid and
    the fit is window sums plus one aggregation. A ticker whose likelihood is undefined
    falls back to the realised volatility.
    """
    betas = sorted({b for _, b in GARCH_GRID})
    lagged = squared_shocks(returns, betas, order)

    def variance(alpha: float, beta: float, decayed: Column, steps: Column) -> Column:
        # s[t] = omega + alpha x[t-1] + beta s[t-1], s[1] = v, omega = v (1 - alpha - beta)
        kept = F.pow(F.lit(beta), steps)
        constant = F.col("__v") * (1 - alpha - beta) * (F.lit(1) - kept) / (1 - beta)
        return constant + decayed * alpha + F.col("__v") * kept

    candidates = []
    for alpha, beta in GARCH_GRID:
        i = betas.index(beta)
        now = variance(alpha, beta, F.col(f"__l{i}"), F.col("__t") - 1)
        ahead = variance(alpha, beta, F.col(f"__d{i}"), F.col("__t"))
        # No positive variance, no likelihood: the candidate drops out.
        loss = F.sum(F.when(now > 0, F.ln(now) + F.col("__x") / now))
        persistence = alpha + beta
        growth = (1 - persistence**horizon) / (1 - persistence)
        v = F.max("__v")
        path_sum = v * horizon + (F.max(F.when(F.col("__last"), ahead)) - v) * growth
        candidates.append(
            F.struct(loss.alias("loss"), F.lit(alpha).alias("alpha"), F.lit(beta).alias("beta"), F.sqrt(path_sum).alias("volatility"))
        )
    fitted = lagged.groupBy("ticker").agg(
        F.array(*candidates).alias("grid"), (F.stddev_samp("r") * F.sqrt(F.lit(float(horizon)))).alias("realised")
    )
    best = F.array_min(F.filter("grid", lambda g: g["loss"].isNotNull()))
    return fitted.select("ticker", best.alias("best"), "realised").select(
        "ticker", "best.alpha", "best.beta", F.coalesce("best.volatility", "realised").alias("volatility")
    )
