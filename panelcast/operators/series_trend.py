"""A series forecaster with shape: damped drift per ticker, its parameters chosen from each anchor's own past.

The log price moves by r[t] = phi b[t-1] + e[t] and its drift by b[t] = phi b[t-1] + beta e[t]. So b is a decayed sum of
returns, kept at phi (1 - beta): a recurrence that `with_decay` computes for every row at once. A positive beta follows a
trend, a negative one expects part of a move back, and the candidate without drift is a random walk.

Nothing is fitted apart: each row holds the squared errors so far of every candidate, so the likelihood of any anchor's
past is read off at the anchor, and no anchor can see a later row. A candidate replaces the random walk only where its
likelihood pays for two parameters (Schwarz's criterion). Means and variances of any step are closed forms.

Defined results: closes that are null or not positive are skipped; fewer than `rows` returns give a null band; a series
that never moves has a band of width zero; an empty table stays empty.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from panelcast.config import DEFAULTS, ForecastConfig
from panelcast.functions.windows import Decay, in_blocks, series, so_far, with_decay
from panelcast.operators.series_vol import log_prices
from panelcast.plans.asof import asof_rows
from panelcast.plans.dealing import dealt

# The (phi, beta) candidates besides the random walk.
DRIFT_GRID = (
    (0.80, -0.10), (0.80, 0.05), (0.80, 0.15),
    (0.90, -0.05), (0.90, 0.05), (0.90, 0.15),
    (0.97, 0.02), (0.97, 0.05),
)
STATE = ["log_price", "phi", "beta", "drift", "sigma"]


def drift_states(bars: DataFrame, rows: int = 252) -> DataFrame:
    """(ticker, date, log_price, phi, beta, drift, sigma): what the rows up to each date say of the next step.

    sigma is the root mean square of the chosen candidate's last `rows` errors.
    """
    w = series()
    moves = log_prices(dealt(bars)).withColumn("__r", F.col("log_price") - F.lag("log_price").over(w)).where("__r IS NOT NULL")
    decays = [Decay(f"__b{i}", F.col("__r") * beta, phi * (1 - beta)) for i, (phi, beta) in enumerate(DRIFT_GRID)]
    drifts = with_decay(in_blocks(moves), decays)
    errors = {"__e": F.col("__r")}
    for i, (phi, _) in enumerate(DRIFT_GRID):
        errors[f"__e{i}"] = F.col("__r") - phi * F.coalesce(F.lag(f"__b{i}").over(w), F.lit(0.0))
    missed = drifts.withColumns(errors).withColumn("__n", F.row_number().over(w).cast("double"))
    sums = missed.withColumns({f"__s{c}": F.sum(F.col(c) * F.col(c)).over(so_far(w)) for c in errors})

    def candidate(phi: float, beta: float, drift: Column, error: str) -> Column:
        recent = F.col(f"__s{error}") - F.coalesce(F.lag(f"__s{error}", rows).over(w), F.lit(0.0))
        return F.struct(
            F.col(f"__s{error}").alias("loss"), F.lit(phi).alias("phi"), F.lit(beta).alias("beta"), drift.alias("drift"),
            F.sqrt(F.greatest(recent, F.lit(0.0)) / rows).alias("sigma"))

    still = candidate(0.0, 0.0, F.lit(0.0), "__e")
    moving = F.array(*[candidate(phi, beta, F.col(f"__b{i}"), f"__e{i}") for i, (phi, beta) in enumerate(DRIFT_GRID)])
    known = sums.select("ticker", "date", "log_price", "__n", still.alias("__still"), moving.alias("__moving"))
    known = known.withColumn("__best", F.array_min("__moving"))
    pays = F.col("__best.loss") * F.pow("__n", 2 / F.col("__n")) < F.col("__still.loss")
    chosen = known.withColumn("__of", F.when(pays, F.col("__best")).otherwise(F.col("__still")))
    return chosen.select(
        "ticker", "date", "log_price", "__of.phi", "__of.beta", "__of.drift",
        F.when(F.col("__n") >= rows, F.col("__of.sigma")).alias("sigma"))


def expected_move(steps: Column) -> Column:
    """Mean log return over the next steps, from the columns of `STATE`."""
    return F.col("drift") * F.col("phi") * (1 - F.pow("phi", steps)) / (1 - F.col("phi"))


def move_spread(steps: Column) -> Column:
    """Standard deviation of the log return over the next steps: an error also moves the drift of all steps after it."""
    phi, pull = F.col("phi"), F.col("beta") * F.col("phi") / (1 - F.col("phi"))
    fading = (1 - F.pow("phi", steps)) / (1 - phi)
    fading_squared = (1 - F.pow("phi", 2 * steps)) / (1 - phi * phi)
    return F.col("sigma") * F.sqrt((1 + pull) * (1 + pull) * steps - 2 * (1 + pull) * pull * fading + pull * pull * fading_squared)


def _levels(steps: Column, cfg: ForecastConfig) -> Column:
    z = [0.0 if q == 0.5 else NormalDist().inv_cdf(q) for q in cfg.quantiles]
    return F.array(*[expected_move(steps) + move_spread(steps) * v for v in z])


def drift_paths(anchors: DataFrame, steps: int | list[int], cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """Step-by-step log-price quantiles (ticker, end_date, log_price, step, path) from anchors that carry `STATE`.
    `steps` is the last step, or a list of the steps wanted."""
    wanted = F.sequence(F.lit(1), F.lit(steps)) if isinstance(steps, int) else F.array(*[F.lit(s) for s in steps])
    each = anchors.select("ticker", "end_date", *STATE, F.explode(wanted).alias("step"))
    path = F.transform(_levels(F.col("step").cast("double"), cfg), lambda v: v + F.col("log_price"))
    return each.select("ticker", "end_date", "log_price", "step", path.alias("path"))


class SeriesTrend:
    """Return quantiles that follow the series' own drift; `fit` keeps the states of its whole price history."""

    name = "series_trend"

    def __init__(self, cfg: ForecastConfig = DEFAULTS, rows: int = 252):
        self.cfg, self.rows = cfg, rows
        self.states: DataFrame | None = None

    def fit(self, bars: DataFrame) -> "SeriesTrend":
        self.states = drift_states(bars, self.rows)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """An anchor on a day without a bar takes the last bar before it; without one its band is null."""
        known = asof_rows(rows, self.states, STATE[1:]).drop("seen")
        steps = F.element_at(F.create_map(*[x for h, n in self.cfg.horizons.items() for x in (F.lit(h), F.lit(float(n)))]), F.col("horizon"))
        returns = F.sort_array(F.transform(_levels(steps, self.cfg), lambda v: F.exp(v) - 1))
        joined = rows.join(known, ["ticker", "end_date"], "left").withColumn(self.name, returns)
        return joined.drop(*STATE[1:])
