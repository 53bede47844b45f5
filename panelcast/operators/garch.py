"""GARCH(1,1) by likelihood for all tickers at once, with the constant term free.

s[t] = omega + alpha x[t-1] + beta s[t-1], from the ticker's mean square. Given beta this is linear in omega and alpha over
one decayed sum, so a trial point costs a few operations a row. A ticker's returns are a vector (see plans/along.py): a grid is
tried first, which holds that of `garch_volatility`. From its best point each ticker then searches on its own: every round tries
the eight points around it, and its steps halve once no neighbour is better. A point is replaced by a
likelier one only, so no ticker ends below the grid's stationary points. All rounds of a ticker run in the task that holds it.

Defined results: null returns are skipped; a ticker whose likelihood is undefined (no move at all) has null parameters and
its realised volatility; rows without a ticker keep the best grid point, with no constant term and their realised volatility; an
empty table stays empty.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelcast.functions.vectors import decayed
from panelcast.plans.along import Series, along_series, doubles

# Where the search starts. `LEVELS` are long-run variances as shares of the mean square.
BETAS = (0.70, 0.80, 0.85, 0.88, 0.91, 0.94, 0.965, 0.98)
ALPHAS = (0.03, 0.05, 0.10, 0.18)
LEVELS = (0.5, 1.0, 2.0)
MOST_PERSISTENCE = 0.9995
ROUNDS = 12
FIRST_STEP = math.log(1.5)

Point = tuple[float, float, float, float]  # loss, alpha, beta, level


class _Recursion:
    """The returns of one ticker, for trial points of one beta."""

    def __init__(self, x: np.ndarray, beta: float):
        self.x, self.beta, self.v = x, beta, float(np.mean(x))
        self.decayed = decayed(x, beta)
        kept = beta ** np.arange(len(x) + 1.0)
        self.kept, self.after = kept[:-1], float(kept[-1])
        self.before = np.r_[0.0, self.decayed[:-1]]
        self.free, self.fixed = self.v * (1 - self.kept) / (1 - beta), self.v * self.kept

    def best(self, points: list[tuple[float, float]]) -> Point | None:
        """The likeliest of (alpha, level), ties by the least alpha, then level; None if none has a likelihood."""
        inside = [p for p in points if p[0] + self.beta <= MOST_PERSISTENCE]
        found = [(loss, a, self.beta, level) for (a, level), loss in zip(inside, self.losses(inside)) if not math.isnan(loss)]
        return min(found, default=None)

    def losses(self, points: list[tuple[float, float]]) -> list[float]:
        """Minus twice the log likelihood but for a constant; NaN where no variance is positive."""
        if not points:
            return []
        alpha, level = (np.array(c)[:, None] for c in zip(*points))
        now = (level * (1 - alpha - self.beta)) * self.free + self.fixed + alpha * self.before
        if now.min() > 0:
            return (np.log(now).sum(1) + (self.x / now).sum(1)).tolist()
        there = now > 0
        now = np.where(there, now, 1.0)
        sums = np.where(there, np.log(now) + self.x / now, 0.0).sum(1)
        return np.where(there.any(1), sums, np.nan).tolist()

    def path(self, alpha: float, level: float, horizon: int) -> float:
        """The sum of the variances of the next rows."""
        far, persistence = self.v * level, alpha + self.beta
        ahead = self.v * (level * (1 - persistence) / (1 - self.beta) * (1 - self.after) + self.after) + self.decayed[-1] * alpha
        return far * horizon + (ahead - far) * (1 - persistence**horizon) / (1 - persistence)


def _searched(at: _Recursion, best: Point, rounds: int) -> Point:
    step = FIRST_STEP
    for _ in range(rounds):
        _, alpha, _, level = best
        found = at.best([(alpha * math.exp(step * i), level * math.exp(step * j)) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
        if found and found[0] < best[0]:
            best = found
        else:
            step /= 2
    return best


def _fitted(r: np.ndarray, horizon: int, rounds: int, known: bool) -> dict[str, float]:
    x, nan = r * r, math.nan
    spread = float(np.std(r, ddof=1)) * math.sqrt(horizon) if len(r) > 1 else nan
    grid = [(a, level) for level in LEVELS for a in ALPHAS]
    best, targeted = None, nan
    for beta in BETAS:
        at = _Recursion(x, beta)
        losses = at.losses(grid)
        for (a, level), loss in zip(grid, losses):
            if a + beta <= MOST_PERSISTENCE and not math.isnan(loss):
                best = min(best or (loss, a, beta, level), (loss, a, beta, level))
                targeted = min(loss if math.isnan(targeted) else targeted, loss) if level == 1.0 else targeted
    if best is None:
        return {"omega": nan, "alpha": nan, "beta": nan, "loss": nan, "grid_loss": targeted, "volatility": spread}
    omega = nan
    if known:
        at = _Recursion(x, best[2])
        best = _searched(at, best, rounds)
        omega, spread = at.v * best[3] * (1 - best[1] - best[2]), math.sqrt(at.path(best[1], best[3], horizon))
    return {"omega": omega, "alpha": best[1], "beta": best[2], "loss": best[0], "grid_loss": targeted, "volatility": spread}


def garch_fit(returns: DataFrame, horizon: int, order: str = "date", rounds: int = ROUNDS) -> DataFrame:
    """(ticker, omega, alpha, beta, loss, grid_loss, volatility): the likeliest point found, its loss and that of the best
    grid point with the mean square as long-run variance, and the h-step volatility."""
    def work(s: Series) -> Series | None:
        r = s["r"][~np.isnan(s["r"])]
        return {n: np.array([v]) for n, v in _fitted(r, horizon, rounds, bool(s["known"][0])).items()} if len(r) else None

    rows = returns.select("ticker", order, "r", F.col("ticker").isNotNull().alias("known"))
    return along_series(rows, work, doubles(["omega", "alpha", "beta", "loss", "grid_loss", "volatility"]), order=order)
