"""Scores of quantile forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelcast.config import DEFAULTS, ForecastConfig
from panelcast.functions.numbers import share, total
from panelcast.plans.ranking import with_average_rank
from panelcast.schemas import FEATURES


def pinball_loss(y: Column, q: Column, levels: tuple[float, ...] = DEFAULTS.quantiles) -> Column:
    """Mean over the levels of max(level d, (level - 1) d), with d = y - quantile."""
    losses = [F.greatest((y - q[i]) * level, (y - q[i]) * (level - 1)) for i, level in enumerate(levels)]
    return total(losses) / len(levels)


def covered(y: Column, lo: Column, hi: Column) -> Column:
    return (y >= lo) & (y <= hi)


def same_direction(y: Column, p50: Column) -> Column:
    """Zero counts as up on both sides."""
    return (p50 >= 0) == (y >= 0)


def guarded_correlation(x: str, y: str) -> Column:
    """Aggregate: Pearson correlation, null for fewer than two rows or a constant side."""
    varies = (F.count(F.lit(1)) > 1) & (F.min(x) != F.max(x)) & (F.min(y) != F.max(y))
    return F.when(varies, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def information_coefficient(preds: DataFrame, keys: list[str], cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """(keys..., ic): Spearman correlation of y and p50 pooled over all rows of a group."""
    rows = preds.where(F.col("y").isNotNull() & F.col("p50").isNotNull()).select(*keys, "y", "p50")
    ranked = with_average_rank(rows, keys, "y", "__ry", cfg.max_group_rows)
    ranked = with_average_rank(ranked, keys, "p50", "__rp", cfg.max_group_rows)
    return ranked.groupBy(*keys).agg(guarded_correlation("__ry", "__rp").alias("ic"))


def long_predictions(preds: DataFrame, models: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per (row, model) with its quantile array q."""
    keep = [c for c in preds.columns if c not in models] if keep is None else keep
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("q")) for m in models])
    return preds.select(*keep, F.explode(each).alias("__p")).select(*keep, "__p.model", "__p.q")


def score_table(preds: DataFrame, models: list[str], cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """(model, horizon, pinball, coverage, hit_rate, ic) over the test split."""
    scored = preds.where(F.col("split") == "test") if "split" in preds.columns else preds
    rows = long_predictions(scored, models, keep=["horizon", "y"])
    last, mid = len(cfg.quantiles) - 1, len(cfg.quantiles) // 2
    keys = ["model", "horizon"]
    plain = rows.groupBy(*keys).agg(
        F.avg(pinball_loss(F.col("y"), F.col("q"), cfg.quantiles)).alias("pinball"),
        share(covered(F.col("y"), F.col("q")[0], F.col("q")[last])).alias("coverage"),
        share(same_direction(F.col("y"), F.col("q")[mid])).alias("hit_rate"),
    )
    ic = information_coefficient(rows.select(*keys, "y", F.col("q")[mid].alias("p50")), keys, cfg)
    return plain.join(F.broadcast(ic), keys, "left")  # one row per model and horizon


def drift_reference(panel: DataFrame) -> DataFrame:
    """(feature, mean, std): the distribution of each feature over the whole panel.

    For monitoring only. Do not scale model inputs with it: it has seen the test rows.
    """
    # A few columns per aggregation keep its generated code short enough to be compiled; the
    # scans read disjoint columns, so nothing is read twice.
    parts = []
    for at in range(0, len(FEATURES), 9):
        entries = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")) for c in FEATURES[at : at + 9]]
        parts.append(panel.agg(F.array(*entries).alias("s")).select(F.explode("s").alias("s")).select("s.*"))
    return reduce(DataFrame.unionByName, parts)
