"""Blending two forecasters and calibrating the band, per horizon.

Predictions sit side by side on a row as quantile arrays, so blending is arithmetic on
columns and needs no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelcast.config import DEFAULTS, ForecastConfig
from panelcast.functions.numbers import col
from panelcast.operators.metrics import pinball_loss
from panelcast.plans.quantiles import exact_quantiles


def blend(a: str | Column, b: str | Column, w: Column, size: int | None = None) -> Column:
    """w a + (1 - w) b per quantile, re-sorted so quantiles never cross, for arrays of any length.

    With a known size it is written element by element, which stays in generated code.
    """
    a, b = col(a), col(b)
    if size is None:
        return F.sort_array(F.zip_with(a, b, lambda x, y: w * x + (F.lit(1.0) - w) * y))
    return F.sort_array(F.array(*[w * a[i] + (F.lit(1.0) - w) * b[i] for i in range(size)]))


def fit_blend_weights(preds: DataFrame, a: str, b: str, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """(horizon, w): the grid weight with the lowest mean pinball loss; lowest weight wins ties.

    All grid losses are averaged side by side in one aggregation; rows are not multiplied.
    """
    steps = cfg.blend_steps
    weights = [i / steps for i in range(steps + 1)]
    losses = [
        F.avg(pinball_loss(F.col("y"), blend(a, b, F.lit(w), len(cfg.quantiles)), cfg.quantiles)).alias(f"l{i}") for i, w in enumerate(weights)
    ]
    scored = preds.groupBy("horizon").agg(*losses)
    curve = F.array(*[F.col(f"l{i}") for i in range(len(weights))])
    best = F.array_position(curve, F.array_min(curve))
    weight = F.array(*[F.lit(w) for w in weights])
    return scored.select("horizon", F.coalesce(F.try_element_at(weight, best.cast("int")), F.lit(1.0)).alias("w"))


def fit_conformal(preds: DataFrame, band: str, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """(horizon, delta): how far to move both band edges for 1 - alpha coverage.

    An outcome's miss is its signed distance beyond the nearer edge; delta is the (1 - alpha)
    quantile of the misses, at the level corrected for their number.
    """
    last = len(cfg.quantiles) - 1
    score = F.greatest(F.col(band)[0] - F.col("y"), F.col("y") - F.col(band)[last])
    corrected = lambda n, level: F.least(F.lit(1.0), F.ceil((n + 1) * level) / n)
    fitted = exact_quantiles(preds.select("horizon", score.alias("delta")), ["horizon"], "delta", [1.0 - cfg.alpha], corrected)
    return fitted.select("horizon", "delta")


def apply_conformal(q: str | Column, delta: Column) -> Column:
    q = col(q)
    return F.sort_array(
        F.transform(q, lambda v, i: F.when(i == 0, v - delta).when(i == F.size(q) - 1, v + delta).otherwise(v))
    )


def fit_ensemble(preds: DataFrame, a: str, b: str, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """(horizon, w, delta) fitted on the validation split only.

    Without a validation split (a single fold) the weight is fitted on the test rows and no
    calibration is made: delta is null. A horizon whose blended bands are all null keeps its weight, with a null
    delta.
    """
    validation = preds.where(F.col("split") == "val")
    if validation.isEmpty():
        return fit_blend_weights(preds, a, b, cfg).withColumn("delta", F.lit(None).cast("double"))
    weights = fit_blend_weights(validation, a, b, cfg)
    blended = validation.join(F.broadcast(weights), "horizon").withColumn("__q", blend(a, b, F.col("w"), len(cfg.quantiles)))
    return weights.join(fit_conformal(blended, "__q", cfg), "horizon", "left")


def apply_ensemble(preds: DataFrame, params: DataFrame, a: str, b: str, out: str = "ensemble") -> DataFrame:
    """Append the blended, calibrated quantiles at all levels present. params has one row per horizon."""
    joined = preds.join(F.broadcast(params.select("horizon", "w", "delta")), "horizon", "left")
    mixed = blend(a, b, F.coalesce("w", F.lit(1.0)))
    return joined.withColumn(out, apply_conformal(mixed, F.coalesce("delta", F.lit(0.0)))).drop("w", "delta")


def align_predictions(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """Put two separately stored prediction tables (…, q) side by side, matched by key."""
    key = ["ticker", "end_date", "horizon"]
    return a.withColumnRenamed("q", name_a).join(b.select(*key, F.col("q").alias(name_b)), key)
