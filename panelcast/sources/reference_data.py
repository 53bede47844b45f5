"""Constituent metadata and the stored metrics document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.config import DEFAULTS, ForecastConfig
from panelcast.schemas import METRICS_DOC


def constituents(table: DataFrame) -> DataFrame:
    """(ticker, name, sector) from a constituents table.

    The preferred headings are used where present; otherwise the second column is the name
    and the fourth the sector.
    """
    name = "Security" if "Security" in table.columns else table.columns[1]
    sector = "GICS Sector" if "GICS Sector" in table.columns else table.columns[3]

    def text(c: str):
        return F.col(f"`{c}`").cast("string")

    return table.select(text("Symbol").alias("ticker"), text(name).alias("name"), text(sector).alias("sector"))


def read_metrics_params(spark: SparkSession, path: str, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """(horizon, w, delta) from a metrics document; missing entries default to 1 and 0."""
    return metrics_params(spark.read.schema(METRICS_DOC).json(path, multiLine=True), cfg)


def metrics_params(doc: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    horizon = F.explode(F.array(*[F.lit(h) for h in cfg.horizons])).alias("horizon")
    return doc.select(horizon, "blend_weight", "conformal_delta").select(
        "horizon",
        F.coalesce(F.try_element_at("blend_weight", F.col("horizon")), F.lit(1.0)).alias("w"),
        F.coalesce(F.try_element_at("conformal_delta", F.col("horizon")), F.lit(0.0)).alias("delta"),
    )
