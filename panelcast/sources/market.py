"""The market-wide series joined to every ticker: a volatility index and index returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelcast.functions.windows import forward_fill
from panelcast.schemas import MARKET


def read_market(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MARKET).parquet(path)


def derive_market(index_close: DataFrame, volatility: DataFrame) -> DataFrame:
    """Market series on the dates of the index.

    Both inputs are (date, Close). The volatility close is matched by date and carried
    forward over gaps; index returns look back 21 and 63 index rows and are not filled.
    """
    # One row per calendar day at most, so an unpartitioned window over it stays small.
    by_date = Window.partitionBy(F.lit(0)).orderBy("date")
    index_close = index_close.where(F.col("Close").isNotNull())
    aligned = index_close.join(
        volatility.where(F.col("Close").isNotNull()).select("date", F.col("Close").alias("vix")), "date", "left"
    )

    def change(rows: int):
        return F.col("Close") / F.lag("Close", rows).over(by_date) - 1

    return aligned.select(
        "date",
        forward_fill("vix", by_date).alias("vix_close"),
        change(21).alias("sp500_ret_21d"),
        change(63).alias("sp500_ret_63d"),
    )
