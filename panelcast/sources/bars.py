"""Bar sources: cached daily bars, bars built from ticks, and a dense demonstration panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from panelcast.functions.dates import is_weekday
from panelcast.functions.numbers import col, nan_to_null
from panelcast.functions.windows import series, so_far
from panelcast.plans.dealing import dealt, still_dealt
from panelcast.schemas import BARS, OHLCV

WALK = ["v", "open", "close"]  # what a row of a walk carries


def normalise_symbol(c: str | Column) -> Column:
    """Feed spelling of a ticker: dots become dashes, letters upper case."""
    return F.upper(F.replace(col(c), F.lit("."), F.lit("-")))


def read_bars(spark: SparkSession, path: str, ticker_from_file: bool = False) -> DataFrame:
    """Scan the whole bar cache at once.

    The cache is one Parquet table with a ticker column; with `ticker_from_file` it is a
    folder of `<ticker>.parquet` files and the ticker comes from the file name.
    """
    values = [nan_to_null(c).alias(c) for c in OHLCV]
    if not ticker_from_file:
        return spark.read.schema(BARS).parquet(path).select("ticker", "date", *values)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1)
    columns = T.StructType([f for f in BARS.fields if f.name != "ticker"])
    return spark.read.schema(columns).parquet(path).select(stem.alias("ticker"), "date", *values)


def tidy_bars(raw: DataFrame) -> DataFrame:
    """Keep key and OHLCV columns and only complete rows. Order is left to window specs."""
    return raw.select("ticker", "date", *[nan_to_null(F.col(c).cast("double")).alias(c) for c in OHLCV]).na.drop(subset=OHLCV)


def tickers(bars: DataFrame) -> DataFrame:
    return bars.select("ticker").distinct()


def daily_bars(ticks: DataFrame, key: str, ts: str, price: str, quantity: str, order: str | None = None) -> DataFrame:
    """Resample ticks to one bar per key and day.

    One aggregation with map-side partial results, so a key that holds a large part of the
    ticks costs no more than one partial row per task and day. `order` is a single numeric or
    time column (the timestamp by default): with fixed-width state Spark aggregates by hash,
    where a struct would make it sort all ticks.
    """
    at = order or ts
    return ticks.groupBy(F.col(key).alias("ticker"), F.to_date(ts).alias("date")).agg(
        F.min_by(price, at).alias("Open"),
        F.max(price).alias("High"),
        F.min(price).alias("Low"),
        F.max_by(price, at).alias("Close"),
        F.sum(quantity).alias("Volume"),
    )


def spanned_days(days: DataFrame, values: list[str], first: Column, last: Column) -> DataFrame:
    """(ticker, seen, values, lo, hi): the days, as integers, that each row of a ticker stands for: up to the ticker's next row, its
    first row also for the days before, all within [first, last]."""
    w = series()
    return days.select(
        "ticker", "date", *values,
        F.when(F.row_number().over(w) == 1, first).otherwise(F.col("date")).alias("lo"),
        F.date_sub(F.lead("date").over(w), 1).alias("hi"),
    ).select("ticker", F.col("date").alias("seen"), *values, F.unix_date("lo").alias("lo"), F.unix_date(F.coalesce("hi", last)).alias("hi"))


def stretched(spans: DataFrame, values: list[str]) -> DataFrame:
    """A row on every weekday of every span, with the values of the row it comes from and that row's date as `seen`.

    Days are generated, so the calendar is filled without joining tickers to dates. Rows come out in the order of their
    series, where the spans are, and in the same tasks.
    """
    # Days are generated as integers: date sequences step through calendar intervals.
    days = spans.select("ticker", "seen", *values, F.explode(F.sequence("lo", "hi")).alias("date")).withColumn("date", F.date_from_unix_date("date"))
    return days.where(is_weekday("date")).select("ticker", "date", "seen", *values)


def walk_bars(ticks: DataFrame) -> DataFrame:
    """Dense bars per ticker from (ticker, date, price, quantity) ticks."""
    return bars_along(walk_days(ticks))


def walk_days(ticks: DataFrame) -> DataFrame:
    """(ticker, seen, v, open, close, lo, hi): the walk of each ticker along its days with ticks, and the days each stands for.

    Day averages are turned into small return shocks around the ticker's mean, cumulated to
    a price walk that starts near 100. Weekend ticks count for the Friday before. Prices are
    rounded so that quiet days are exactly flat, which the RSI zero-loss rule depends on.
    """
    friday_or_day = F.date_sub("date", F.greatest(F.weekday("date") - 4, F.lit(0)))
    day = ticks.withColumn("date", friday_or_day).groupBy("ticker", "date").agg(F.avg("price").alias("c"), F.sum("quantity").alias("v"))
    # One more scan, of the dates and tickers only: the span and, for the number of tasks, how many rows the dense table has.
    size = ticks.agg(F.approx_count_distinct("ticker").alias("n"), F.min(friday_or_day).alias("first"), F.max(friday_or_day).alias("last")).first()
    first, last = F.lit(size["first"]).cast("date"), F.lit(size["last"]).cast("date")
    day = dealt(day, size["n"] * ((size["last"] - size["first"]).days if size["first"] else 0) * 5 // 7)
    # The walk only moves on days with ticks, so it is taken along those and stretched afterwards: no window and no sort
    # sees the dense rows. A row without a date stretches as a day before all ticks would, and its price counts for nothing.
    w = series()
    c = F.when(F.col("date").isNotNull(), F.col("c"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moves = day.select("ticker", "date", "v", F.coalesce((c / F.avg(c).over(whole) - 1) * 0.02, F.lit(0.0)).alias("shock"))
    start = F.lit(100.0)
    priced = moves.withColumn("close", F.round(F.exp(F.sum("shock").over(so_far(w))) * 100, 4))
    opened = F.coalesce(F.lag("close").over(w), F.when(F.col("date") > first, start), F.col("close"))
    return still_dealt(spanned_days(priced.withColumn("open", opened), WALK, first, last), day)


def bars_along(walk: DataFrame) -> DataFrame:
    """The dense bars of `walk_days`: as cheap to read again as they are to write, and several times smaller as a written walk."""
    start, dense = F.lit(100.0), stretched(walk, WALK)
    at, later = F.col("date") == F.col("seen"), F.col("date") > F.col("seen")
    bars = dense.select(
        "ticker", "date", F.coalesce(F.when(at, F.col("v")), F.lit(0.0)).alias("Volume"),
        F.when(at | later, F.col("close")).otherwise(start).alias("Close"),
        F.when(at, F.col("open")).when(later, F.col("close")).otherwise(start).alias("Open"),
    )
    high = F.greatest("Open", "Close") * (F.lit(1) + (F.lit(1) + F.pmod(F.col("Volume"), F.lit(7))) * 0.001)
    low = F.least("Open", "Close") * (F.lit(1) - (F.lit(1) + F.pmod(F.col("Volume"), F.lit(5))) * 0.001)
    return still_dealt(bars.select("ticker", "date", "Open", high.alias("High"), low.alias("Low"), "Close", "Volume"), walk)
