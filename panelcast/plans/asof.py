"""As-of joins: for each anchor the last row of its series up to the anchor's date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelcast.plans.materialize import broadcast_if_small


def next_dates(dates: DataFrame, at: str) -> DataFrame:
    """(day, next): for every day from the first of the dates to the last, the first of the dates that is not before it.

    Bounded by the calendar, as its window is.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("n")
    known = dates.select(F.unix_date(at).alias("n")).where(F.col("n").isNotNull()).distinct()
    spans = known.select("n", F.coalesce(F.lag("n").over(order) + 1, F.col("n")).alias("lo"))
    days = spans.select(F.explode(F.sequence("lo", "n")).alias("day"), F.date_from_unix_date("n").alias("next"))
    return days.select(F.date_from_unix_date("day").alias("day"), "next")


def visible_rows(history: DataFrame, anchors: DataFrame, later: str, key: str = "ticker", at: str = "end_date", date: str = "date") -> DataFrame:
    """The history rows that a frame of rows may hold which ends at the last row that some anchor of their key sees.

    `later` is the date of the first row after all whose frames hold a row, null near the end of a series: where it is not after the
    key's first anchor date, no frame that is asked for reaches back that far. Rows after the key's last anchor date are seen by none.
    """
    asked = anchors.where(F.col(at).isNotNull()).groupBy(key).agg(F.min(at).alias("__first"), F.max(at).alias("__final"))
    early, late = (F.coalesce(c, F.lit(False)) for c in (F.col(later) <= F.col("__first"), F.col(date) > F.col("__final")))
    return history.join(broadcast_if_small(asked), key).where(~early & ~late).select(*history.columns)


def reachable_rows(history: DataFrame, anchors: DataFrame, key: str, at: str, date: str) -> DataFrame:
    """The history rows that some anchor date may see: those that a row of the same key does not follow before the next date
    that any anchor has. Where anchors are month ends that is a few rows in a hundred, so few go on to the as-of exchange;
    the window is in the order in which series are computed, so it needs neither a sort nor an exchange after them and is taken
    together with their last one. Rows without a key or date are left out: those without a date come first, before any that count."""
    calendar = next_dates(anchors, at)
    first = calendar.agg(F.min("next")).scalar()
    following = F.lead(date).over(Window.partitionBy(key).orderBy(date))
    placed = history.withColumn("__following", following).join(F.broadcast(calendar), F.col(date) == F.col("day"), "left")
    asked = F.coalesce("next", F.when(F.col(date) < first, first))
    return placed.where(F.col(key).isNotNull() & F.col(date).isNotNull() & asked.isNotNull() & (F.col("__following").isNull() | (F.col("__following") > asked))).select(*history.columns)


def asof_rows(anchors: DataFrame, history: DataFrame, columns: list[str], key: str = "ticker", at: str = "end_date", date: str = "date") -> DataFrame:
    """(key, at, columns..., seen): one row for each distinct anchor (key, at), with the columns of the last history row
    dated at or before it and that row's date; nulls where there is none.

    Anchors and history are one tagged table: a window per key carries the last history row forward. A key has at most one
    history row and one distinct anchor per calendar day, which bounds the window. Null keys or dates match nothing. `at` and
    `date` are dates. History rows that no anchor date can see are left out before the exchange.
    """
    history = reachable_rows(history, anchors, key, at, date)
    row = F.struct(*columns, F.col(date).alias("seen"))
    told = history.select(key, F.col(date).alias(at), row.alias("__row"), F.lit(0).alias("__tag"))
    asked = anchors.select(key, at).distinct().withColumn("__row", F.lit(None).cast(told.schema["__row"].dataType)).withColumn("__tag", F.lit(1))
    ordered = Window.partitionBy(key).orderBy(F.col(at).asc_nulls_first(), "__tag").rowsBetween(Window.unboundedPreceding, 0)
    carried = told.unionByName(asked).withColumn("__last", F.last("__row", ignorenulls=True).over(ordered))
    return carried.where("__tag = 1").select(key, at, "__last.*")
