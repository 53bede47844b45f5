"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelcast.functions.numbers import col


def is_weekday(d: str | Column) -> Column:
    return F.weekday(col(d)) < 5


def busday_add(d: str | Column, n: int) -> Column:
    """Date plus n >= 0 business days (Monday to Friday, no holidays).

    A weekend start counts from the Friday before it; adding zero moves a weekend date on
    to Monday.
    """
    d = col(d)
    if n < 0:
        raise ValueError("busday_add expects n >= 0")
    if n == 0:
        return F.date_add(d, F.greatest(F.lit(7) - F.weekday(d), F.lit(0)) * F.when(is_weekday(d), 0).otherwise(1))
    friday_or_day = F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))
    weeks, rest = divmod(n, 5)
    over_weekend = F.when(F.weekday(friday_or_day) + rest > 4, 2).otherwise(0)
    return F.date_add(friday_or_day, F.lit(7 * weeks + rest) + over_weekend)


def month_of(d: str | Column) -> Column:
    return F.trunc(col(d), "month")
