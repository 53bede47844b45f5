"""How many tasks a per-ticker plan is dealt over, and tables that stay dealt."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelcast.plans.materialize import materialize

# A daily bar grows to more than a kilobyte in the sorts of the feature plan, so a task then holds about 300 MB.
ROWS_A_TASK = 200_000


def dealt(df: DataFrame, rows: int | None = None, key: str = "ticker") -> DataFrame:
    """df dealt by key over as many tasks as its rows need; windows by that key then need no further exchange.

    Adaptive execution sizes tasks by the shuffled bytes, which are a small part of what window plans make of them: with more
    input it would leave sorts that spill. `rows` is the number of rows that windows will see; by default df is counted,
    which for a written table is a read of its footers. Small tables are left to the session, and so are tables that are dealt already.
    """
    if getattr(df, "dealt_over", (None,))[0] == key:
        return df
    n = df.count() if rows is None else rows
    if n <= ROWS_A_TASK:
        return df
    tasks = max(-(-n // ROWS_A_TASK), df.sparkSession.sparkContext.defaultParallelism)
    return _noted(df.repartition(tasks, key), key, tasks)


def _noted(df: DataFrame, key: str, tasks: int | None) -> DataFrame:
    df.dealt_over = (key, tasks)
    return df


def still_dealt(df: DataFrame, source: DataFrame) -> DataFrame:
    """df, which is made from the rows of source without any exchange and keeps the key: it counts as dealt where source does."""
    return _noted(df, *source.dealt_over) if hasattr(source, "dealt_over") else df


def write_dealt(df: DataFrame, name: str, key: str = "ticker") -> DataFrame:
    """Write df so that it stays dealt: each task writes one bucket, and windows by the key read buckets without an exchange.

    A df that is not dealt, because it is small, is written as it is and left to the session from then on.
    """
    key, tasks = getattr(df, "dealt_over", (key, None))
    return _noted(materialize(df, name, buckets=(tasks, key) if tasks else None), key, tasks)
