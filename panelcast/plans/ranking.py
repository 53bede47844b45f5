"""Exact positions and ranks inside groups of any size.

Groups up to a checked size use a plain window. Larger ones are range-partitioned on
(group, order), so one group spreads over many tasks; positions inside a partition plus the
sizes of the partitions before it give exact global positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.config import DEFAULTS
from panelcast.plans.materialize import broadcast_if_small, materialize

_INDEX_BITS = 33  # monotonically_increasing_id keeps the row index in its low 33 bits


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows in the biggest group: one pass that shuffles only per-task counts."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def with_position(
    df: DataFrame, keys: list[str], order: list[Column | str], out: str, max_group_rows: int = DEFAULTS.max_group_rows
) -> DataFrame:
    """Append the 1-based position of each row in its group under a total order."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if largest_group(df, keys) <= max_group_rows:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)).cast("long"))
    return _spread_position(df, keys, order, out)


def _spread_position(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    tagged = df.orderBy(*keys, *order).withColumn("__at", F.monotonically_increasing_id())
    # Sorted once and written: range bounds are sampled, so a recomputation could move them.
    stable = materialize(tagged, "sorted").select(
        *df.columns,
        F.shiftright("__at", _INDEX_BITS).alias("__part"),
        F.col("__at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)).alias("__index"),
    )
    parts = stable.groupBy(*keys, "__part").agg(F.min("__index").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "__part", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    joined = stable.join(broadcast_if_small(offsets), [*keys, "__part"])
    position = (F.col("__before") + F.col("__index") - F.col("__first") + 1).cast("long")
    return joined.select(*df.columns, position.alias(out))


def with_average_rank(
    df: DataFrame, keys: list[str], value: str, out: str, max_group_rows: int = DEFAULTS.max_group_rows
) -> DataFrame:
    """Append the rank of value in its group; ties share the mean of their positions."""
    largest = largest_group(df, keys)
    if largest <= max_group_rows:
        ordered = Window.partitionBy(*keys).orderBy(value)
        ties = Window.partitionBy(*keys, value)
        return df.withColumn(out, F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2)
    return _spread_average_rank(df, keys, value, out, largest)


def _spread_average_rank(df: DataFrame, keys: list[str], value: str, out: str, largest: int) -> DataFrame:
    """Distinct values are counted first, so ties collapse before anything is ranked. The
    mean rank of a value is then attached to its rows. Values held by very many rows, of
    which there can only be few, go through a broadcast; the rest join evenly.
    """
    values = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = materialize(_with_running_total(values, keys, value), "ranks")
    rank = F.col("__upto") - (F.col("__c") - 1) / 2
    heavy_from = max(10_000, largest // 1_000)
    table = ranked.select(*keys, value, rank.alias(out), (F.col("__c") >= heavy_from).alias("__heavy"))
    # At most 1,000 values per group can be this common.
    heavy = table.where("__heavy").select(*keys, value, F.col(out).alias("__common"))
    light = table.where(~F.col("__heavy")).select(*keys, value, out)
    common = df.join(F.broadcast(heavy), [*keys, value], "left")
    rare = common.where(F.col("__common").isNull()).drop("__common").join(light, [*keys, value])
    often = common.where(F.col("__common").isNotNull()).withColumnRenamed("__common", out)
    return rare.select(*df.columns, out).unionByName(often.select(*df.columns, out))


def _with_running_total(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Append __upto: rows of the group with this value or a smaller one."""
    tagged = values.orderBy(*keys, value).withColumn("__part", F.shiftright(F.monotonically_increasing_id(), _INDEX_BITS))
    stable = materialize(tagged, "values")
    parts = stable.groupBy(*keys, "__part").agg(F.sum("__c").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    running = stable.withColumn("__in", F.sum("__c").over(inside))
    return running.join(broadcast_if_small(offsets), [*keys, "__part"]).select(
        *keys, value, "__c", (F.col("__before") + F.col("__in")).alias("__upto")
    )
