"""Exact quantiles of very large groups without collecting or sorting them."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

BINS = 256  # bins to a factor of e: neighbours in a bin differ by 0.4 % at most
_LOGS = (-746.0, 710.0)  # of all positive finite doubles
_ZERO = int(-_LOGS[0]) * BINS
_NAN = 4 * _ZERO


def _bin(y: Column) -> Column:
    """A whole number that never falls as y rises, over all doubles; logarithms are semi-monotonic by their specification."""

    def size(v: Column) -> Column:
        return F.floor(F.greatest(F.least(F.ln(v), F.lit(_LOGS[1])), F.lit(_LOGS[0])) * BINS) + _ZERO

    return F.when(F.isnan(y), F.lit(_NAN)).when(y > 0, size(y)).when(y < 0, -size(-y)).otherwise(0).cast("int")


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    levels: list[float],
    adjust: Callable[[Column, float], Column] | None = None,
) -> DataFrame:
    """(keys..., level, n, value): linearly interpolated quantiles per group.

    The group count must be small and configured (folds x horizons); group sizes may be
    anything. Two passes, each with map-side partial results and a small shuffle:

    1. rows are counted by bins on a logarithmic scale, which says in which bins the wanted order statistics lie;
    2. rows of these bins (a few in 10,000 each, unless values repeat) are grouped by value, and the wanted ranks
       are read off the cumulative counts.

    `adjust` turns (n, level) into the level really used, for finite-sample corrections.
    """
    target = adjust or (lambda n, level: F.lit(level))
    binned = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"), _bin(F.col(value).cast("double")).alias("bin"))
    # At most some ten thousand bins for each configured group, whatever the number of rows.
    bins = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy(*keys)
    placed = bins.select(
        *keys, "bin", F.sum("c").over(group).alias("n"),
        F.sum("c").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("end"), "c")
    ranks = F.array(*[F.struct(F.lit(p).alias("level"), ((F.col("n") - 1) * target(F.col("n"), p)).alias("rank")) for p in levels])

    def holds(rank: Column, start: Column, end: Column) -> Column:
        return (start <= rank) & (rank < end)

    def wanted(start: Column, end: Column) -> Callable[[Column], Column]:
        return lambda r: holds(F.floor(r["rank"]), start, end) | holds(F.ceil(r["rank"]), start, end)

    start = F.col("end") - F.col("c")
    asked = placed.select(*keys, "bin", "n", start.alias("before"), F.filter(ranks, wanted(start, F.col("end"))).alias("ranks")).where(F.size("ranks") > 0)
    # Two bins at most for each group and level: the broadcast does not grow with the data.
    values = binned.join(F.broadcast(asked.select(*keys, "bin")), [*keys, "bin"]).groupBy(*keys, "bin", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*keys, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counted = values.select(*keys, "bin", "v", "c", F.sum("c").over(upto).alias("upto")).join(F.broadcast(asked), [*keys, "bin"])
    end = F.col("before") + F.col("upto")
    hits = counted.select(*keys, "n", "v", (end - F.col("c")).alias("start"), end.alias("end"), F.explode("ranks").alias("r")).select("*", "r.level", "r.rank")

    def pick(rank: Column) -> Column:
        return F.max(F.when(holds(rank, F.col("start"), F.col("end")), F.col("v")))

    found = hits.groupBy(*keys, "n", "level", "rank").agg(pick(F.floor("rank")).alias("a"), pick(F.ceil("rank")).alias("b"))
    part = F.col("rank") - F.floor("rank")
    exact = F.when(
        F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a") + (F.col("b") - F.col("a")) * part
    ).otherwise(F.raise_error(F.lit("quantile bins missed a rank")).cast("double"))
    return found.select(*keys, "level", "n", exact.alias(value))
