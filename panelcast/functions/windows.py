"""Window helpers for daily series.

Every helper partitions by the series key only, so consecutive steps share one exchange.
A daily series holds at most one row per calendar day (about 36,500 per century) whatever
the table size, because bars are unique per (ticker, date); that bounds a window group.

Long frames are composed from short ones. Spark re-reads the whole frame for each row of a
sliding frame, so a 252-row maximum costs 252 steps a row; as 18 x 14 tiles it costs 32.
Recurrences (exponential smoothing) use scaled prefix sums inside fixed blocks plus a
carry, which is linear in the series length and stays in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from panelcast.functions.numbers import all_set, col, total

BLOCK, POS = "__block", "__pos"


def series(key: str = "ticker", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def forward_fill(c: str | Column, w: WindowSpec) -> Column:
    return F.last(col(c), ignorenulls=True).over(so_far(w))


def full_frame(agg: Column, c: str | Column, w: WindowSpec, n: int) -> Column:
    """Aggregate over the last n rows, null unless all n values are present."""
    frame = last_rows(w, n)
    return F.when(F.count(col(c)).over(frame) == n, agg.over(frame))


@dataclass(frozen=True)
class Rolling:
    """One rolling statistic: kind is 'sum', 'mean', 'max' or 'min' over n rows of source.

    The result is null unless `guard` (the source itself by default) has n non-null values
    in the frame. Sources that are null together should share a guard: it is counted once.
    """

    out: str
    kind: str
    source: str
    n: int
    guard: str | None = None

    def tile(self, width: int) -> str:
        """Name of the partial result over `width` rows, shared between statistics."""
        kind = "sum" if self.kind == "mean" else self.kind
        return f"__{kind}_{self.source}_{self.guard or self.source}_{width}"


_FIRST = {"sum": F.sum, "mean": F.sum, "max": F.max, "min": F.min}


def tile_factors(n: int, largest: int = 8, widest: int = 21) -> list[int]:
    """Split n into factors, the length of the first frame and then the numbers of parts of each level.

    A level is a window of its own, which costs as much as some 50 steps of a frame, so lengths up to `widest` are one frame and
    other products of two such factors two levels, the wider as the frame: a step in it is cheaper than a part. Other lengths
    have factors of at most `largest`, smallest first; a big prime stays whole.
    """
    if n <= widest:
        return [n]
    pairs = [(n // f, f) for f in range(2, widest + 1) if n % f == 0 and f <= n // f <= widest]
    if pairs:
        return list(min(pairs, key=sum))
    factors, rest = [], n
    while rest > largest:
        step = next((f for f in range(5, largest + 1) if rest % f == 0), None)
        if step is None:
            step = next((f for f in range(2, 5) if rest % f == 0), rest)
        factors.append(step)
        rest //= step
    return factors + ([rest] if rest > 1 or not factors else [])


def with_rolling(df: DataFrame, specs: Iterable[Rolling], w: WindowSpec) -> DataFrame:
    """Append rolling statistics, each composed level by level from shared shorter tiles."""
    specs = list(specs)
    plans = [tile_factors(s.n) for s in specs]
    # Counts are columns of their own, so that statistics with one guard share them: Spark would take each mention as another one.
    counts, made, tiles = {}, {}, {}
    for s, p in zip(specs, plans):
        frame, guard, tile = last_rows(w, p[0]), s.guard or s.source, s.tile(p[0])
        n = f"__n_{guard}_{p[0]}"
        counts[n] = F.count(col(guard)).over(frame)
        made[tile] = _FIRST[s.kind](col(s.source)).over(frame)
        tiles[tile] = F.when(F.col(n) == p[0], F.col(f"{tile}_any"))
    stage = df.select("*", *[c.alias(n) for n, c in counts.items()], *[c.alias(f"{n}_any") for n, c in made.items()])
    stage, have = stage.select(*df.columns, *[c.alias(n) for n, c in tiles.items()]), set(made)
    for level in range(1, max(len(p) for p in plans)):
        made = {}
        for s, p in zip(specs, plans):
            if level < len(p):
                stride, width = math.prod(p[:level]), math.prod(p[: level + 1])
                part = s.tile(stride)
                parts = [col(part)] + [F.lag(part, stride * k).over(w) for k in range(1, p[level])]
                made[s.tile(width)] = _combine(s.kind, parts)
        fresh = {n: c for n, c in made.items() if n not in have}
        stage = stage.select("*", *[c.alias(n) for n, c in fresh.items()])
        have |= set(fresh)
    finished = [(col(s.tile(s.n)) / s.n if s.kind == "mean" else col(s.tile(s.n))).alias(s.out) for s in specs]
    return stage.select(*df.columns, *finished)


def _combine(kind: str, parts: Sequence[Column]) -> Column:
    if kind in ("sum", "mean"):
        return total(list(parts))
    pick = F.greatest if kind == "max" else F.least
    return F.when(all_set(list(parts)), pick(*parts))


@dataclass(frozen=True)
class Decay:
    """A linear recurrence out[t] = keep * out[t-1] + source[t], starting from source[0]."""

    out: str
    source: str | Column
    keep: float


def in_blocks(df: DataFrame, block: int = 256, key: str = "ticker", order: str = "date") -> DataFrame:
    """Number each series' rows and cut them into blocks: adds BLOCK and POS columns."""
    at = F.row_number().over(series(key, order)) - 1
    return df.withColumn(POS, at).withColumn(BLOCK, F.floor(F.col(POS) / block)).withColumn(POS, F.col(POS) % block)


def block_series(key: str = "ticker", order: str = "date") -> WindowSpec:
    """The order of `series`, spelled so that per-block windows share its sort."""
    return Window.partitionBy(key).orderBy(BLOCK, order)


def with_decay(df: DataFrame, specs: Iterable[Decay], block: int = 256, key: str = "ticker", order: str = "date") -> DataFrame:
    """Append linear recurrences, exact to double precision, to rows cut by `in_blocks`.

    Inside a block the recurrence is a prefix sum of source * keep**-position; the value
    carried in from earlier blocks is a short geometric series of block totals, truncated
    where its weight drops below 1e-18.
    """
    specs = list(specs)
    names = df.columns
    speeds = [-math.log(s.keep) for s in specs]
    if max(speeds) * block > 600:
        raise ValueError("block too long for this decay: keep**-block would overflow")
    in_block = Window.partitionBy(key, BLOCK).orderBy(order)
    across = block_series(key, order)

    def power(keep: float, exponent: Column) -> Column:
        return F.pow(F.lit(keep), exponent)

    local = df.select(
        *names,
        *[
            (power(s.keep, F.col(POS)) * F.sum(col(s.source) * power(1 / s.keep, F.col(POS))).over(so_far(in_block))).alias(s.out)
            for s in specs
        ],
    )

    def block_end(s: Decay, speed: float) -> Column:
        reach = math.ceil(41.5 / (speed * block))
        older = [
            F.coalesce(F.lag(s.out, block * k).over(across), F.lit(0.0)) * (s.keep ** (block * k))
            for k in range(1, reach + 1)
        ]
        return F.when(F.col(POS) == block - 1, total([F.col(s.out), *older])).alias(f"__end_{s.out}")

    ends = local.select("*", *[block_end(s, v) for s, v in zip(specs, speeds)])
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(
        *names,
        *[
            (
                F.col(s.out)
                + F.coalesce(F.last(f"__end_{s.out}", ignorenulls=True).over(before), F.lit(0.0))
                * power(s.keep, F.col(POS) + 1)
            ).alias(s.out)
            for s in specs
        ],
    )


def with_ewm(df: DataFrame, specs: Iterable[tuple[str, str, int]], key: str = "ticker", order: str = "date") -> DataFrame:
    """Append exponential moving averages, given as (out, source, span), to rows cut by
    `in_blocks`.

    Recursive form: starts at the first value, then moves by 2 / (span + 1) of the gap.
    """
    first = (F.col(BLOCK) == 0) & (F.col(POS) == 0)
    decays = []
    for out, source, span in specs:
        step = 2.0 / (span + 1.0)
        decays.append(Decay(out, F.when(first, F.col(source)).otherwise(F.col(source) * step), 1.0 - step))
    return with_decay(df, decays, key=key, order=order)
