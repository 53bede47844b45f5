"""Rolling statistics and recurrences of one series, held as NumPy vectors of doubles; NaN stands for null.

No result is a difference of running sums, so early values never blur later ones. Sums add up in the order of the windows in
functions/windows.py, whose results these are to the last bit (averages given Spark's own powers, see `powers_of`).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import SparkSession, functions as F

from panelcast.functions.windows import tile_factors


def shifted(x: np.ndarray, k: int) -> np.ndarray:
    """The value k rows before (k > 0) or -k rows after (k < 0), NaN beyond the ends."""
    out = np.full(len(x), np.nan)
    if 0 <= k < len(x):
        out[k:] = x[: len(x) - k]
    elif -len(x) < k < 0:
        out[:k] = x[-k:]
    return out


def rolling_sum(x: np.ndarray, n: int) -> np.ndarray:
    """Of the last n rows, NaN unless all n are there."""
    first, *parts = tile_factors(n)
    out, rows = np.full(len(x), np.nan), len(x) - first + 1
    if rows > 0:
        out[first - 1 :] = x[:rows]
        for k in range(1, first):
            out[first - 1 :] += x[k : k + rows]
    width = first
    for p in parts:
        tile = out
        for k in range(1, p):
            out = out + shifted(tile, width * k)
        width *= p
    return out


def rolling_mean(x: np.ndarray, n: int) -> np.ndarray:
    return rolling_sum(x, n) / n


def rolling_extreme(x: np.ndarray, op: np.ufunc, n: int) -> np.ndarray:
    """np.maximum or np.minimum of the last n rows, NaN unless all n are there: frames of 1, 2, 4, ... rows, which may overlap."""
    width = 1
    while 2 * width <= n:
        x, width = op(x, shifted(x, width)), 2 * width
    return op(x, shifted(x, n - width)) if n > width else x


def rolling_deviation(x: np.ndarray, n: int) -> np.ndarray:
    """The sample standard deviation of the last n rows."""
    out, rows = np.full(len(x), np.nan), len(x) - n + 1
    if rows > 0:
        mean, squares = np.zeros(rows), np.zeros(rows)
        for k in range(n):
            gap = x[k : k + rows] - mean
            step = gap / (k + 1.0)
            mean += step
            squares += gap * (gap - step)
        out[n - 1 :] = np.sqrt(squares / (n - 1.0))
    return out


BLOCK = 256  # rows of a block of a recurrence
Powers = dict[float, np.ndarray]  # by base, from 0 to BLOCK


def keep_of(span: int) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def powers_of(spark: SparkSession, spans: tuple[int, ...]) -> Powers:
    """The powers that averages of these spans are made of, from Spark: its power function is the JVM's strict one, which differs
    in the last bit from the C library's."""
    bases = tuple(b for span in spans for b in (keep_of(span), 1 / keep_of(span)))
    if bases not in _POWERS:
        rows = spark.range(BLOCK + 1).select("id", *[F.pow(F.lit(b), F.col("id")).alias(f"p{k}") for k, b in enumerate(bases)]).collect()
        found = np.array(sorted(rows))
        _POWERS[bases] = {b: found[:, k + 1] for k, b in enumerate(bases)}
    return _POWERS[bases]


_POWERS: dict[tuple[float, ...], Powers] = {}


def decayed(x: np.ndarray, keep: float, powers: Powers | None = None) -> np.ndarray:
    """out[t] = keep * out[t-1] + x[t], from out[0] = x[0]: scaled prefix sums within blocks, and a carry from block to block that
    is cut where its weight drops below 1e-18. NaN counts as zero."""
    speed, block = -math.log(keep), BLOCK
    if speed * block > 600:
        raise ValueError("block too long for this decay: keep**-block would overflow")
    known = powers or {b: np.array([math.pow(b, i) for i in range(block + 1)]) for b in (keep, 1 / keep)}
    blocks, fade, grow = -(-len(x) // block), known[keep], known[1 / keep]
    padded = np.zeros(blocks * block)
    padded[: len(x)] = np.where(np.isnan(x), 0.0, x)
    out = fade[:-1] * np.cumsum(padded.reshape(blocks, block) * grow[:-1], axis=1)
    ends = out[:, -1].copy()
    carry = ends.copy()
    for k in range(1, math.ceil(41.5 / (speed * block)) + 1):
        carry[k:] += ends[:-k] * keep ** (block * k)
    out[1:] += carry[:-1, None] * fade[1:]
    return out.ravel()[: len(x)]


def ewm(x: np.ndarray, span: int, powers: Powers | None = None) -> np.ndarray:
    """Recursive moving average: it starts at the first value, then moves by 2 / (span + 1) of the gap. NaN before any value."""
    step = 2.0 / (span + 1.0)
    source = x * step
    source[:1] = x[:1]
    out = decayed(source, keep_of(span), powers)
    if len(x) and np.isnan(x[0]):
        out[np.cumsum(~np.isnan(x)) == 0] = np.nan
    return out


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN where b is zero."""
    return np.divide(a, b, out=np.full(len(b), np.nan), where=b != 0)
