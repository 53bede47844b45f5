import math

import numpy as np
import pandas as pd
from hypothesis import given, strategies as st

from panelcast.functions.windows import Decay, Rolling, in_blocks, series, tile_factors, with_decay, with_ewm, with_rolling


@given(st.integers(1, 2000))
def test_tile_factors_multiply_back(n):
    assert math.prod(tile_factors(n)) == n


def long_series(spark, n=1500, nulls=()):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, n)
    rows = [("A", i, None if i in nulls else float(v)) for i, v in enumerate(x)]
    rows += [("B", i, float(v) * 2) for i, v in enumerate(x[:40])]
    df = spark.createDataFrame(rows, "ticker string, date int, x double").repartition(4)
    return df, pd.Series([np.nan if i in nulls else v for i, v in enumerate(x)])


def test_rolling_matches_pandas_with_gaps(spark):
    df, x = long_series(spark, 700, nulls={100, 101, 333})
    specs = [Rolling(f"{k}{n}", k, "x", n) for k in ("mean", "sum", "max", "min") for n in (5, 14, 17, 50, 252)]
    out = with_rolling(df, specs, series()).where("ticker = 'A'").orderBy("date").toPandas()
    for s in specs:
        want = getattr(x.rolling(s.n), s.kind)()
        np.testing.assert_allclose(out[s.out].astype(float), want, rtol=1e-10, atol=1e-12)


def test_ewm_matches_pandas_far_beyond_one_block(spark):
    df, x = long_series(spark)
    out = with_ewm(in_blocks(df), [("f", "x", 12), ("s", "x", 26), ("l", "x", 200)])
    a = out.where("ticker = 'A'").orderBy("date").toPandas()
    for c, span in (("f", 12), ("s", 26), ("l", 200)):
        np.testing.assert_allclose(a[c], x.ewm(span=span, adjust=False).mean(), rtol=0, atol=1e-12)
    b = out.where("ticker = 'B'").orderBy("date").toPandas()
    np.testing.assert_allclose(b.s, (x[:40] * 2).ewm(span=26, adjust=False).mean(), atol=1e-12)


def test_decay_is_a_linear_recurrence(spark):
    df, x = long_series(spark, 600)
    out = with_decay(in_blocks(df, 64), [Decay("d", "x", 0.9)], block=64).where("ticker = 'A'").orderBy("date").toPandas()
    want, y = [], 0.0
    for v in x:
        y = 0.9 * y + v
        want.append(y)
    np.testing.assert_allclose(out.d, want, atol=1e-11)


def test_long_frames_take_two_levels_and_share_their_counts(spark):
    """Every level is a window over all rows, and every count a frame of its own."""
    assert tile_factors(252) == [18, 14] and tile_factors(14) == [14] and tile_factors(200) == [20, 10]
    df, _ = long_series(spark, 300)
    two = [Rolling("s", "sum", "x", 14), Rolling("m", "max", "x", 14), Rolling("l", "min", "x", 252)]
    plan = with_rolling(df, two, series())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("count(x") == 2
