"""Exact quantiles and ranks, on both the small and the large path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.plans.quantiles import exact_quantiles
from panelcast.plans.ranking import with_average_rank, with_position


def test_quantiles_match_numpy_on_small_groups(spark):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(0, 1, 501), "b": np.round(rng.normal(0, 1, 300), 1), "c": np.array([3.0]), "d": np.full(50, 2.0)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows + [("a", None)], "k string, v double")
    got = {(r.k, r.level): r.v for r in exact_quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    for k, vs in groups.items():
        for p in (0.0, 0.1, 0.5, 0.9, 1.0):
            assert abs(got[(k, p)] - np.quantile(vs, p)) < 1e-12, (k, p)


def test_quantiles_use_brackets_on_large_groups(spark):
    """Above 200,000 rows only the bracket is grouped; a third of the rows share one value."""
    df = spark.range(600_000, numPartitions=6).select(
        F.lit("g").alias("k"), F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise(F.rand(7)).alias("v")
    )
    values = np.sort(df.toPandas().v.to_numpy())
    got = {r.level: r.v for r in exact_quantiles(df, ["k"], "v", [0.1, 0.5, 0.9]).collect()}
    for p in (0.1, 0.5, 0.9):
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_quantiles_group_few_values_and_sketch_none(spark):
    """Rows are counted by bin; only the bins of the wanted ranks are grouped by value, over all signs and magnitudes."""
    df = spark.range(200_000, numPartitions=4).select(
        (F.col("id") % 2).alias("k"), ((F.rand(3) - 0.4) * F.pow(F.lit(10.0), F.col("id") % 9 - 4)).alias("v"))
    found = exact_quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.9, 1.0])
    assert "percentile_approx" not in found._jdf.queryExecution().optimizedPlan().toString()
    values = df.toPandas().groupby("k").v
    for r in found.collect():
        assert r.n == 100_000 and r.v == pytest.approx(np.quantile(values.get_group(r.k), r.level), rel=1e-12)


def test_bins_never_fall_as_values_rise(spark):
    from panelcast.plans.quantiles import _bin

    inf = float("inf")
    values = [-inf, -1.7e308, -2.0, -1.001, -1.0, -1e-3, -1e-300, -5e-324, -0.0, 0.0, 5e-324, 1e-300, 1e-3, 1.0, 1.001, 2.0, 1.7e308, inf, float("nan")]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", _bin(F.col("v")).alias("b")).orderBy("i").collect()
    bins = [r.b for r in rows]
    assert bins == sorted(bins) and bins[values.index(-0.0)] == 0 and bins[10] > 0 > bins[7] and bins[-1] > bins[-2]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value hold far more than a third of the rows."""
    df = spark.range(40_000, numPartitions=5).select(
        "id",
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("g"), (F.col("id") % 70).cast("string"))).otherwise("hot").alias("k"),
        F.when(F.col("id") % 2 == 0, F.lit(0.5)).otherwise(F.round(F.rand(3), 3)).alias("v"),
    )
    return df.cache()


@pytest.mark.parametrize("bound", [1_000_000, 100])
def test_positions_match_on_both_paths(skewed, bound):
    got = with_position(skewed, ["k"], [F.desc("v"), "id"], "pos", bound).toPandas()
    got = got.sort_values(["k", "v", "id"], ascending=[True, False, True])
    assert (got.pos == got.groupby("k").cumcount() + 1).all() and len(got) == 40_000


def test_positions_without_a_group(skewed):
    got = with_position(skewed, [], ["v", "id"], "pos", 100).toPandas().sort_values(["v", "id"])
    assert list(got.pos) == list(range(1, 40_001))


@pytest.mark.parametrize("bound", [1_000_000, 100])
def test_average_ranks_match_pandas_on_both_paths(skewed, bound):
    got = with_average_rank(skewed, ["k"], "v", "r", bound).toPandas()
    assert len(got) == 40_000
    np.testing.assert_allclose(got.r, got.groupby("k").v.rank(method="average"))


def test_clusters_need_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from panelcast.plans.materialize import shared_folder

    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None),
                               sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    assert shared_folder(session("local[3]")).startswith("/tmp/")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master))


def test_ensembles_keep_every_level(spark):
    from panelcast.operators.ensemble import apply_ensemble, blend

    levels = spark.createDataFrame([("1m", [1.0, 2.0, 3.0, 4.0, 5.0], [3.0, 4.0, 5.0, 6.0, 7.0])], "horizon string, a array<double>, b array<double>")
    params = spark.createDataFrame([("1m", 0.5, 0.25)], "horizon string, w double, delta double")
    assert levels.select(blend("a", "b", F.lit(0.5))).first()[0] == [2.0, 3.0, 4.0, 5.0, 6.0]
    assert apply_ensemble(levels, params, "a", "b").first().ensemble == [1.75, 3.0, 4.0, 5.0, 6.25]
