"""How tables are dealt over tasks, and what queries write on the way."""

import os

import pytest
from pyspark.sql import functions as F

from panelcast.functions.windows import series
from panelcast.plans import dealing
from panelcast.plans.dealing import dealt
from panelcast.plans.materialize import run_folder
from verification import datasets as ds
from verification.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Three suppliers with a line a day for seven years."""
    folder = str(tmp_path_factory.mktemp("tables"))
    lines = spark.range(3 * 2500).select(
        (F.col("id") % 3 + 1).alias("l_suppkey"), F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"),
        F.date_add(F.lit("1994-01-03").cast("date"), (F.col("id") / 3).cast("int")).alias("l_shipdate"),
        (1000 + F.pmod(F.xxhash64("id"), F.lit(500))).cast("double").alias("l_extendedprice"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"))
    lines.write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(i, f"Supplier#{i}", 0) for i in (1, 2, 3)], "s_suppkey long, s_name string, s_nationkey long").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(0, "ALGERIA")], "n_nationkey long, n_name string").write.parquet(f"{folder}/nation.parquet")
    return folder


def forget(folder: str) -> None:
    for key in [k for k in ds._made if k[1] == folder]:
        del ds._made[key]


def exchanges(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_tasks_grow_with_rows_and_windows_keep_the_deal(spark, monkeypatch):
    rows = spark.range(9000).select((F.col("id") % 300).cast("string").alias("ticker"), F.col("id").alias("date"))
    assert dealt(rows) is rows
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 300)
    spread = dealt(rows)
    assert spread.rdd.getNumPartitions() == 30 and spread.count() == 9000
    assert dealt(rows, rows=10**5).rdd.getNumPartitions() == 334
    windowed = spread.withColumn("n", F.count(F.lit(1)).over(series()))
    assert len(exchanges(windowed)) == 1 and "REPARTITION_BY_NUM" in exchanges(windowed)[0]


def test_null_tickers_and_no_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 1)
    rows = spark.createDataFrame([(None, 1), (None, 2), ("A", 1)], "ticker string, date int")
    assert dealt(rows).count() == 3
    assert dealt(rows.where("date > 5")).count() == 0


@pytest.mark.parametrize("name", ["windows_tensor", "labels_forward", "feat_momentum", "m_series_trend", "view_lookup"])
def test_features_are_computed_and_not_written(spark, tables, name):
    """A query that reads the features once leaves no feature table behind."""
    before = set(os.listdir(run_folder(spark))) if os.path.isdir(run_folder(spark)) else set()
    forget(tables)
    QUERIES[name](spark, tables).count()
    for made in set(os.listdir(run_folder(spark))) - before:
        columns = spark.read.parquet(f"{run_folder(spark)}/{made}").columns
        assert "SMA_200" not in columns, made


def test_momentum_of_month_ends_is_the_panels(spark, tables):
    wanted = ds.panel(spark, tables).where("month_end").select("ticker", "end_date", "ROC_21", *ds.CFG.label_cols)
    kept = ds.labels(spark, tables).where("month_end").select(*wanted.columns)
    assert kept.count() > 0 and kept.exceptAll(wanted).isEmpty() and wanted.exceptAll(kept).isEmpty()


def test_garch_writes_no_decayed_sums_and_does_not_depend_on_the_deal(spark, monkeypatch):
    from panelcast.operators.garch import garch_fit

    rows = spark.range(4 * 300).select(
        (F.col("id") % 4).cast("string").alias("ticker"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 4).cast("int")).alias("date"),
        (F.pmod(F.xxhash64("id"), F.lit(2001)) / 50000 - 0.02).alias("r"))
    whole = garch_fit(rows, 21, rounds=2).orderBy("ticker").collect()
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 100)
    before = set(os.listdir(run_folder(spark)))
    apart = garch_fit(rows, 21, rounds=2).orderBy("ticker").collect()
    for a, b in zip(whole, apart, strict=True):
        assert a["ticker"] == b["ticker"] and a["alpha"] is not None
        assert [a[c] for c in ("omega", "alpha", "beta", "loss", "volatility")] == pytest.approx([b[c] for c in ("omega", "alpha", "beta", "loss", "volatility")])
    for made in set(os.listdir(run_folder(spark))) - before:
        assert "__d7" not in spark.read.parquet(f"{run_folder(spark)}/{made}").columns, made


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_are_walked_before_they_are_stretched(spark, tables):
    from panelcast.sources.bars import walk_bars

    plan = plan_of(walk_bars(ds.ticks(spark, tables)))
    above = plan[: plan.index("Generate explode")]
    assert "Sort [" not in above and "Window [" not in above


def test_a_walk_stands_at_100_before_its_first_tick_and_then_keeps_its_last_close(spark):
    from datetime import date

    from panelcast.sources.bars import walk_bars

    ticks = spark.createDataFrame(
        [("A", date(2024, 1, 1), 1.0, 1.0), ("A", date(2024, 1, 10), 3.0, 2.0), ("B", date(2024, 1, 4), 1.0, 7.0), ("B", date(2024, 1, 6), 2.0, 1.0)],
        "ticker string, date date, price double, quantity double")
    got = {(r.ticker, r.date.day): (r.Open, r.Close, r.Volume) for r in walk_bars(ticks).collect()}
    assert len(got) == 16 and got["B", 1] == got["B", 3] == (100.0, 100.0, 0.0)
    assert got["A", 1] == (99.005, 99.005, 1.0) and got["A", 9] == (99.005, 99.005, 0.0) and got["A", 10] == (99.005, 100.0, 2.0)
    assert got["B", 4] == (100.0, 99.3356, 7.0) and got["B", 5] == (99.3356, 100.0, 1.0) and got["B", 10] == (100.0, 100.0, 0.0)


@pytest.mark.parametrize("name", ["labels_forward", "view_lookup"])
def test_who_asks_which_rows_are_complete_computes_no_long_frame(spark, tables, name):
    rows = ds.complete_modelling(spark, tables).select("ticker", "date", "y_1m", "n_rows")
    plan = plan_of(rows)
    assert "max(High" not in plan and "stddev_samp" not in plan and plan.count("Sort [") == 1
    QUERIES[name](spark, tables).count()


def test_complete_rows_alone_make_the_same_modelling_table(spark, tables):
    both = [m(spark, tables).where("complete") for m in (ds.modelling, ds.complete_modelling)]
    columns = ["ticker", "date", *ds.CFG.label_cols, "label_end", "row", "n_rows", "month_end", "Close"]
    a, b = (d.select(*columns) for d in both)
    assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


def test_history_that_no_anchor_date_sees_is_left_out(spark):
    from panelcast.plans.asof import asof_rows, reachable_rows

    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    history = spark.range(40).select(F.lit("A").alias("ticker"), day(F.col("id").cast("int")).alias("date"), "id").where("id % 10 != 9")
    anchors = spark.createDataFrame([("A", 9), ("B", 25), ("A", 12)], "ticker string, n int").select("ticker", day(F.col("n")).alias("end_date"))
    assert sorted(r.id for r in reachable_rows(history, anchors, "ticker", "end_date", "date").collect()) == [8, 12, 25]
    got = {(r.ticker, r.end_date.day): r.id for r in asof_rows(anchors, history, ["id"]).collect()}
    assert got == {("A", 10): 8, ("A", 13): 12, ("B", 26): None}


def test_a_written_walk_stays_dealt_for_all_its_readers(spark, tables, monkeypatch):
    from panelcast.operators.series_vol import trailing_volatility
    from panelcast.operators.views import price_history
    from panelcast.sources.bars import walk_bars

    forget(tables)
    small = {name: QUERIES[name](spark, tables).collect() for name in ("labels_forward", "view_lookup", "m_series_vol_asof")}
    forget(tables)
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 700)
    bars = ds.bars(spark, tables)
    assert bars.dealt_over == ("ticker", 8) and dealt(bars) is bars
    assert "Generate explode" in plan_of(bars)  # the dense rows are not written
    plain = walk_bars(ds.ticks(spark, tables))
    assert bars.count() == plain.count() > 5000 and bars.exceptAll(plain).isEmpty()
    for read in (ds.complete_modelling(spark, tables).select("ticker", "date", "y_1m"), trailing_volatility(bars), price_history(bars)):
        assert exchanges(read) == []
    for name, rows in small.items():
        assert sorted(map(str, QUERIES[name](spark, tables).collect())) == sorted(map(str, rows)) and rows
    forget(tables)


def test_null_tickers_survive_the_written_walk(spark, monkeypatch):
    from panelcast.plans.dealing import write_dealt

    monkeypatch.setattr(dealing, "ROWS_A_TASK", 1)
    rows = dealt(spark.createDataFrame([(None, 1), (None, 2), ("A", 1)], "ticker string, date int"))
    kept = write_dealt(rows, "kept")
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.collect())) and kept.dealt_over == rows.dealt_over


def test_forecasts_and_labels_share_one_pass(spark, tables):
    forget(tables)
    alone = ds.latest(spark, tables).collect()
    forget(tables)
    wanted = ds.panel(spark, tables).select("ticker", "end_date", *ds.CFG.label_cols, "label_end", "month_end")
    labels = ds.labels(spark, tables).select(*wanted.columns)
    shared = ds.latest(spark, tables)
    assert alone and sorted(map(str, shared.collect())) == sorted(map(str, alone))
    assert "Window [" not in plan_of(shared)  # read from the label table
    assert labels.count() == wanted.count() > 0 and labels.exceptAll(wanted).isEmpty()
    forget(tables)
