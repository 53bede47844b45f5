import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.config import ForecastConfig
from panelcast.functions.dates import busday_add
from panelcast.operators.cv import anchors_on_dates, fold_roles, require_folds, scored_anchors, walk_forward_folds


@pytest.fixture(scope="module")
def dates(spark):
    """Seven tickers that list one after another, so early dates have fewer rows than late ones."""
    days = pd.bdate_range("2011-08-01", periods=1310).date
    rows = [(f"T{k}", d, days[min(i + 126, 1309)]) for k in range(7) for i, d in enumerate(days) if i >= 90 * k]
    return spark.createDataFrame(rows, "ticker string, end_date date, label_end date").cache()


def test_busday_add_matches_pandas(spark):
    days = pd.date_range("2020-01-01", periods=400)
    df = spark.createDataFrame([(d.date(),) for d in days], "d date")
    for n in (0, 1, 4, 5, 21, 126):
        got = [r[0] for r in df.orderBy("d").select(busday_add("d", n)).collect()]
        assert got == [(d + pd.tseries.offsets.BDay(n)).date() for d in days], n


@pytest.mark.parametrize("n_folds", [2, 4, 5])
@pytest.mark.parametrize("purge", ["busdays", "rows"])
def test_no_label_of_a_training_row_reaches_the_tests(dates, purge, n_folds):
    folds = walk_forward_folds(dates, ForecastConfig(purge=purge, n_folds=n_folds))
    rows = dates.toPandas()
    roles = {(r.fold, r.ticker, r.end_date): r.role for r in fold_roles(dates, folds).collect()}
    tested = [key[1:] for key, role in roles.items() if role == "test"]
    assert folds and len(tested) == len(set(tested))  # no row is tested twice
    for f in folds:
        for r in rows.itertuples():
            role = roles.get((f.fold, r.ticker, r.end_date))
            if role == "train":
                assert np.busday_offset(r.end_date, 126, roll="backward") < np.datetime64(f.test_lo) and r.label_end < f.test_lo
            elif role == "test":
                assert f.test_lo <= r.end_date <= f.block_end
        counted = [sum(role == want for (fold, _, _), role in roles.items() if fold == f.fold) for want in ("train", "test")]
        assert counted == [f.n_train, f.n_test]
    assert all(a.n_train < b.n_train for a, b in zip(folds, folds[1:]))


def test_first_fold_with_anchors_validates(dates):
    folds = walk_forward_folds(dates, ForecastConfig())
    late = dates.where(F.col("end_date") > F.lit(folds[0].block_end))
    splits = {(r.fold, r.split) for r in scored_anchors(late, folds).collect()}
    assert splits == {(folds[1].fold, "val")} | {(f.fold, "test") for f in folds[2:]}
    one = dates.where(F.col("end_date").between(folds[2].test_lo, folds[2].block_end))
    assert {r.split for r in scored_anchors(one, folds).collect()} == {"test"}


def test_block_sizes_follow_array_split(spark):
    days = pd.bdate_range("2015-01-01", periods=252 + 1003).date
    panel = spark.createDataFrame([(d,) for d in days], "end_date date")
    from panelcast.operators.cv import fold_blocks

    got = fold_blocks(panel).orderBy("fold").collect()
    want = np.array_split(np.array(days[252:]), 4)
    assert [(r.block_start, r.block_end) for r in got] == [(b[0], b[-1]) for b in want]


def test_too_few_dates_and_empty_folds(spark):
    few = spark.createDataFrame([(d,) for d in pd.bdate_range("2020-01-01", periods=250).date], "end_date date")
    with pytest.raises(ValueError, match="not enough distinct dates"):
        walk_forward_folds(few)
    tight = spark.createDataFrame([(d,) for d in pd.bdate_range("2020-01-01", periods=300).date], "end_date date")
    with pytest.raises(ValueError, match="embargo"):
        require_folds(walk_forward_folds(tight))


def test_scored_anchors_and_split(dates):
    folds = walk_forward_folds(dates)
    anchors = dates.where("day(end_date) > 24")
    got = scored_anchors(anchors, folds)
    assert {(r.fold, r.split) for r in got.select("fold", "split").distinct().collect()} == {
        (1, "val"), (2, "test"), (3, "test"), (4, "test")}
    assert {r.split for r in scored_anchors(anchors, folds[:1]).select("split").distinct().collect()} == {"test"}
    f = folds[0]
    span = dates.where(F.col("end_date").between(F.lit(f.test_lo), F.lit(f.block_end))).select("end_date").distinct()
    assert anchors_on_dates(anchors, span).count() == got.where("fold = 1").count()
