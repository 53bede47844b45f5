"""Walk-forward folds with purge and embargo, and roles of panel rows in them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.config import DEFAULTS, ForecastConfig
from panelcast.functions.dates import busday_add


@dataclass(frozen=True)
class Fold:
    """One test block: rows in [test_lo, block_end] are scored.

    Training rows are those up to train_hi or, with purge="rows", those whose longest label
    is known before test_lo.
    """

    fold: int
    block_start: date
    test_lo: date
    block_end: date
    train_hi: date
    n_train: int
    n_test: int
    purge: str = "busdays"


def fold_blocks(panel: DataFrame, cfg: ForecastConfig = DEFAULTS) -> DataFrame:
    """(fold, block_start, test_lo, block_end) from the distinct panel dates.

    After the warm-up dates the rest are cut into equal contiguous blocks, earlier blocks
    taking the remainder. The windows run over distinct dates: one row per calendar day.
    """
    return _blocks(panel.groupBy("end_date").agg(F.count(F.lit(1)).alias("rows")), cfg)


def _blocks(days: DataFrame, cfg: ForecastConfig) -> DataFrame:
    calendar = Window.partitionBy(F.lit(0)).orderBy("end_date")
    pool = days.withColumn("__rn", F.row_number().over(calendar)).where(F.col("__rn") > cfg.min_train_dates)
    block = pool.withColumn("fold", F.ntile(cfg.n_folds).over(calendar))
    return (
        block.groupBy("fold")
        .agg(F.min("end_date").alias("block_start"), F.max("end_date").alias("block_end"))
        .select("fold", "block_start", busday_add("block_start", cfg.embargo_days).alias("test_lo"), "block_end")
    )


def walk_forward_folds(panel: DataFrame, cfg: ForecastConfig = DEFAULTS) -> list[Fold]:
    """The usable folds of a panel, oldest first.

    The panel is reduced once to one row per date; the result is a handful of fold bounds,
    which later steps use as plain constants so that their date filters reach the scan. A
    fold without training or test rows is left out.
    """
    days = panel.groupBy("end_date").agg(
        F.count(F.lit(1)).alias("rows"), F.max(busday_add("end_date", cfg.embargo_days)).alias("known")
    )
    # One row per calendar day, so the calendar fits the driver whatever the panel size.
    calendar = sorted(tuple(r) for r in days.collect())
    if len(calendar) <= cfg.min_train_dates + cfg.n_folds:
        raise ValueError(f"not enough distinct dates ({len(calendar)}) for {cfg.n_folds} folds")
    bounds = _blocks(panel.sparkSession.createDataFrame(calendar, days.schema), cfg).orderBy("fold").collect()
    if cfg.purge == "rows":
        early = [(F.col("label_end") < F.lit(b.test_lo)) for b in bounds]
        trained = panel.agg(
            *[F.count_if(e).alias(f"n{i}") for i, e in enumerate(early)],
            *[F.max(F.when(e, F.col("end_date"))).alias(f"d{i}") for i, e in enumerate(early)],
        ).first()
        train = [(trained[f"d{i}"], trained[f"n{i}"]) for i in range(len(bounds))]
    else:
        train = []
        for b in bounds:
            past = [(d, n) for d, n, known in calendar if known < b.test_lo]
            train.append((past[-1][0], sum(n for _, n in past)) if past else (None, 0))
    folds = []
    for b, (train_hi, n_train) in zip(bounds, train):
        n_test = sum(n for d, n, _ in calendar if b.test_lo <= d <= b.block_end)
        if n_train and n_test:
            folds.append(Fold(b.fold, b.block_start, b.test_lo, b.block_end, train_hi, n_train, n_test, cfg.purge))
    return folds


def require_folds(folds: list[Fold]) -> list[Fold]:
    if not folds:
        raise ValueError("every fold is empty: the test blocks do not outlast the embargo")
    return folds


def in_train(fold: Fold) -> Column:
    if fold.purge == "rows":
        return F.col("label_end") < F.lit(fold.test_lo)
    return F.col("end_date") <= F.lit(fold.train_hi)


def in_test(fold: Fold) -> Column:
    return F.col("end_date").between(F.lit(fold.test_lo), F.lit(fold.block_end))


def scored_fold(folds: list[Fold]) -> Column:
    """The fold a row is tested in, null for training-only and embargoed rows."""
    out = F.lit(None).cast("int")
    for f in folds:
        out = F.when(in_test(f), F.lit(f.fold)).otherwise(out)
    return out


def fold_roles(panel: DataFrame, folds: list[Fold]) -> DataFrame:
    """One row per (panel row, fold it takes part in), with role 'train' or 'test'.

    A range join against a handful of fold bounds, done as a generator over constants.
    """
    member = F.array(
        *[F.struct(F.lit(f.fold).alias("fold"), F.when(in_train(f), "train").when(in_test(f), "test").alias("role")) for f in folds]
    )
    return (
        panel.select("*", F.explode(member).alias("__m"))
        .select(*panel.columns, F.col("__m.fold").alias("fold"), F.col("__m.role").alias("role"))
        .where(F.col("role").isNotNull())
    )


def scored_anchors(anchors: DataFrame, folds: list[Fold]) -> DataFrame:
    """Anchors dated inside a fold's test span, with the fold and its split.

    The first fold that has anchors is kept for fitting weights and calibration ('val'); later
    ones are reported ('test'). If only one fold has anchors, everything is 'test'.

    Anchors are panel rows, so "their date occurs among the fold's test dates" is the same
    as lying inside the span; no semi join is needed.
    """
    scored = anchors.withColumn("fold", scored_fold(require_folds(folds))).where(F.col("fold").isNotNull())
    span = scored.select(F.struct(F.min("fold").alias("first"), F.max("fold").alias("last"))).scalar()
    split = F.when((F.col("fold") == span["first"]) & (span["first"] < span["last"]), "val").otherwise("test")
    return scored.withColumn("split", split)


def anchors_on_dates(anchors: DataFrame, dates: DataFrame) -> DataFrame:
    """Anchors whose end_date occurs in a table of dates (for date sets that are not spans)."""
    return anchors.join(dates.select("end_date"), "end_date", "left_semi")
