import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.config import ForecastConfig
from panelcast.operators.baselines import HistoricalQuantile, RandomWalk, long_labels
from panelcast.operators.ensemble import align_predictions, apply_conformal, apply_ensemble, blend, fit_blend_weights, fit_conformal, fit_ensemble
from panelcast.operators.metrics import covered, drift_reference, pinball_loss, same_direction, score_table
from panelcast.operators.series_vol import (
    GARCH_GRID, SeriesVol, garch_volatility, paths_to_returns, quantile_paths, realised_volatility, trailing_volatility,
)
from panelcast.operators.boosting import BoostedForecaster, boosted_quantiles
from panelcast.operators.cv import walk_forward_folds
from panelcast.operators.trees import LeafQuantileForest, bootstrap_weights
from panelcast.plans.histograms import best_split, histogram_quantile
from panelcast.schemas import FEATURES

Q = "array<double>"


def test_asof_rows_take_the_last_row_up_to_the_date(spark):
    from datetime import date

    from panelcast.plans.asof import asof_rows

    day = lambda n: date(2024, 1, n)
    history = spark.createDataFrame([("A", day(2), 1.0), ("A", day(5), None), ("A", day(9), 3.0), ("B", day(4), 4.0), (None, day(4), 9.0), ("A", None, 9.0)], "ticker string, date date, v double")
    anchors = spark.createDataFrame([("A", day(d)) for d in (1, 2, 4, 5, 8, 9, 30, 30)] + [("B", day(3)), ("B", day(4)), ("C", day(4)), (None, day(4))], "ticker string, end_date date")
    got = {(r.ticker, r.end_date.day): (r.v, r.seen and r.seen.day) for r in asof_rows(anchors, history, ["v"]).collect()}
    assert got == {("A", 1): (None, None), ("A", 2): (1.0, 2), ("A", 4): (1.0, 2), ("A", 5): (None, 5), ("A", 8): (None, 5), ("A", 9): (3.0, 9), ("A", 30): (3.0, 9),
                   ("B", 3): (None, None), ("B", 4): (4.0, 4), ("C", 4): (None, None), (None, 4): (None, None)}
    assert asof_rows(anchors.limit(0), history, ["v"]).count() == 0 and asof_rows(anchors, history.limit(0), ["v"]).count() == 11


def test_baselines_match_numpy(spark):
    rng = np.random.default_rng(0)
    y = {h: rng.normal(0.01 * i, 0.05, 500) for i, h in enumerate(("1m", "3m", "6m"))}
    wide = spark.createDataFrame([tuple(map(float, v)) for v in zip(*y.values())], "y_1m double, y_3m double, y_6m double")
    train = long_labels(wide.withColumn("fold", F.lit(1)), keep=["fold"])
    rows = spark.createDataFrame([(1, h) for h in y], "fold int, horizon string")
    rw = {r.horizon: r.random_walk for r in RandomWalk().fit(train).predict(rows).collect()}
    hq = {r.horizon: r.baseline for r in HistoricalQuantile().fit(train).predict(rows).collect()}
    for h, v in y.items():
        sd = v.std(ddof=1)
        np.testing.assert_allclose(rw[h], [sd * NormalDist().inv_cdf(q) for q in (0.1, 0.5, 0.9)], atol=1e-12)
        assert rw[h][1] == 0.0 and rw[h] == sorted(rw[h])
        np.testing.assert_allclose(hq[h], np.quantile(v, [0.1, 0.5, 0.9]), atol=1e-12)


def test_series_volatility_is_causal_and_matches_pandas(spark, to_bars, ohlcv):
    bars = to_bars(ohlcv)
    got = trailing_volatility(bars).orderBy("date").toPandas()
    want = np.log(ohlcv.Close).diff().rolling(252).std()
    np.testing.assert_allclose(got.sigma.astype(float), want, rtol=1e-9)
    anchor = spark.createDataFrame([("T0", ohlcv.date[380], "3m")], "ticker string, end_date date, horizon string")
    q = SeriesVol().fit(bars).predict(anchor).first().series_vol
    np.testing.assert_allclose(q, np.exp(np.array([-1, 0, 1]) * NormalDist().inv_cdf(0.9) * want[380] * math.sqrt(63)) - 1, rtol=1e-9)


def test_paths_to_returns(spark):
    rows = [("A", None, step, 0.5, [0.5 + 0.001 * step + 0.01, 0.5 + 0.001 * step, 0.5 + 0.001 * step - 0.01]) for step in range(1, 127)]
    paths = spark.createDataFrame(rows, f"ticker string, end_date date, step int, log_price double, path {Q}")
    out = {r.horizon: r.q for r in paths_to_returns(paths).collect()}
    assert out["1m"][1] == pytest.approx(math.exp(0.021) - 1)
    assert all(v == sorted(v) for v in out.values()) and set(out) == {"1m", "3m", "6m"}
    anchors = spark.createDataFrame([("A", None, 0.5, 0.02)], "ticker string, end_date date, log_price double, sigma double")
    assert quantile_paths(anchors, 126).count() == 126


def test_garch_matches_a_plain_recursion(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(0, 0.02, 800)
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(r)] + [("A", 900, None)], "ticker string, date int, r double")
    best = (math.inf,)
    v = float(np.mean(r**2))
    for alpha, beta in GARCH_GRID:
        s, loss = v, 0.0
        for x in r**2:
            loss += math.log(s) + x / s
            s = v * (1 - alpha - beta) + alpha * x + beta * s
        k = alpha + beta
        path = v * 21 + (s - v) * (1 - k**21) / (1 - k)
        best = min(best, (loss, alpha, beta, math.sqrt(path)))
    got = garch_volatility(df, 21).first()
    assert (got.alpha, got.beta) == best[1:3]
    assert got.volatility == pytest.approx(best[3], rel=1e-10) and got.volatility > 0
    assert realised_volatility(df, 21).first().volatility == pytest.approx(r.std(ddof=1) * math.sqrt(21))


def test_garch_falls_back_on_a_dead_series(spark):
    df = spark.createDataFrame([("A", i, 0.0) for i in range(50)], "ticker string, date int, r double")
    assert garch_volatility(df, 21).first().volatility == 0.0


def cube(spark, y, **models):
    cols = list(models)
    rows = [(h, float(y[h][i]), *[[float(x) for x in models[m][h][i]] for m in cols]) for h in y for i in range(len(y[h]))]
    return spark.createDataFrame(rows, "horizon string, y double, " + ", ".join(f"{m} {Q}" for m in cols))


def test_blend_weight_is_per_horizon_and_prefers_the_better_model(spark):
    rng = np.random.default_rng(1)
    y = {h: rng.normal(0, 0.05, 300) for h in ("1m", "3m", "6m")}
    good = {h: np.repeat(v[:, None], 3, 1) + rng.normal(0, 0.001, (300, 3)) for h, v in y.items()}
    noise = {h: rng.normal(0, 0.5, (300, 3)) for h in y}
    a = {"1m": good["1m"], "3m": noise["3m"], "6m": good["6m"]}
    b = {"1m": noise["1m"], "3m": good["3m"], "6m": noise["6m"]}
    w = {r.horizon: r.w for r in fit_blend_weights(cube(spark, y, a=a, b=b), "a", "b").collect()}
    assert w["1m"] > 0.8 and w["6m"] > 0.8 and w["3m"] < 0.2


def test_lowest_weight_wins_ties_and_default_is_one(spark):
    same = {"1m": np.zeros((5, 3))}
    assert fit_blend_weights(cube(spark, {"1m": np.ones(5)}, a=same, b=same), "a", "b").first().w == 0.0
    nothing = spark.createDataFrame([("1m", None, None, None)], f"horizon string, y double, a {Q}, b {Q}")
    assert fit_blend_weights(nothing, "a", "b").first().w == 1.0


def test_blend_is_convex_and_sorted(spark):
    df = spark.createDataFrame([([0.0, 0.1, 0.3], [0.2, 0.1, 0.0])], f"a {Q}, b {Q}")
    np.testing.assert_allclose(df.select(blend("a", "b", F.lit(0.5))).first()[0], [0.1, 0.1, 0.15])
    shrunk = df.select(apply_conformal("a", F.lit(-0.25))).first()[0]
    np.testing.assert_allclose(shrunk, [0.05, 0.1, 0.25])


def test_conformal_matches_numpy_and_restores_coverage(spark):
    rng = np.random.default_rng(2)
    n = 4000
    band = {"1m": np.tile([-0.5, 0.0, 0.5], (n, 1))}
    cal, fresh = rng.normal(0, 1, n), rng.normal(0, 1, n)
    delta = fit_conformal(cube(spark, {"1m": cal}, q=band), "q").first().delta
    scores = np.maximum(-0.5 - cal, cal - 0.5)
    assert delta == pytest.approx(np.quantile(scores, min(1.0, np.ceil((n + 1) * 0.8) / n)), abs=1e-12) and delta > 0
    wide = cube(spark, {"1m": fresh}, q=band).withColumn("q", apply_conformal("q", F.lit(delta)))
    share = wide.select(F.avg(covered(F.col("y"), F.col("q")[0], F.col("q")[2]).cast("int"))).first()[0]
    assert 0.76 <= share <= 0.84


def test_conformal_level_is_capped_for_tiny_samples(spark):
    few = cube(spark, {"1m": np.array([0.1, 5.0, -0.2])}, q={"1m": np.tile([-1.0, 0.0, 1.0], (3, 1))})
    assert fit_conformal(few, "q").first().delta == pytest.approx(4.0)


def test_single_fold_skips_calibration(spark):
    rng = np.random.default_rng(3)
    y = {"1m": rng.normal(0, 1, 50)}
    q = {"1m": np.tile([-1.0, 0.0, 1.0], (50, 1))}
    preds = cube(spark, y, a=q, b=q).withColumn("split", F.lit("test"))
    params = fit_ensemble(preds, "a", "b")
    assert params.first().delta is None
    assert apply_ensemble(preds, params, "a", "b").first().ensemble == [-1.0, 0.0, 1.0]


def test_alignment_is_by_key(spark):
    schema = f"ticker string, end_date date, horizon string, q {Q}"
    a = spark.createDataFrame([("X", None, "1m", [1.0]), ("Y", None, "1m", [2.0])], schema).withColumn("end_date", F.lit("2020-01-31").cast("date"))
    b = a.orderBy(F.desc("ticker"))
    assert all(r.one == r.two for r in align_predictions(a, b, "one", "two").collect())


def test_metric_closed_forms(spark):
    df = spark.createDataFrame([(1.0, [1.0, 1.0, 1.0]), (1.0, [0.0, 0.0, 0.0])], f"y double, q {Q}")
    got = [r[0] for r in df.select(pinball_loss(F.col("y"), F.col("q"))).collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx((0.1 + 0.5 + 0.9) / 3)
    signs = spark.createDataFrame([(1.0, 0.5), (-1.0, -0.2), (2.0, -0.1), (-3.0, -1.0), (0.0, 0.0)], "y double, p double")
    assert [r[0] for r in signs.select(same_direction(F.col("y"), F.col("p"))).collect()] == [True, True, False, True, True]


def test_score_table_and_ic(spark):
    y = {"1m": np.array([1.0, 2.0, 3.0, 4.0, 4.0])}
    up = {"1m": np.array([[x - 1, x, x + 1] for x in (10, 20, 30, 40, 50)])}
    flat = {"1m": np.tile([-1.0, 0.0, 9.0], (5, 1))}
    got = {r.model: r for r in score_table(cube(spark, y, up=up, flat=flat), ["up", "flat"]).collect()}
    assert got["up"].ic == pytest.approx(np.corrcoef([1, 2, 3, 4.5, 4.5], [1, 2, 3, 4, 5])[0, 1])
    assert got["flat"].ic is None and got["flat"].coverage == 1.0 and got["flat"].hit_rate == 1.0
    spread = score_table(cube(spark, y, up=up, flat=flat), ["up", "flat"], ForecastConfig(max_group_rows=2))
    assert {r.model: r.ic for r in spread.collect()}["up"] == pytest.approx(got["up"].ic)


def test_drift_reference(planted_panel):
    got = {r.feature: r for r in drift_reference(planted_panel).collect()}
    col = planted_panel.select("RSI_14").toPandas().RSI_14
    assert list(got) == FEATURES
    assert got["RSI_14"].mean == pytest.approx(col.mean()) and got["RSI_14"].std == pytest.approx(col.std())


def test_forest_learns_the_planted_signal_and_reloads(spark, planted_panel, tmp_path):
    forest = LeafQuantileForest(trees=10, depth=4)
    for h in ("1m", "3m", "6m"):
        forest.fit_one(planted_panel, h)
    got = forest.predict_one(planted_panel, "1m").select("gbm", "Open", "y_1m").toPandas()
    q = np.array(got.gbm.tolist())
    assert (np.diff(q, axis=1) >= 0).all()
    assert np.corrcoef(q[:, 1], got.Open)[0, 1] > 0.8
    base = np.quantile(got.y_1m, [0.1, 0.5, 0.9])
    loss = lambda p: np.mean([np.maximum(a * (got.y_1m - p[:, i]), (a - 1) * (got.y_1m - p[:, i])).mean() for i, a in enumerate((0.1, 0.5, 0.9))])
    assert loss(q) < loss(np.tile(base, (len(q), 1)))
    forest.save(str(tmp_path / "forest"))
    again = LeafQuantileForest.load(spark, str(tmp_path / "forest"))
    a = forest.predict_one(planted_panel.limit(5), "3m").orderBy("ticker", "end_date").collect()
    b = again.predict_one(planted_panel.limit(5), "3m").orderBy("ticker", "end_date").collect()
    assert a == b


def test_boosting_beats_the_constant_quantile(planted_panel):
    got = boosted_quantiles(planted_panel, planted_panel, "y_1m", rounds=3, rate=0.5, depth=3).select("q", "y_1m").toPandas()
    q = np.array(got.q.tolist())
    assert (np.diff(q, axis=1) >= 0).all()

    def loss(p, a):
        return np.maximum(a * (got.y_1m - p), (a - 1) * (got.y_1m - p)).mean()

    assert loss(q[:, 1], 0.5) < 0.95 * loss(np.median(got.y_1m), 0.5)


def test_boosted_forecaster_runs_in_a_job_and_reloads(spark, planted_panel, tmp_path):
    from panelcast.plans.training import out_of_sample_signal

    cfg = ForecastConfig(horizons={"1m": 21}, n_folds=2, quantiles=(0.1, 0.3, 0.5, 0.7, 0.9))
    model = BoostedForecaster(cfg, rounds=2, depth=2)
    signal = out_of_sample_signal(planted_panel, cfg, "1m", model)
    assert signal.count() > 0 and len(model.fitted) == len(walk_forward_folds(planted_panel, cfg))
    model.save(str(tmp_path / "boosted"))
    again, rows = BoostedForecaster.load(spark, str(tmp_path / "boosted"), cfg), planted_panel.limit(6)
    last = max(f for f, _ in model.fitted)
    ours = model.predict_one(rows, "1m", last).orderBy("ticker", "end_date").collect()
    assert ours == again.predict_one(rows, "1m").orderBy("ticker", "end_date").collect()
    assert all(len(r.boosted) == 5 and sorted(r.boosted) == r.boosted for r in ours)


def test_best_split_is_the_best_of_all():
    rng = np.random.default_rng(11)
    for _ in range(30):
        x, v = rng.integers(0, 6, (200, 3)), rng.integers(0, 2, 200)
        n, s = (np.stack([np.bincount(x[:, j], w, 6) for j in range(3)]).astype(np.int64) for w in (None, v))
        spread = lambda part: ((part - part.mean()) ** 2).sum()
        every = {(j, c): spread(v) - spread(v[x[:, j] <= c]) - spread(v[x[:, j] > c])
                 for j in range(3) for c in range(5) if min((x[:, j] <= c).sum(), (x[:, j] > c).sum()) >= 20}
        got = best_split(n, s, 20)
        assert got is not None and every[got] == pytest.approx(max(every.values()))
    assert best_split(n, s, 150) is None and best_split(n, n, 5) is None  # too few rows; nothing to explain


def test_histogram_quantile():
    assert histogram_quantile(np.array([0, 1, 0]), 0.3) == pytest.approx(1.5)
    values = np.random.default_rng(5).integers(0, 1000, 4000)
    for level in (0.0, 0.1, 0.5, 0.9, 1.0):
        assert histogram_quantile(np.bincount(values, minlength=1000), level) == pytest.approx(np.quantile(values, level) + 0.5, abs=1.0)


def test_boosted_models_of_one_fit_are_those_of_separate_fits(planted_panel):
    """All folds at once, in other partitions, and with the future spoiled: an earlier fold does not change."""
    cfg = ForecastConfig(horizons={"1m": 21, "3m": 63}, n_folds=2)
    folds = walk_forward_folds(planted_panel, cfg)
    options = {"rounds": 3, "depth": 2, "write_every": 2}
    first = folds[0]
    rows = planted_panel.limit(20).withColumns({"fold": F.lit(first.fold), "horizon": F.lit("3m")})
    joint = BoostedForecaster(cfg, **options).fit_folds(planted_panel, folds)
    spoiled = planted_panel.withColumns({c: F.when(F.col("end_date") > F.lit(first.train_hi), 1e6).otherwise(F.col(c)) for c in ("y_3m", FEATURES[0])})
    later = BoostedForecaster(cfg, **options).fit_folds(spoiled.repartition(7), folds)
    assert joint.predict(rows).collect() == later.predict(rows).collect()
    model = joint.fitted[(first.fold, "1m")]
    assert len(model.trees) == 4 and len(model.keys) == 12 and all((t.feature >= 0).any() for t in model.trees[1:])


def test_more_rounds_fit_better_and_stay_in_range(planted_panel):
    losses, y = [], np.array([r.y_1m for r in planted_panel.select("y_1m").collect()])
    for rounds in (1, 4, 8):
        q = np.array([r.q for r in boosted_quantiles(planted_panel, planted_panel, "y_1m", rounds=rounds, depth=2).select("q").collect()])
        assert q.min() >= y.min() and q.max() <= y.max()
        got = boosted_quantiles(planted_panel, planted_panel, "y_1m", rounds=rounds, depth=2).select("q", "y_1m").toPandas()
        q, t = np.array(got.q.tolist()), got.y_1m.to_numpy()
        losses.append(sum(np.maximum(a * (t - q[:, i]), (a - 1) * (t - q[:, i])).mean() for i, a in enumerate((0.1, 0.5, 0.9))))
        assert abs((t <= q[:, 0]).mean() - 0.1) < 0.06 and abs((t <= q[:, 2]).mean() - 0.9) < 0.06
    assert losses[0] > losses[1] > losses[2]


def test_boosted_queries_run_the_defaults_and_count_every_overshoot(spark, planted_panel, monkeypatch):
    from panelcast.operators.baselines import training_labels
    from verification import queries

    folds, made = walk_forward_folds(planted_panel, queries.CFG), []

    class Stop(Exception):
        pass

    def fit_folds(self, panel, folds, horizons=None):
        made.append((self.options, horizons, folds))
        raise Stop

    monkeypatch.setattr(queries.ds, "panel", lambda spark, sf: planted_panel)
    monkeypatch.setattr(queries.ds, "folds", lambda spark, sf: folds)
    monkeypatch.setattr(queries.BoostedForecaster, "fit_folds", fit_folds)
    with pytest.raises(Stop):
        queries._boosted.__wrapped__(spark, "")
    assert made == [({}, None, folds)]

    ends = training_labels(planted_panel, folds, queries.CFG).groupBy("fold", "horizon").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    over = F.col("b") + (F.col("b") - F.col("a")) * 0.5
    rows = ends.select("fold", "horizon", F.explode(F.array(F.array("a", "a", "b"), F.array("a", "b", over))).alias("boosted"))
    monkeypatch.setattr(queries, "_boosted", lambda spark, sf: rows)
    assert {(r.n, r.nulls, r.crossings, r.outside) for r in queries.m_boosted_invariants(spark, "").collect()} == {(2, 0, 0, 1)}


def test_forest_query_runs_the_defaults_over_all_folds_and_horizons(spark, planted_panel, monkeypatch):
    from panelcast.plans.training import anchor_rows
    from verification import queries

    folds, made, fit_joint = walk_forward_folds(planted_panel, queries.CFG), [], LeafQuantileForest.fit_joint

    def seen(self, panel, member, numbers, horizons):
        made.append((self.trees, self.depth, self.min_leaf, numbers, horizons))
        return fit_joint(self, panel, member, numbers, horizons)

    monkeypatch.setattr(queries.ds, "panel", lambda spark, sf: planted_panel)
    monkeypatch.setattr(queries.ds, "folds", lambda spark, sf: folds)
    monkeypatch.setattr(LeafQuantileForest, "fit_joint", seen)
    got = queries.m_leaf_forest(spark, "").collect()
    assert made == [(20, 6, 50, [f.fold for f in folds], ["1m", "3m", "6m"])]
    anchors = {(r.fold, r.ticker, r.end_date, r.horizon): round(r.y, 6) for r in anchor_rows(planted_panel, folds, queries.CFG).collect()}
    assert len(got) == len(anchors) and {(r.fold, r.ticker, r.end_date, r.horizon): r.realized for r in got} == pytest.approx(anchors)
    assert all(r.q10 <= r.q50 <= r.q90 and r.pred == r.q50 for r in got)


def test_forest_of_all_folds_is_causal_and_does_not_depend_on_partitions(planted_panel, monkeypatch):
    from panelcast.operators import trees

    cfg = ForecastConfig(horizons={"1m": 21, "3m": 63}, n_folds=2)
    folds = walk_forward_folds(planted_panel, cfg)
    rows = planted_panel.limit(20).withColumns({"fold": F.lit(folds[0].fold), "horizon": F.lit("3m")})
    joint = LeafQuantileForest(cfg, trees=3, depth=3).fit_folds(planted_panel, folds)
    monkeypatch.setattr(trees, "MOST_CELLS", 5000)  # several scans
    spoiled = planted_panel.withColumns({c: F.when(F.col("end_date") > F.lit(folds[0].train_hi), 1e6).otherwise(F.col(c)) for c in ("y_3m", FEATURES[0])})
    later = LeafQuantileForest(cfg, trees=3, depth=3).fit_folds(spoiled.repartition(7), folds)
    assert joint.predict(rows).collect() == later.predict(rows).collect()


def test_leaf_quantiles_are_those_of_the_rows_in_the_leaf(planted_panel):
    forest = LeafQuantileForest(trees=1, depth=3).fit_one(planted_panel, "1m")
    model = forest.fitted[(0, "1m")]
    pdf = planted_panel.select(*FEATURES, "y_1m").toPandas()
    from panelcast.plans.histograms import binned

    at = model.trees.positions(0, binned(pdf[FEATURES].to_numpy(), model.edges), 3)
    assert len(set(at)) > 4
    for leaf in set(at):
        y = pdf.y_1m.to_numpy()[at == leaf]
        assert len(y) > 25
        below = [(y <= q).mean() for q in model.leaves[0, leaf]]
        assert below == pytest.approx([0.1, 0.5, 0.9], abs=0.03)


def test_bootstrap_weights_are_poisson_and_differ_by_tree():
    key = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 50_000)
    a, b = bootstrap_weights(key, 0, 0), bootstrap_weights(key, 1, 0)
    assert abs(a.mean() - 1) < 0.02 and abs(a.var() - 1) < 0.04 and abs(np.corrcoef(a, b)[0, 1]) < 0.02
    assert abs((a == 0).mean() - math.exp(-1)) < 0.01


def test_rows_without_a_fit_get_null(planted_panel):
    forest = LeafQuantileForest(ForecastConfig(horizons={"1m": 21}), trees=1, depth=1).fit_one(planted_panel, "1m", 2)
    rows = planted_panel.limit(1).crossJoin(planted_panel.sparkSession.createDataFrame([(2, "1m"), (0, "1m"), (1, "1m"), (2, "9m")], "fold int, horizon string"))
    got = {(r.fold, r.horizon): r.gbm for r in forest.predict(rows).collect()}
    assert got[(2, "1m")] == got[(0, "1m")] is not None and got[(1, "1m")] is got[(2, "9m")] is None


def test_a_horizon_without_bands_keeps_its_weight(spark):
    rows = [(h, "val", 0.1 * i, [0.0, 0.1, 0.2] if h == "1m" else None, [0.0, 0.1, 0.3]) for h in ("1m", "3m") for i in range(20)]
    preds = spark.createDataFrame(rows, f"horizon string, split string, y double, a {Q}, b {Q}")
    got = {r.horizon: r for r in fit_ensemble(preds, "a", "b").collect()}
    assert set(got) == {"1m", "3m"} and got["1m"].delta is not None and got["3m"].w is not None and got["3m"].delta is None


def test_volatility_rolls_only_rows_that_anchors_see(spark):
    """Sigma of every anchor is that of the whole history, from the frames before the anchors only."""
    from panelcast.plans.asof import asof_rows

    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), F.col(n).cast("int"))
    each = spark.range(4 * 400).select(F.col("id") % 4, (F.col("id") / 4).cast("int").alias("n")).toDF("k", "n")
    close = F.exp(F.pmod(F.xxhash64("k", "n"), F.lit(1000)) / 1000)
    bars = each.select(
        F.when(F.col("k") < 3, F.concat(F.lit("T"), F.col("k").cast("string"))).alias("ticker"),
        F.when(F.col("n") != 350, day("n")).alias("date"), F.when(F.col("n") % 37 != 5, close).alias("Close"))
    asked = [("T0", 330), ("T0", 360), ("T1", 390), ("T1", 1), ("T2", 350), ("T9", 300), (None, 300)]
    anchors = spark.createDataFrame(asked, "ticker string, n int").select("ticker", day("n").alias("end_date"), F.lit("1m").alias("horizon"))
    want = {(r.ticker, r.end_date): r.sigma for r in asof_rows(anchors, trailing_volatility(bars, 20), ["sigma"]).collect()}
    few = trailing_volatility(bars, 20, anchors)
    got = {(r.ticker, r.end_date): r.sigma for r in asof_rows(anchors, few, ["sigma"]).collect()}
    assert got.keys() == want.keys() and sum(v is not None for v in got.values()) == 4
    for k, v in want.items():
        assert got[k] == v or got[k] == pytest.approx(v, rel=1e-12)
    newest = anchors.where("ticker = 'T2'")
    assert trailing_volatility(bars, 20, newest).count() <= 21 < trailing_volatility(bars, 20).count()
    bands = {(r.ticker, r.end_date): r.series_vol for r in SeriesVol(rows=20).fit(bars).predict(anchors).collect()}
    assert len(bands) == len(asked) and all((bands[k][0] is None) == (v is None) for k, v in want.items() if k[0])
