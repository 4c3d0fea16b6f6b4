import datetime as dt
import os
import threading
import time
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelscope.operators import baselines, encoding, features, forecast, forest, leaderboard, metrics, models, splits, stats
from reelscope.sources import tables


def days(n, start=dt.date(2024, 1, 1)):
    return [start + dt.timedelta(i) for i in range(n)]


def test_error_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    y, p = rng.normal(50, 30, 501), rng.normal(50, 40, 501)
    df = spark.createDataFrame(pd.DataFrame({"model": "m", "y": y, "yhat": p}))
    got = metrics.error_metrics(df, clip_prediction=True).first()
    err, clipped = np.abs(y - p), np.clip(p, 0, None)
    assert got.mae == pytest.approx(err.mean()) and got.medae == pytest.approx(np.median(err))
    assert got.rmse == pytest.approx(np.sqrt((err**2).mean())) and got.wape == pytest.approx(err.sum() / np.abs(y).sum() * 100)
    assert got.smape == pytest.approx(np.mean(2 * np.abs(y - clipped) / (np.abs(y) + np.abs(clipped) + 1)) * 100)
    assert got.r2 == pytest.approx(1 - (err**2).sum() / ((y - y.mean()) ** 2).sum())


def test_constant_targets(spark):
    rows = [("perfect", 2.0, 2.0), ("perfect", 2.0, 2.0), ("wrong", 2.0, 3.0), ("wrong", 2.0, 2.0), ("zero", 0.0, 0.0), ("zero", 0.0, 1.0), ("one", 5.0, 5.0)]
    got = {r.model: r for r in metrics.error_metrics(spark.createDataFrame(rows, "model string, y double, yhat double")).collect()}
    assert (got["perfect"].r2, got["wrong"].r2) == (1.0, 0.0)
    assert got["zero"].wape is None and got["one"].r2 is None


def test_log_predictions_are_bounded(spark):
    df = spark.createDataFrame([("m", 1.0, 1000.0), ("m", 2.0, -50.0)], "model string, y double, yhat double")
    got = metrics.log_scale_metrics(df).first()
    assert np.isfinite(got.mae) and got.r2_log < 0


def test_target_encoding_smooths_and_falls_back(spark):
    train = spark.createDataFrame([(1, "a", 10.0), (2, "a", None), (3, "b", 40.0), (4, "c", None), (5, None, 10.0)], "video_id long, k string, t double")
    fitted, overall = encoding.target_encode_fit(train, "k", "t")
    got = {r.k: r.encoding for r in fitted.collect()}
    assert overall.first()[0] == 20.0
    assert got == {"a": pytest.approx((10 + 600) / 31), "b": pytest.approx((40 + 600) / 31), "c": pytest.approx(20.0)}
    test = spark.createDataFrame([(1, "a"), (2, "new"), (3, None)], "video_id long, k string")
    found = {r.video_id: r.k_te for r in encoding.te_lookup(test, fitted, overall, "k").collect()}
    assert found[2] == found[3] == 20.0 and found[1] == pytest.approx(610 / 31)


def test_out_of_fold_encoding_ignores_the_own_fold(spark):
    train = spark.createDataFrame([(0, "a", 100.0), (1, "a", 0.0)], "video_id long, k string, t double")
    got = encoding.target_encode_oof(train, "k", "t", fold=F.col("video_id") % 2)
    values = {r.video_id: r.k_te for r in got.collect()}
    assert values == {0: pytest.approx((0 + 30 * 50) / 31), 1: pytest.approx((100 + 30 * 50) / 31)}


def test_folds_are_ordered_and_disjoint(spark):
    rows = [(i, d) for i, d in enumerate(days(40) * 5)]
    v = spark.createDataFrame(rows, "video_id long, create_date date")
    folds = splits.expanding_folds(v, 5, min_train=1, min_test=1).orderBy("fold").collect()
    assert len(folds) == 5
    for a, b in zip(folds, folds[1:]):
        assert a.test_end < b.test_start and a.train_rows + a.test_rows == b.train_rows
    assert all(f.train_end < f.test_start for f in folds)
    gap = splits.expanding_folds(v, 5, embargo_days=3, min_train=1, min_test=1).orderBy("fold").first()
    assert (gap.test_start - gap.train_end).days == 4 and gap.train_rows == folds[0].train_rows - 15
    assert splits.expanding_folds(v, 5).count() == 0 or all(f.test_rows >= 50 for f in splits.expanding_folds(v, 5).collect())


def test_time_split_interpolates_the_cutoff(spark):
    v = spark.createDataFrame([(i, d) for i, d in enumerate(days(11))] + [(99, None)], "video_id long, create_date date")
    got = splits.time_split(v).groupBy("is_train").count().collect()
    assert {r.is_train: r["count"] for r in got} == {True: 9, False: 2, None: 1}


def test_positional_split_breaks_ties_by_id(spark):
    v = spark.createDataFrame([(i, dt.date(2024, 1, 1)) for i in range(100)], "video_id long, create_date date")
    heads = {r.video_id for r in splits.positional_split(v, 0.85).where("is_head").collect()}
    assert heads == set(range(85))


def test_coercion_and_numeric_columns(spark):
    df = spark.createDataFrame([("1.5", 2), ("x", None)], "a string, b int")
    assert [tuple(r) for r in features.coerce_numeric(df, ["a", "b"]).collect()] == [(1.5, 2.0), (0.0, 0.0)]
    assert features.numeric_columns(df) == ["b"]


def test_feature_variants():
    assert len(features.feature_names()) == 44
    assert "velocity_1_3_topic_rank_pct" not in features.feature_names("gpu")
    assert not any("day7" in c for c in features.feature_names("v3", 3))


def test_p_values(spark):
    def tail(rho, n):
        return spark.range(1).select(stats.correlation_p_value(F.lit(rho).cast("double"), F.lit(n).cast("double"))).first()[0]

    assert tail(1.0, 9) == 0.0 and tail(0.0, 9) == pytest.approx(1.0) and tail(0.5, 2) is None and tail(None, 9) is None
    assert tail(-0.5, 20) == tail(0.5, 20)
    assert tail(0.5, 20) == pytest.approx(0.02475, abs=1e-4)  # t = 2.449 with 18 degrees of freedom
    assert tail(0.0001, 50) == pytest.approx(1.0, abs=1e-3)
    assert tail(0.9, 100) < 1e-30


def test_spearman_with_ties_and_nulls(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.integers(0, 9, 400).astype(float), "z": rng.normal(size=400)})
    pdf["incr_plays_3_30"] = pdf["x"] * 2 + rng.integers(0, 6, 400)
    pdf.loc[:50, "z"] = np.nan
    df = spark.createDataFrame(pdf)
    got = {r.feature: r for r in stats.spearman_report(df, ["x", "z"]).collect()}
    for c in ("x", "z"):
        part = pdf[[c, "incr_plays_3_30"]].dropna()
        assert got[c].rho == pytest.approx(part[c].rank().corr(part["incr_plays_3_30"].rank()))
        assert got[c].n == len(part)
    assert got["x"].p_value < 1e-20


def test_spearman_reads_only_written_tables_more_than_once(spark, monkeypatch):
    v = spark.range(3000).select(
        (F.col("id") * 7919 % 3001).cast("double").alias("incr_plays_3_30"), (F.col("id") % 1501).cast("double").alias("x"),
        F.when(F.col("id") % 5 > 0, F.col("id") * 31 % 2999).cast("double").alias("z"))
    looked, lookup = [], stats.lookup_join
    monkeypatch.setattr(stats, "lookup_join", lambda df, table, *more: looked.append((df, table)) or lookup(df, table, *more))
    got = {r.feature: r for r in stats.spearman_rho(v, ["x", "z"]).collect()}
    pdf = v.toPandas()
    for c in ("x", "z"):
        part = pdf[[c, "incr_plays_3_30"]].dropna()
        assert got[c].rho == pytest.approx(part[c].rank().corr(part["incr_plays_3_30"].rank())) and got[c].n == len(part)
    plans = [x._jdf.queryExecution().executedPlan().toString() for pair in looked for x in pair]
    assert len(looked) == 1 and not any(w in p for p in plans for w in ("Exchange", "Join"))


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    n = 140
    shock = rng.normal(size=n)
    steady, walk = np.zeros(n), np.cumsum(shock)
    for i in range(1, n):
        steady[i] = 0.5 * steady[i - 1] + shock[i]
    weekly = 100 + np.arange(n) * 2.0 + 10 * (np.arange(n) % 7)
    rows = [(name, d, float(x)) for name, s in (("steady", steady), ("walk", walk), ("weekly", weekly)) for d, x in zip(days(n), s)]
    return {"steady": steady, "walk": walk, "weekly": weekly}, spark.createDataFrame(rows, "topic string, date date, value double").cache()


def test_acf_and_pacf_against_numpy(series):
    arrays, df = series
    x = arrays["steady"] - arrays["steady"].mean()
    n = len(x)
    r = np.array([(x[: n - k] * x[k:]).sum() for k in range(9)])
    got = [row.acf for row in stats.acf(df, nlags=8).where("topic = 'steady'").orderBy("lag").collect()]
    np.testing.assert_allclose(got, r / r[0])
    adjusted = r / (n - np.arange(9))
    want = [1.0]
    for k in range(1, 9):
        matrix = np.array([[adjusted[abs(i - j)] for j in range(k)] for i in range(k)])
        want.append(np.linalg.solve(matrix, adjusted[1 : k + 1])[-1])
    got = [row.pacf for row in stats.pacf(df, nlags=8).where("topic = 'steady'").orderBy("lag").collect()]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_unit_root(series):
    got = {r.topic: r for r in stats.adf_test(series[1]).collect()}
    assert got["steady"].p_value < 0.01 < got["walk"].p_value
    table = series[1].sparkSession.createDataFrame([(-2.86,), (-3.43,), (3.0,), (-19.0,)], "s double")
    p = [r[0] for r in table.select(stats.unit_root_p_value(F.col("s"))).collect()]
    assert p[0] == pytest.approx(0.05, abs=0.002)
    assert p[1] == pytest.approx(0.01, abs=0.001)
    assert p[2:] == [1.0, 0.0]


def plain_unit_root(y, most_lags=None):
    """(statistic, lags, days) by one regression after the other."""
    step, n = np.diff(y), len(y)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    most = most if most_lags is None else min(most, most_lags)

    def regress(lags, skip):
        rows = np.arange(skip, len(step))
        x = np.column_stack([y[rows], np.ones(len(rows)), *[step[rows - k] for k in range(1, lags + 1)]])
        beta, *_ = np.linalg.lstsq(x, step[rows], rcond=None)
        rest = step[rows] - x @ beta
        return x, beta, rest @ rest

    scores = []
    for lags in range(most + 1):
        x, _, sse = regress(lags, most)
        scores.append(len(x) * np.log(sse / len(x)) + 2 * x.shape[1])
    best = int(np.argmin(scores))
    x, beta, sse = regress(best, best)
    spread = np.sqrt(np.linalg.inv(x.T @ x)[0, 0] * sse / (len(x) - x.shape[1]))
    return beta[0] / spread, best, len(x)


def test_unit_root_against_regressions(series):
    arrays, df = series
    for limit in (None, 0, 3):
        got = {r.topic: r for r in stats.adf_test(df, max_lags=limit).collect()}
        for name in ("steady", "walk"):
            statistic, lags, days_ = plain_unit_root(arrays[name], limit)
            assert (got[name].lags, got[name].n_used) == (lags, days_)
            assert got[name].statistic == pytest.approx(statistic, rel=1e-9)


def test_series_without_a_test(spark):
    rows = [("flat", d, 5.0) for d in days(40)] + [("short", d, float(i)) for i, d in enumerate(days(3))] + [("one", days(1)[0], 1.0)]
    df = spark.createDataFrame(rows, "topic string, date date, value double")
    got = {r.topic: tuple(r)[1:] for r in stats.adf_test(df).collect()}
    assert got == {t: (None, None, 0, 0) for t in ("flat", "short", "one")}
    assert {r.pacf for r in stats.pacf(df).where("topic = 'flat' and lag > 0").collect()} == {None}
    assert stats.adf_test(df.where("false")).count() == stats.pacf(df.where("false")).count() == 0
    assert {r.forecast for r in forecast.forecast_seasonal_ar(df.where("topic = 'short'")).collect()} <= {None}


def plain_seasonal(y, horizon):
    week = y[7:] - y[:-7]
    w = np.diff(week)
    rows = np.arange(7, len(w))
    lagged = np.column_stack([w[rows - k] for k in range(1, 8)])
    first, *_ = np.linalg.lstsq(lagged, w[rows], rcond=None)
    shock = np.zeros(len(w))
    shock[rows] = w[rows] - lagged @ first
    rows = np.arange(9, len(w))
    x = np.column_stack([w[rows - 1], w[rows - 7], w[rows - 8], shock[rows - 1]])
    (a, b, c, m), *_ = np.linalg.lstsq(x, w[rows], rcond=None)
    w, y, e, out = list(w), list(y), shock[-1], []
    for _ in range(horizon):
        w.append(a * w[-1] + b * w[-7] + c * w[-8] + m * e)
        y.append(w[-1] + y[-1] + y[-7] - y[-8])
        e = 0.0
        out.append(y[-1])
    return out


def test_seasonal_forecast_against_numpy(series):
    arrays, df = series
    got = forecast.forecast_seasonal_ar(df).where("topic <> 'weekly'").orderBy("topic", "date").toPandas()
    for name in ("steady", "walk"):
        np.testing.assert_allclose(got[got.topic == name].forecast, plain_seasonal(arrays[name][:112], 28), rtol=1e-6, atol=1e-6)


def test_forecasts_follow_trend_and_week(series):
    arrays, df = series
    for make in (forecast.forecast_trend_weekly, forecast.forecast_seasonal_ar):
        rows = make(df).where("topic = 'weekly'").orderBy("date").collect()
        assert len(rows) == 28
        np.testing.assert_allclose([r.forecast for r in rows], arrays["weekly"][112:], rtol=1e-6)


def test_registry_names():
    assert models.model_registry("best") == ["gbt_mape"]
    assert models.model_registry("xgb") == ["gbt_mae"]
    assert models.model_registry(["rf", "elasticnet"]) == ["elastic_net", "random_forest"]
    assert "quantile_forest" in models.model_registry("all")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert models.model_registry("nothing") == ["gbt_mape"]
    assert seen


def test_trials_repeat():
    a, b = models.draw_trials(models.GBT_SPACE, 4), models.draw_trials(models.GBT_SPACE, 4)
    assert a == b and all(200 <= t["trees"] <= 1000 and 0.01 <= t["rate"] <= 0.15 for t in a)
    assert set(a[0]) == {"trees", "rate", "depth", "leaf", "rows", "columns"}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random(600), rng.random(600)
    pdf = pd.DataFrame({"video_id": range(600), "y": 3 * a + rng.random(600), "a": a, "b": b})
    return spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("name", ["gbt_mape", "gbt_mse", "elastic_net", "ridge", "robust_huber"])
def test_models_beat_the_mean(table, name):
    params = {"trees": 15, "rate": 0.3, "depth": 3, "leaf": 10, "bins": 32, "penalty": 0.001}
    train, test = table.where("video_id % 3 > 0"), table.where("video_id % 3 = 0")
    rows = models.fit_predict(name, train, test, params).withColumn("model", F.lit(name))
    assert rows.count() == 200 and metrics.error_metrics(rows).first().r2 > 0.5


def test_ridge_equals_normal_equations(table):
    model = models.fit("ridge", table, {"penalty": 5.0})
    got = models.predict(model, table).orderBy("video_id").toPandas()
    pdf = table.toPandas().sort_values("video_id")
    x = pdf[["a", "b"]].to_numpy()
    spread, center = x.std(axis=0, ddof=1), x.mean(axis=0)
    z, y = (x - center) / spread, pdf["y"].to_numpy()
    n = len(y)
    scale = y.std(ddof=1)
    beta = np.linalg.solve(z.T @ z / n + 5.0 / n * np.eye(2), z.T @ ((y - y.mean()) / scale) / n) * scale
    np.testing.assert_allclose(got["yhat"], y.mean() + z @ beta, atol=0.02)


def test_linear_models_are_at_their_optimum(table):
    """The gradient of each objective over the scaled inputs, at the fitted coefficients."""
    pdf = table.toPandas()
    x, y = pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    n, scale = len(y), y.std(ddof=1)
    model = models.fit("elastic_net", table, {"penalty": 0.05, "mix": 0.5}).stages[-1]
    beta = model.coefficients.toArray()
    rest = (y - z @ beta - model.intercept) / scale
    assert rest.mean() == pytest.approx(0, abs=1e-6)
    slope = z.T @ rest / n - 0.05 / scale * 0.5 * beta / scale  # minus the smooth part's gradient, in units of the target
    for k in range(2):
        bound = 0.05 / scale * 0.5
        assert slope[k] == pytest.approx(np.sign(beta[k]) * bound, abs=2e-4) if beta[k] else abs(slope[k]) <= bound + 2e-4
    huber = models.fit("robust_huber", table, {"penalty": 0.0}).stages[-1]
    beta, sigma = huber.coefficients.toArray(), huber.scale
    pull = np.clip((y - z @ beta - huber.intercept) / sigma, -1.35, 1.35)
    assert abs(pull.mean()) < 1e-3 and np.abs(z.T @ pull / n).max() < 1e-3


def test_search_refit_and_folds(spark, table):
    trials = models.hyper_search(table.withColumn("create_date", F.lit("2024-01-01").cast("date")), "elastic_net", trials=4)
    rows = trials.collect()
    assert [r.smape for r in rows] == sorted(r.smape for r in rows) and {r.trial for r in rows} == {0, 1, 2, 3}
    marked = table.withColumn("is_train", F.col("video_id") % 3 > 0)
    model, board = models.refit_best(marked, trials, "elastic_net")
    row = board.first()
    assert row.model == "elastic_net_tuned" and row.n == 200 and row.r2_log > 0.5
    assert model.stages[-1].getRegParam() == pytest.approx(rows[0].penalty)


def test_quantile_forest_orders_and_covers(table):
    forest = models.fit_quantile_forest(table, {"trees": 10, "depth": 5, "leaf": 20, "bins": 32})
    rows = forest.predict(table).toPandas()
    assert ((rows.p10 <= rows.p50) & (rows.p50 <= rows.p90)).all() and len(rows) == 600
    assert 0.6 < ((rows.y >= rows.p10) & (rows.y <= rows.p90)).mean() <= 1.0


def plain_quantiles(model, train, rows, probs):
    """Weights of all training targets for each row, from the leaves that both share, as in the published method."""
    def leaves(df):
        pdf = model.transform(df).select("video_id", "y", models.vector_to_array("leaf").alias("leaf")).toPandas()
        return pdf.video_id.to_numpy(), pdf.y.to_numpy(), np.stack(pdf.leaf)

    _, targets, theirs = leaves(train)
    order = np.argsort(targets)
    found = {}
    for i, own in zip(*leaves(rows)[::2]):
        shared = theirs == own
        weights = (shared / shared.sum(axis=0)).mean(axis=1)[order]
        found[i] = [targets[order][np.searchsorted(np.cumsum(weights), p - 1e-9)] for p in probs]
    return found


@pytest.mark.parametrize("most", [models.BROADCAST_TARGETS, 0])
def test_quantile_forest_equals_weighted_targets(table, monkeypatch, most):
    monkeypatch.setattr(models, "BROADCAST_TARGETS", most)  # 0: the leaves meet the rows in a shuffle
    train, rows = table.where("video_id % 6 > 0"), table.where("video_id % 6 = 0 or video_id < 480")
    forest = models.fit_quantile_forest(train, {"trees": 12, "depth": 6, "leaf": 5, "bins": 32})
    got = {r.video_id: [r.p10, r.p50, r.p90] for r in forest.predict(rows.repartition(5)).collect()}
    want = plain_quantiles(forest.model, train, rows, (0.1, 0.5, 0.9))
    assert len(got) == 500 and got.keys() == want.keys()
    for i in got:
        np.testing.assert_allclose(got[i], want[i])


@pytest.mark.parametrize("most", [models.BROADCAST_TARGETS, 0])
def test_rows_of_the_same_bins_are_predicted_once(table, monkeypatch, most):
    monkeypatch.setattr(models, "BROADCAST_TARGETS", most)
    forest = models.fit_quantile_forest(table, {"trees": 4, "depth": 3, "leaf": 20, "bins": 8})
    copies = table.select(*table.columns, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("copy"))
    rows = copies.withColumn("video_id", F.col("video_id") * 4 + F.col("copy")).drop("copy")
    want = {r.video_id: (r.p10, r.p90) for r in forest.predict(table).collect()}
    written, write = {}, models.materialize
    monkeypatch.setattr(models, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    got = {r.video_id: (r.p10, r.p90) for r in forest.predict(rows).collect()}
    assert len(got) == 2400 and all(got[i] == pytest.approx(want[i // 4]) for i in got)
    assert 1 < written["quantiles"].count() <= 600


def test_large_leaves_keep_steps(table, monkeypatch):
    monkeypatch.setattr(models, "LEAF_STEPS", 16)
    forest = models.fit_quantile_forest(table, {"trees": 3, "depth": 1, "leaf": 100, "bins": 32})
    held = forest.leaves.selectExpr("size(targets) as n", "aggregate(shares, 0d, (a, x) -> a + x) as whole").collect()
    assert all(r.n <= 16 and r.whole == pytest.approx(1.0) for r in held)
    exact = plain_quantiles(forest.model, table, table, (0.1, 0.5, 0.9))
    got = {r.video_id: [r.p10, r.p50, r.p90] for r in forest.predict(table).collect()}
    assert max(abs(a - b) for i in got for a, b in zip(got[i], exact[i])) < 0.4  # targets run from 0 to 4


def test_one_forest_serves_both_and_fits_run_side_by_side(table, monkeypatch):
    frame = table.withColumn("is_train", F.col("video_id") % 3 > 0)
    params = {"trees": 4, "depth": 3, "leaf": 20, "bins": 32}
    apart = {n: models.run_models(frame, n, params).first().asDict() for n in ("random_forest", "quantile_forest")}
    fitted, plain = [], models.fit
    monkeypatch.setattr(models, "fit", lambda name, *rest: fitted.append(name) or plain(name, *rest))
    together = models.run_models(frame, ["random_forest", "quantile_forest"], params).collect()
    assert fitted == ["random_forest"]
    for row in together:
        assert row.asDict() == pytest.approx(apart[row.model])
    meeting = threading.Barrier(3, timeout=60)  # opens only when three calls run at once
    assert models.side_by_side(table.sparkSession, lambda i: meeting.wait() and 0 or i, [3, 1, 2], 3) == [3, 1, 2]


def dated(table):
    return table.withColumn("create_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("video_id").cast("int")))


def test_boosting_stops_by_itself(table):
    asked = {"trees": 60, "rate": 0.3, "depth": 3, "leaf": 10, "bins": 32, "tolerance": 0.0}
    stopped = models.fit("gbt_mse", dated(table), asked)
    assert 1 < stopped.stages[-1].getNumTrees < 60
    assert models.fit("gbt_mse", table, {**asked, "trees": 7}).stages[-1].getNumTrees == 7  # no dates: nothing to stop by


def test_search_is_the_same_with_any_threads(table):
    space = {**models.GBT_SPACE, "trees": ("int", 3, 6), "depth": ("int", 2, 3)}
    one, four = (
        models.hyper_search(dated(table), "gbt_mape", space, trials=4, threads=n, held={"bins": 32}).collect() for n in (1, 4)
    )
    assert one == four and len({r.smape for r in one}) > 1
    assert set(one[0].asDict()) == {"trial", "smape", *models.GBT_SPACE}


def test_search_puts_rows_into_vectors_once(table, monkeypatch):
    space = {**models.GBT_SPACE, "trees": ("int", 3, 6), "depth": ("int", 2, 3)}
    calls, plain = [], models.VectorAssembler._transform
    monkeypatch.setattr(models.VectorAssembler, "_transform", lambda self, df: calls.append(1) or plain(self, df))
    kept = table.sparkSession.sparkContext._jsc.getPersistentRDDs().size()
    found = models.hyper_search(dated(table), "gbt_mape", space, trials=3, threads=2, held={"bins": 32}).collect()
    assert len(calls) == 1
    assert table.sparkSession.sparkContext._jsc.getPersistentRDDs().size() <= kept
    marked = models.splits.positional_split(dated(table), 0.85).localCheckpoint()
    inputs = models.input_columns(table)
    drawn = models.draw_trials(space, 3)
    for row in found:  # as fitted and scored one by one
        model = models.fit("gbt_mape", marked, {"bins": 32, **drawn[row.trial]}, inputs, ~F.col("is_head"))
        alone = models.SmapeEvaluator().evaluate(models.predict(model, marked.where("not is_head")))
        assert row.smape == pytest.approx(alone, rel=0.05)  # the sampling follows the partitions


def test_error_of_the_search_is_that_of_the_board(table):
    scored = table.select("y", (F.col("y") * 0.9 - 0.1).alias("yhat"))
    board = metrics.log_scale_metrics(scored, by=()).first().smape
    assert models.SmapeEvaluator().evaluate(scored) == pytest.approx(board)
    assert not models.SmapeEvaluator().isLargerBetter()


def test_fold_encodings_equal_those_fitted_per_fold(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({
        "video_id": range(400), "author_id": rng.integers(0, 40, 400), "topic": rng.choice(["a", "b", None], 400),
        "create_date": rng.choice(days(60), 400), "incr_plays_3_30": rng.choice([1.0, 5.0, 9.0, np.nan], 400),
    })
    rows = spark.createDataFrame(
        [tuple(None if x != x else x for x in r) for r in pdf.astype(object).itertuples(index=False)],
        "video_id long, author_id long, topic string, create_date date, incr_plays_3_30 double",
    ).cache()
    folds = splits.expanding_folds(rows, 4, min_train=1, min_test=1).orderBy("fold").collect()
    table = models.with_fold_encodings(rows, folds).cache()
    assert len(folds) == 4 and table.count() == 400
    for place, f in enumerate(folds):
        early = rows.where(F.col("create_date") <= F.lit(f.train_end))
        want = {r.video_id: (r.author_id_te, r.topic_te) for r in encoding.with_encodings(rows, early).collect()}
        for r in table.collect():
            assert (r.author_id_all[place], r.topic_all[place]) == pytest.approx(want[r.video_id])


def test_one_hot_without_names(spark):
    v = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "c")], "video_id long, topic string")
    got = {r.video_id: (r.topic_size, r.topic_place) for r in features.one_hot_topic(v).select("video_id", *features.hot_place()).collect()}
    assert got == {1: (2, 1), 2: (2, None), 3: (2, None), 4: (2, 0), 5: (2, 0)}
    known = features.topic_places(v.where("topic <> 'c'"))
    assert {r.video_id: r.topic_vec.toArray().tolist() for r in features.one_hot_topic(v, known).collect()} == {
        1: [1.0], 2: [0.0], 3: [0.0], 4: [0.0], 5: [0.0]}
    assert features.one_hot_topic(v.where("topic is null")).first().topic_vec.size == 0
    many = spark.range(100_000).select(F.col("id").alias("video_id"), F.format_string("t%06d", "id").alias("topic"))
    places = features.one_hot_topic(many).select("video_id", *features.hot_place())
    found = places.agg(F.max("topic_size"), F.count("topic_place"), F.countDistinct("topic_place"), F.min("topic_place")).first()
    assert tuple(found) == (99_999, 99_999, 99_999, 0)
    assert len(features.one_hot_topic(many).columns) == 3


def test_importance_names_the_signal(table):
    model = models.fit("gbt_mse", table, {"trees": 5, "depth": 3, "leaf": 10, "bins": 32})
    assert models.feature_importance(model, table).first().feature == "a"


def test_baselines_and_boards(spark):
    v = spark.createDataFrame([(1, 10, 4, 2.0), (2, None, 9, 1.0), (3, 30, None, -5.0)], "video_id long, incr_plays_3_30 long, plays_day3 long, velocity_1_3 double")
    got = {r.model: r for r in baselines.run_baselines(v).collect()}
    assert got["All Zero"].mae == pytest.approx(40 / 3) and got["Mean Baseline"].r2 == pytest.approx(0.0)
    assert {r.y for r in baselines.baseline_mean(v, "drop").collect()} == {10.0, 30.0, None}
    board = leaderboard.leaderboard_sort(leaderboard.leaderboard_union({"A": [baselines.run_baselines(v)], "B": [spark.createDataFrame([("s", 1.0, 2.0)], "model string, smape double, extra double")]}))
    assert board.first().model == "s" and "extra" in board.columns and board.count() == 5


def test_forest_is_the_same_split_by_levels_or_in_one_task(table):
    shape = {"trees": 5, "depth": 6, "least": 5, "bins": 32}
    whole = forest.fit_forest(table, ["a", "b"], **shape)
    by_levels = forest.fit_forest(table.repartition(7), ["a", "b"], **shape, local_rows=60)
    both = table.select("y", "a", "b")
    one, other = (f.transform(both).orderBy("a").toPandas() for f in (whole, by_levels))
    np.testing.assert_allclose(one.yhat, other.yhat)
    assert 1 - ((one.yhat - one.y) ** 2).sum() / ((one.y - one.y.mean()) ** 2).sum() > 0.5
    assert sorted(len(t) for t in whole.trees) == sorted(len(t) for t in by_levels.trees)
    for nodes in by_levels.trees:
        leaf = nodes["feature"] < 0
        assert nodes["size"][leaf].min() >= 5 and leaf.sum() == 1 + (~leaf).sum()
    again = forest.Forest.read(by_levels.table(table.sparkSession))
    assert again.inputs == ["a", "b"] and all((x == y).all() for x, y in zip(again.trees, by_levels.trees))


def test_targets_of_large_leaves_are_not_gathered(table, monkeypatch):
    fitted = models.fit("random_forest", table, {"trees": 3, "depth": 4, "leaf": 20, "bins": 32})
    near = {(r.tree, r.leaf): r for r in forest.leaf_targets(fitted, table, 16).collect()}
    monkeypatch.setattr(forest, "LOCAL_ROWS", 40)  # some leaves hold more than that
    far = {(r.tree, r.leaf): r for r in forest.leaf_targets(fitted, table, 16).collect()}
    assert near.keys() == far.keys() and len(near) > 6
    for key, r in near.items():
        assert sum(r.shares) == pytest.approx(1.0)
        np.testing.assert_allclose(*(np.array(sorted(zip(x.targets, x.shares))) for x in (r, far[key])))
    assert any(t["size"][t["feature"] < 0].max() > 40 for t in fitted.trees)


def test_rows_ask_for_a_leaf_once(table, monkeypatch):
    fitted = models.fit_quantile_forest(table, {"trees": 4, "depth": 3, "leaf": 20, "bins": 32})
    want = {r.video_id: r.asDict() for r in fitted.predict(table).collect()}
    monkeypatch.setattr(models, "BROADCAST_TARGETS", 0)
    monkeypatch.setattr(models, "ASKING_ROWS", 50)
    got = {r.video_id: r.asDict() for r in fitted.predict(table).collect()}
    assert got.keys() == want.keys()
    for i in got:
        assert got[i] == pytest.approx(want[i])
    part = pa.table({"_part": [7] * 600, "_leaves": [r.at for r in table.select(fitted.model.leaf_places(table).alias("at")).collect()]})
    assert models._asked_leaves(part).num_rows == fitted.leaves.count()


def shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in local for top, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(10_000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    assert tables.materialize(rows, "test-counts").count() == 7
    assert spark.conf.get(name) == setting
    for _ in range(50):
        if left := shuffle_files(spark) - before:
            time.sleep(0.1)  # files are removed a little later
    assert len(left) <= 1  # that of the count above


def test_trees_take_turns(table, monkeypatch):
    shape = {"trees": 5, "depth": 6, "leaf": 5, "bins": 32}
    whole = models.fit_quantile_forest(table, shape)
    turns, finish = [], forest._finish
    monkeypatch.setattr(forest, "MOVED_BYTES", 5_000)  # those of one tree
    monkeypatch.setattr(forest, "_finish", lambda rows, trees, small, *rest: turns.append(list(small)) or finish(rows, trees, small, *rest))
    parted = models.fit_quantile_forest(table, shape)
    assert turns == [[0], [1], [2], [3], [4]]
    one, other = (q.predict(table).orderBy("video_id").toPandas() for q in (whole, parted))
    assert len(one) == 600 and whole.leaves.count() == parted.leaves.count()
    np.testing.assert_allclose(one, other)
    means = (q.model.transform(table).orderBy("video_id").toPandas().yhat for q in (whole, parted))
    np.testing.assert_allclose(*means)  # rows reach a node in any order, so the last digits may differ


def test_parts_take_turns(table, monkeypatch):
    fitted = models.fit_quantile_forest(table, {"trees": 4, "depth": 3, "leaf": 20, "bins": 32})
    want = {r.video_id: r.asDict() for r in fitted.predict(table).collect()}
    monkeypatch.setattr(models, "BROADCAST_TARGETS", 0)
    monkeypatch.setattr(models, "ASKING_ROWS", 10)
    monkeypatch.setattr(models, "ASKED_BYTES", 1)
    names, write = [], models.materialize
    monkeypatch.setattr(models, "materialize", lambda df, name: names.append(name) or write(df, name))
    rows = table.where("video_id % 7 = 0")
    got = {r.video_id: r.asDict() for r in fitted.predict(rows).collect()}
    assert names.count("quantiles") > 1 and len(got) == rows.count()
    for i in got:
        assert got[i] == pytest.approx(want[i])


def test_quantiles_by_cells_equal_sorted_targets(monkeypatch):
    monkeypatch.setattr(models, "CELL_CUTS", 7)
    monkeypatch.setattr(models, "CELL_ROWS", 50)
    rng, probs = np.random.default_rng(5), [0.1, 0.5, 0.9, 1.0]
    held = [(t, leaf, rng.choice([0.0, 0.0, *rng.random(9).round(2)], rng.integers(1, 30))) for t in range(6) for leaf in range(0, 40, 2)]
    order = rng.permutation(len(held))
    held = [held[i] for i in order]
    shares = [np.full(len(v), 1 / len(v)) for *_, v in held]
    at = rng.integers(0, 40, (170, 6))  # odd leaves keep nothing
    at[3] = 1
    got = models.leaf_quantiles(
        at, np.array([t for t, *_ in held]), np.array([x for _, x, _ in held]), np.array([len(v) for *_, v in held]),
        np.concatenate([v for *_, v in held]), np.concatenate(shares), probs)
    for i, leaves in enumerate(at):
        own = [k for k, (t, leaf, _) in enumerate(held) if leaves[t] == leaf]
        values, weights = (np.concatenate([x[k] for k in own] or [[]]) for x in ([v for *_, v in held], shares))
        np.testing.assert_array_equal(got[i], models.weighted_quantiles(values, weights, probs))
