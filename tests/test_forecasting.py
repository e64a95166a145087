"""Forecasts against the same models fitted row by row, and scores against loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodic.operators import forecasting as P


def rows(n=90, past=6, steps=4, seed=2):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=(n, past)) * 3 + 5, rng.normal(size=(n, past)), np.full((n, 2), 7.0)
    y = a[:, -1:] * [1, 0.5, 0.2, 0.1] + b[:, :1] + rng.normal(size=(n, steps)) * 0.1
    fold = np.sort(rng.integers(4, size=n))
    return a, b, c, y, fold


def frame(spark, a, b, c, y, fold):
    data = [(1, i, *(v[i].tolist() for v in (a, b, c, y)), int(fold[i])) for i in range(len(a))]
    return spark.createDataFrame(data, "series_id long, origin long, a array<double>, b array<double>, c array<double>, future array<double>, fold long").repartition(3)


def test_nested_models_equal_separate_fits(spark):
    a, b, c, y, fold = rows()
    models = {"one": ["a"], "two": ["a", "b"], "other": ["b", "c"]}
    got = {(r.model, r.origin): r.forecast for r in P.linear_backtest(frame(spark, a, b, c, y, fold), models, alpha=2.0).collect()}
    assert len(got) == 3 * (fold > 0).sum()
    parts = {"a": a, "b": b, "c": c}
    for name, used in models.items():
        x = np.hstack([parts[u] for u in used])
        for f in range(1, 4):
            tr, te = fold < f, fold == f
            mean, sd = x[tr].mean(0), x[tr].std(0)
            z = (x - mean) / np.where(sd > 1e-9, sd, 1)
            w = np.linalg.solve(z[tr].T @ z[tr] + 2.0 * np.eye(x.shape[1]), z[tr].T @ (y[tr] - y[tr].mean(0)))
            assert np.allclose([got[name, i] for i in np.flatnonzero(te)], z[te] @ w + y[tr].mean(0), atol=1e-6), (name, f)


def test_backtest_of_nothing(spark):
    d = frame(spark, *rows(20))
    assert P.linear_backtest(d.limit(0), {"one": ["a"]}).columns[-2:] == ["model", "forecast"]
    assert P.linear_backtest(d.withColumn("fold", F.lit(1).cast("long")), {"one": ["a"]}).count() == 0


def test_decomposition(spark):
    x = [1.0, 2.0, 4.0, 8.0, 16.0, 3.0, 2.0]
    (r,) = P.decomposed(spark.createDataFrame([(1, x)], "i long, v array<double>"), "v", 5).collect()
    padded = np.pad(x, 2, mode="edge")
    want = [padded[i : i + 5].mean() for i in range(7)]
    assert np.allclose(r.trend, want) and np.allclose(np.add(r.trend, r.remainder), x)


def test_lines_between_anchors(spark):
    anchors, v = [1, 4, 5, 9], [2.0, 8.0, -1.0, 3.0]
    (r,) = spark.createDataFrame([(1, v)], "i long, v array<double>").select(P.between(anchors, F.col("v"), 12).alias("f")).collect()
    assert np.allclose(r.f, np.interp(np.arange(12), anchors, v))


def test_boosted_anchors_learn_a_level(spark):
    data = [(1, i, [float(i % 7)] * 6, [float(i % 7) * 2] * 5) for i in range(140)]
    d = spark.createDataFrame(data, "series_id long, origin long, h array<double>, future array<double>")
    got = P.boosted_anchors(d.where("origin < 105"), d.where("origin >= 105"), "h", [0, 2, 4], 5, 3, 15).collect()
    assert len(got) == 35 and all(len(r.forecast) == 5 and abs(r.forecast[1] - r.future[1]) < 2.5 for r in got)


def test_event_scores_equal_a_loop(spark):
    rng = np.random.default_rng(1)
    data = [("m", int(f), rng.normal(size=6).round(3).tolist(), (rng.normal(size=6) + (2 if i % 2 else 0)).round(3).tolist()) for i, f in enumerate(np.repeat([1, 2, 3], 8))]
    data += [("m", 4, [0.0] * 6, [0.1] * 6)]
    d = spark.createDataFrame(data, "model string, fold long, forecast array<double>, future array<double>")
    scale = spark.createDataFrame([(1, None), (2, 0.5), (3, 2.0), (4, 1.0)], "fold long, scale double")
    scored = P.event_scores(d, scale, 2.0)
    got = {(r.fold, r.metric): r.value for r in scored.collect()}
    for f, s in ((1, None), (2, 0.5), (3, 2.0), (4, 1.0)):
        p, y = (np.array([r[k] for r in data if r[1] == f]) for k in (2, 3))
        e, ev = p - y, y.max(1) > 2.0
        rms = lambda v: float(np.sqrt((v**2).mean())) if v.size else None
        want = {"rmse": rms(e), "event_rmse": rms(e[ev]), "quiescent_rmse": rms(e[~ev]), "n_event_windows": float(ev.sum()), "peak_mae": np.abs(p.max(1) - y.max(1)).mean(), "mae": np.abs(e).mean(), "mase": s and np.abs(e).mean() / s, "rmse_last": rms(e[:, -1])}
        for m, v in want.items():
            assert got[f, m] == (None if v is None else pytest.approx(v)), (f, m)
    total = {r.metric: r for r in P.over_folds(scored).collect()}
    assert total["mase"].folds == 3 and total["event_rmse"].folds == 3 and total["rmse"].mean == pytest.approx(np.mean([got[f, "rmse"] for f in range(1, 5)]))


def test_scale_sees_earlier_rows_only(spark):
    t0 = dt.datetime(2024, 1, 1)
    v = [float(i * i % 37) for i in range(40)]
    d = spark.createDataFrame([(s, t0 + dt.timedelta(hours=i), v[i] + s) for s in (1, 2) for i in range(40)], "series_id long, ts timestamp_ntz, v double")
    fold = F.when(F.hour("ts") + 24 * (F.dayofyear("ts") - 1) < 20, 1).when(F.dayofyear("ts") == 1, 2).otherwise(3)
    got = {r.fold: r.scale for r in P.train_scale(d, "v", fold, 5).collect()}
    diff = [abs(v[i] - v[i - 5]) for i in range(5, 40)]
    assert got[1] is None and got[2] == pytest.approx(np.mean(diff[:15])) and got[3] == pytest.approx(np.mean(diff[:19]))


def test_origins_have_whole_windows(spark):
    t0 = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([(1, t0 + dt.timedelta(hours=i), float(i), float(-i)) for i in range(20)], "series_id long, ts timestamp_ntz, a double, b double")
    got = sorted(P.origins(d, ["a", "b"], "b", 4, 3, 5).collect(), key=lambda r: r.origin)
    assert [(r.a, r.b, r.future) for r in got] == [([float(i - 4 + j) for j in range(4)], [float(-(i - 4 + j)) for j in range(4)], [float(-(i + j)) for j in range(3)]) for i in (4, 9, 14)]
