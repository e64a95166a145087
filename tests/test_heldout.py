"""Held-out models from moments against loops that fit every fold on its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodic.operators import heldout as H

MODELS = {"bayes": H.bayes(), "ridge": H.ridge(0.5), "lda": H.lda(1e-2), "pca": H.components(0.9, H.ridge(0.5))}


def data(n=240, groups=12, classes=3, k=4, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(classes, size=n)
    x = rng.normal(size=(n, k)) * [1, 5, 0.1, 2] + np.outer(y, [0.8, 3, 0, -1]) + [0, 100, 0, -3]
    g = rng.integers(groups, size=n)
    g[:3] = 99  # a group of its own class mix
    return x, y, g


def frame(spark, x, y, g):
    rows = [(i, f"g{b}", int(c), [float(v) for v in a]) for i, (a, c, b) in enumerate(zip(x, y, g))]
    return spark.createDataFrame(rows, "id long, grp string, y long, x array<double>").repartition(3)


def fit_predict(name, xtr, ytr, xte):
    """The same models, written from their definitions on rows."""
    classes = np.unique(ytr)
    if name in ("ridge", "pca"):
        mean, sd = xtr.mean(0), xtr.std(0)
        a, b = (xtr - mean) / sd, (xte - mean) / sd
        if name == "pca":
            u, s, vt = np.linalg.svd(a - a.mean(0), full_matrices=False)
            kept = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.9)) + 1
            a, b = a @ vt[:kept].T, b @ vt[:kept].T
            sd2 = a.std(0)
            a, b = a / sd2, b / sd2
        w = np.array([len(ytr) / (len(classes) * (ytr == c).sum()) for c in ytr])
        a1, b1 = np.column_stack([a, np.ones(len(a))]), np.column_stack([b, np.ones(len(b))])
        t = np.where(ytr[:, None] == classes, 1.0, -1.0)
        coef = np.linalg.solve(a1.T @ (a1 * w[:, None]) + 0.5 * np.diag([1.0] * a.shape[1] + [0]), a1.T @ (t * w[:, None]))
        return classes[(b1 @ coef).argmax(1)]
    means = np.array([xtr[ytr == c].mean(0) for c in classes])
    if name == "bayes":
        var = np.array([xtr[ytr == c].var(0) for c in classes]) + 1e-9 * xtr.var(0).max()
        s = -0.5 * (np.log(2 * np.pi * var)[None] + (xte[:, None] - means) ** 2 / var).sum(2)
        return classes[s.argmax(1)]
    pooled = sum((xtr[ytr == c] - m).T @ (xtr[ytr == c] - m) for c, m in zip(classes, means)) / len(xtr)
    pooled = 0.99 * pooled + 0.01 * np.trace(pooled) / len(pooled) * np.eye(len(pooled))
    d = xte[:, None] - means
    return classes[np.einsum("nci,ij,ncj->nc", d, np.linalg.inv(pooled), d).argmin(1)]


def test_leave_one_group_out_equals_a_loop(spark):
    x, y, g = data()
    d = frame(spark, x, y, g)
    fits = H.fitted(d, "x", "y", "grp", MODELS)
    assert fits.count() == len(MODELS) * len(set(g)) and fits.where("error IS NOT NULL").count() == 0
    got = {(r.model, r.id): r.predicted for r in H.predictions(d, "x", "grp", fits).collect()}
    assert len(got) == len(MODELS) * len(y)
    for name in MODELS:
        for held in set(g):
            want = fit_predict(name, x[g != held], y[g != held], x[g == held])
            assert [got[name, i] for i in np.flatnonzero(g == held)] == want.tolist(), (name, held)


def test_a_failing_model_is_a_row(spark):
    def broken(n, s, g):
        raise RuntimeError("no licence")

    x, y, g = data(60, 4, 2)
    d = frame(spark, x, y, g)
    fits = H.fitted(d, "x", "y", "grp", {"broken": broken, "nan": lambda n, s, g: (np.full((2, 8), np.nan), np.zeros(2)), "lda": H.lda()})
    errors = {r.model: r.error for r in fits.where("error IS NOT NULL").collect()}
    assert errors == {"broken": "RuntimeError: no licence", "nan": "ValueError: coefficients are not finite"}
    p = H.predictions(d, "x", "grp", fits)
    assert p.count() == 60 and p.where("model <> 'lda'").count() == 0
    swept = H.sweep({"lda": lambda: H.results(H.scores(p, "y", ["model"]), "t"), "gone": lambda: 1 / 0}, "t").collect()
    assert len(swept) == 7 and [r.error for r in swept if r.model == "gone"] == ["ZeroDivisionError: division by zero"]


def test_one_class_and_missing_features(spark):
    rows = [(i, f"g{i % 3}", 1, [float(i), 2.0]) for i in range(9)] + [(20, "g0", 1, [None, 1.0]), (21, "g1", 1, [float("nan"), 1.0])]
    d = spark.createDataFrame(rows, "id long, grp string, y long, x array<double>")
    fits = H.fitted(d, "x", "y", "grp", {"lda": H.lda()})
    assert [r.error for r in fits.collect()] == ["ValueError: fewer than two classes to train on"] * 3
    assert H.predictions(d, "x", "grp", fits).count() == 0 and H.fitted(d.limit(0), "x", "y", "grp", MODELS).count() == 0
    assert H.moments(d, "x", ["grp"]).agg(F.sum(F.get("m", F.lit(0)))).first()[0] == 9


def test_repeats_scores_and_frames(spark):
    from episodic.plans.tables import with_group_folds

    x, y, g = data(200, 15, 2)
    d = H.repeated(frame(spark, x, y, g), "grp", "y", 3, 2, with_group_folds)
    assert d.count() == 400 and d.groupBy("run", "grp").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    p = H.predictions(d, "x", "fold", H.fitted(d, "x", "y", "fold", {"ridge": H.ridge()}, "run"), "run")
    rows = p.select("run", "fold", "y", "predicted", "probability").collect()
    f1 = []
    for key in {(r.run, r.fold) for r in rows}:
        part = [(r.y, r.predicted) for r in rows if (r.run, r.fold) == key]
        each = []
        for c in {a for pair in part for a in pair}:
            hit, t, q = sum(a == b == c for a, b in part), sum(a == c for a, _ in part), sum(b == c for _, b in part)
            each.append(2 * hit / (t + q))
        f1.append(np.mean(each))
    r = {r.metric: r for r in H.results(H.scores(p, "y", ["model", "run", "fold"]), "t").collect()}
    assert set(r) == set(H.METRICS) and r["macro_f1"].mean == pytest.approx(np.mean(f1)) and r["macro_f1"].std == pytest.approx(np.std(f1))
    assert all(abs(sum(v.probability) - 1) < 1e-9 for v in rows)
    cells = H.confusion_frame(p, "y", "t").collect()
    assert len(cells) == 4 and sum(c["count"] for c in cells) == 400
    assert H.results(H.scores(p, "y", ["model"]), "t").where("std IS NOT NULL").count() == 0


def test_boundary_is_the_median_of_the_others(spark):
    rows = [("a", [0.5, 0.5]), ("a", [0.9, 0.1]), ("b", [0.6, 0.4]), ("c", [1.0, 0.0]), ("c", [0.8, 0.2])]
    h = [-(max(p) * np.log2(max(p)) + (1 - max(p)) * np.log2(1 - max(p))) if max(p) < 1 else 0.0 for _, p in rows]
    got = {r.g: r for r in H.boundary(spark.createDataFrame(rows, "g string, probability array<double>"), "g").collect()}
    for name in "abc":
        own, others = [v for v, r in zip(h, rows) if r[0] == name], [v for v, r in zip(h, rows) if r[0] != name]
        assert got[name].median_bits == pytest.approx(np.median(own), abs=1e-6) and got[name].others_bits == pytest.approx(np.median(others), abs=1e-6)
        assert got[name].above == pytest.approx(np.mean([v > np.median(others) for v in own]))


def test_routes_side_by_side(spark):
    schema = "table string, model string, metric string, mean double, std double"
    a = spark.createDataFrame([("cv", "lda", "macro_f1", 0.5, 0.1), ("cv", "bayes", "macro_f1", 0.75, None), ("cv", "lda", "kappa", 0.2, 0.1), ("logo", "lda", "macro_f1", 0.1, None)], schema)
    b = spark.createDataFrame([("cv", "lda", "macro_f1", 0.9, 0.05), ("cv", "ridge", "macro_f1", 0.8, 0.05)], schema)
    none = a.where("table = 'gone'")
    got = [r.asDict() for r in H.compare_routes({"one": a, "two": b, "three": none}, "cv", ["macro_f1"]).orderBy("rank").collect()]
    assert got == [
        {"rank": 1, "model": "bayes", "one · macro_f1": "0.750", "two · macro_f1": None},
        {"rank": 2, "model": "lda", "one · macro_f1": "0.500 ± 0.100", "two · macro_f1": "0.900 ± 0.050"},
        {"rank": 3, "model": "ridge", "one · macro_f1": None, "two · macro_f1": "0.800 ± 0.050"},
    ]
    assert H.compare_routes({"one": a}, "gone", ["macro_f1"]).count() == 0


def test_chance_and_cells_of_a_pass(spark):
    tidy = spark.createDataFrame([("cv", "lda", "macro_f1", 0.5, 0.1), ("cv", "lda", "roc_auc", 0.7, None), ("cv", "lda", "mcc", 0.2, 0.1)], "table string, model string, metric string, mean double, std double")
    got = {r.metric: (r.lo, r.hi, r.chance) for r in H.with_chance(tidy, 3).collect()}
    assert got["macro_f1"] == pytest.approx((0.4, 0.6, 1 / 3)) and got["roc_auc"] == (0.7, 0.7, 0.5) and got["mcc"][2] is None
    cells = spark.createDataFrame([("cv", "lda", 0, 0, 8), ("cv", "lda", 0, 1, 2), ("cv", "lda", 1, 0, 0), ("cv", "lda", 1, 1, 0)], "table string, model string, true long, pred long, count long")
    cell = {(r["true"], r["pred"]): (r.per_pass, r.share) for r in H.per_pass(cells, 5).collect()}
    assert cell == {(0, 0): (1.6, 0.8), (0, 1): (0.4, 0.2), (1, 0): (0.0, None), (1, 1): (0.0, None)}


def test_three_classes_against_the_rest(spark):
    x, y, g = data(180, 9, 3)
    p = H.predictions(frame(spark, x, y, g), "x", "grp", H.fitted(frame(spark, x, y, g), "x", "y", "grp", {"lda": H.lda()}))
    rows = p.collect()
    areas = []
    for c in range(3):
        pos, neg = (np.array([r.probability[r.classes.index(c)] for r in rows if (r.y == c) is is_c]) for is_c in (True, False))
        areas.append(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))
    value = {r.metric: r.value for r in H.scores(p, "y", ["model"]).collect()}
    assert value["roc_auc"] == pytest.approx(np.mean(areas))
