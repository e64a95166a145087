"""Attributions against enumeration and identities; exact quantiles against NumPy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodic.operators import attribution as A
from episodic.operators import heldout as H
from episodic.operators import models as D
from episodic.operators import windows as W
from episodic.operators.quantiles import exact_quantiles


def frame(spark, x, y=None):
    rows = [(i, int(y[i]) if y is not None else 0, [float(v) for v in a]) for i, a in enumerate(x)]
    return spark.createDataFrame(rows, "id long, y long, x array<double>").repartition(3)


def curved(x):
    return x[:, 0] * x[:, 1] + np.tanh(x[:, 2]) - x[:, 3] * x[:, 0]


def enumerated(x, against):
    """Shapley values over all orders."""
    k, phi = len(x), np.zeros(len(x))
    value = lambda on: curved(np.where(np.isin(np.arange(k), list(on)), x, against)).mean()
    for j in range(k):
        for size in range(k):
            for on in itertools.combinations([i for i in range(k) if i != j], size):
                phi[j] += math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k) * (value({*on, j}) - value(on))
    return phi


def test_sampled_attributions(spark):
    rng = np.random.default_rng(3)
    x, against = rng.normal(size=(12, 4)), rng.normal(size=(10, 4))
    few = {r.id: r for r in A.sampled(frame(spark, x), "id", "x", curved, against, pairs=3).collect()}
    for i, r in few.items():  # efficiency holds for every sample
        assert sum(r.attribution) == pytest.approx(r.prediction - r.base) and r.prediction == pytest.approx(curved(x[i : i + 1])[0])
        assert r.base == pytest.approx(curved(against).mean())
    many = {r.id: r for r in A.sampled(frame(spark, x), "id", "x", curved, against, pairs=400).collect()}
    for i in range(12):
        assert np.allclose(many[i].attribution, enumerated(x[i], against), atol=5 * max(many[i].error) + 1e-9)
        assert max(many[i].error) < max(max(few[i].error), 0.05)


def test_sampled_attributions_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    x, against = rng.normal(size=(9, 4)), rng.normal(size=(4, 4))
    runs = [A.sampled(frame(spark, x).repartition(n), "id", "x", curved, against, pairs=2, seed=s).orderBy("id").collect() for n, s in ((1, 0), (4, 0), (4, 1))]
    assert runs[0] == runs[1] and runs[0] != runs[2]


def test_attributions_of_missing_features_and_empty_tables(spark):
    d = spark.createDataFrame([(1, [1.0, None]), (2, None), (3, [float("nan"), 0.0]), (4, [1.0, 2.0])], "id long, x array<double>")
    got = {r.id: r.attribution for r in A.sampled(d, "id", "x", lambda v: v.sum(1), np.zeros((2, 2)), pairs=1).collect()}
    assert got == {1: None, 2: None, 3: None, 4: [1.0, 2.0]}
    assert A.sampled(d.limit(0), "id", "x", lambda v: v.sum(1), np.zeros((2, 2))).count() == 0
    with pytest.raises(ValueError, match="whole features"):
        A.background(d.where("id < 4"), "id", "x")


def test_linear_attributions_of_three_classes(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(3, size=90)
    x = rng.normal(size=(90, 3)) + np.outer(y, [1, 0, -2])
    d = frame(spark, x, y)
    model = A.fitted_to_all(d, "x", "y", H.lda())
    odds = A.log_odds(model, 1)
    exact = {r.id: r.attribution for r in A.linear(d, "x", model, 1).collect()}
    same = {r.id: r.attribution for r in A.sampled(d, "id", "x", odds, x, pairs=1).collect()}
    for i in range(90):
        assert sum(exact[i]) == pytest.approx(odds(x[i : i + 1])[0] - odds(x.mean(0)[None])[0])
        assert np.allclose(exact[i], same[i])
    assert A.probability(model, 2)(x).shape == (90,) and np.allclose(sum(A.probability(model, c)(x) for c in range(3)), 1)
    with pytest.raises(ValueError, match="not linear"):
        A.linear_weights(A.fitted_to_all(d, "x", "y", H.bayes()), 1)
    with pytest.raises(ValueError, match="two classes"):
        A.fitted_to_all(d.where("y = 1"), "x", "y", H.lda())


def test_ranking_and_long_frame(spark):
    d = spark.createDataFrame([(1, [1.0, 5.0], [0.5, -2.0], [0.3, 0.0]), (2, [3.0, 5.0], [-0.5, 1.0], [0.4, 0.0])], "id long, x array<double>, attribution array<double>, error array<double>")
    got = A.ranking(d, ["a", "b"], np.array([7.0, 8.0]), error="error").orderBy("rank").collect()
    assert [(r.rank, r.feature, r.mean_abs, r.gain, r.error) for r in got] == [(1, "b", 1.5, 8.0, 0.0), (2, "a", 0.5, 7.0, 0.25)]
    long = {(r.id, r.feature): (r.attribution, r.scaled, r.raw) for r in A.long_frame(d, ["id"], "x", ["a", "b"]).collect()}
    assert long == {(1, "a"): (0.5, 0.0, 1.0), (2, "a"): (-0.5, 1.0, 3.0), (1, "b"): (-2.0, 0.5, 5.0), (2, "b"): (1.0, 0.5, 5.0)}


@pytest.mark.parametrize("kind", ["smooth", "ties", "one"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(0)
    v = {"smooth": rng.normal(size=5001), "ties": rng.integers(6, size=5001).astype(float), "one": np.full(300, 2.5)}[kind]
    d = spark.createDataFrame([(float(a), float(-a), None) for a in v] + [(None, float("nan"), None)] * 5, "a double, b double, c double").repartition(4)
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    for held, accuracy in ((10_000, 10_000), (50, 200)):
        got = exact_quantiles(d, ["a", "b", "c"], shares, accuracy, held)
        assert np.allclose(got["a"], np.quantile(v, shares)) and np.allclose(got["b"], np.quantile(-v, shares)) and got["c"] == [None] * 5


def test_causal_fill(spark):
    rows = [(1, 1, None, None), (1, 2, 4.0, 1.0), (1, 3, None, None), (2, 1, None, 2.0), (2, 2, 8.0, None)]
    d = spark.createDataFrame(rows, "series_id long, t int, lvl double, rain double").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.series_id, r.t): (r.lvl, r.rain) for r in W.causal_fill(d, ["lvl"], ["rain"]).collect()}
    assert got == {(1, 1): (6.0, 0.0), (1, 2): (4.0, 1.0), (1, 3): (4.0, 1.0), (2, 1): (6.0, 2.0), (2, 2): (8.0, 2.0)}


def test_components_that_hold_a_share(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)) * [10, 5, 1, 0.5, 0.1]
    d = D.vectors(frame(spark, x), "x")
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    want = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95)) + 1
    got = D.explained(d, 0.95).collect()
    assert len(got) == want and [r.share for r in got] == pytest.approx(list(values[:want] / values.sum()))
    assert len(D.components_holding(d, 0.95).first().pcs) == want


def test_units_that_differ_are_named(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "unit long")
    D.require_same_units(a, a.orderBy("unit"), "unit")
    D.require_same_units(a.limit(0), a.limit(0), "unit")
    with pytest.raises(ValueError, match=r"^3 units differ: None \(1 against 0\), 2 \(2 against 1\), 3 \(0 against 1\)$"):
        D.require_same_units(a, spark.createDataFrame([(1,), (2,), (3,)], "unit long"), "unit")
