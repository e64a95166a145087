"""Nearest-neighbour information against all distances."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodic.operators import information as I


def digamma(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, n))


def by_hand(x, y, k):
    keep = [i for i in range(len(x)) if x[i] is not None and y[i] is not None and not math.isnan(x[i])]
    keep = [i for i in keep if sum(y[j] == y[i] for j in keep) > 1]
    x, y = np.array([x[i] for i in keep]), np.array([y[i] for i in keep])
    parts = []
    for i in range(len(x)):
        same = np.flatnonzero(y == y[i])
        ki = min(k, len(same) - 1)
        r = np.sort(np.abs(x[same[same != i]] - x[i]))[ki - 1]
        m = (x == x[i]).sum() if r == 0 else ((x > x[i] - r) & (x < x[i] + r)).sum()
        parts.append(digamma(ki) - digamma(len(same)) - digamma(int(m)))
    return len(x), max(0.0, digamma(len(x)) + float(np.mean(parts)))


@pytest.mark.parametrize(("k", "slices"), [(3, 8), (5, 40), (1, 1)])
def test_equals_all_distances(spark, k, slices):
    rng = np.random.default_rng(k)
    n = 300
    y = [["a", "b", "c", None][i] for i in rng.choice(4, n, p=[0.5, 0.3, 0.15, 0.05])] + ["alone", "b"]
    shift = {"a": 0.0, "b": 1.5, "c": -2.0, None: 0.0, "alone": 9.0}
    smooth = [float(rng.normal() + shift[c]) for c in y]
    grid = [float(round(v * 2) / 2) if i % 3 else 0.5 for i, v in enumerate(smooth)]  # a third of the rows on one value
    noise = [None if i % 17 == 0 else float("nan") if i % 19 == 0 else float(rng.uniform()) for i in range(len(y))]
    d = spark.createDataFrame(list(zip(y, smooth, grid, noise)), "y string, smooth double, grid double, noise double").repartition(4)
    got = {r.feature: r for r in I.neighbour_information(d, ["smooth", "grid", "noise"], "y", k, slices).collect()}
    for name, x in (("smooth", smooth), ("grid", grid), ("noise", noise)):
        size, value = by_hand(x, y, k)
        assert got[name].n == size and got[name].information == pytest.approx(value, abs=1e-9), name
    assert got["smooth"].information > got["noise"].information + 0.2


def test_no_point_meets_all_others(spark):
    d = spark.createDataFrame([("a", 1.0)], "y string, x double")
    plan = I.neighbour_information(d, ["x"], "y")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert I.neighbour_information(d, ["x"], "y").count() == 0 and I.neighbour_information(d.limit(0), ["x"], "y").count() == 0


def test_psi(spark):
    got = [r.p for r in spark.range(1, 60).select(I.psi(F.col("id")).alias("p"), "id").orderBy("id").collect()]
    assert np.allclose(got, [digamma(n) for n in range(1, 60)], atol=1e-11)


def shuffles(spark):
    """Rows written to shuffles, by stage."""
    context = spark.sparkContext
    store, none = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0)
    stages = store.stageList(context._jvm.java.util.ArrayList(), False, False, none, context._jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_rows_are_read_three_times_and_shuffled_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    n = 5_003  # all values differ
    d = spark.range(n).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("y"), (F.col("id") * 7919 % n).cast("double").alias("x"))
    d = d.mapInArrow(count, "y string, x double")
    last = max(shuffles(spark), default=-1)
    assert I.neighbour_information(d, ["x"], "y").first().n == n
    assert read.value <= 3 * n
    assert 2 * n < sum(rows for stage, rows in shuffles(spark).items() if stage > last) < 2.5 * n


def test_slices_grow_with_the_rows_and_settle_most_points(spark, monkeypatch):
    rng = np.random.default_rng(11)
    y = ["a"] * 900 + ["b"] * 700 + ["rare"] * 3 + ["two"] * 2 + [f"alone{i}" for i in range(40)]
    x = [float(v) for v in np.concatenate([rng.normal(size=900), rng.normal(1, 2, size=700), [-50, 0.1, 60], [-4.0, 4.0], rng.normal(size=40)])]
    for i in range(0, 600, 3):
        x[i] = 0.25  # more rows on one value than a slice is meant to hold
    shown = [v if i % 5 else None for i, v in enumerate(x)]
    cuts, asked, cut, near = [], [], I.cut_points, I.neighbours
    monkeypatch.setattr(I, "SLICE", 100)
    monkeypatch.setattr(I, "FEW", 10)  # so that classes of one row are taken out by a shuffle
    monkeypatch.setattr(I, "cut_points", lambda *a: cuts.extend(cut(*a)) or cuts)
    monkeypatch.setattr(I, "neighbours", lambda ends, *a: asked.append(ends.where("asked").count()) or near(ends, *a))
    order = rng.permutation(len(x)).tolist()
    d = spark.createDataFrame([(y[i], x[i], shown[i]) for i in order], "y string, x double, shown double").repartition(3)
    got = {r.feature: r for r in I.neighbour_information(d, ["x", "shown"], "y").collect()}
    for name, values in (("x", x), ("shown", shown)):
        size, value = by_hand(values, y, 3)
        assert got[name].n == size and got[name].information == pytest.approx(value, abs=1e-9), name
    assert 12 <= len(cuts[0]) <= 16 and 9 <= len(cuts[1]) <= 13
    assert asked[0] <= 2 * 3 * 2 * sum(len(c) + 1 for c in cuts) + 10
