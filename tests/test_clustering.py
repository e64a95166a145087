"""All runs at once against each run on its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodic.operators import clustering as C


def test_sweep_equals_single_runs(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(40, 3)) + m for m in ([0, 0, 0], [14, 0, 0], [0, 15, 1])])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, [None, 1.0, 2.0])], "id long, x array<double>").repartition(4)
    costs, best = C.sweep(d, "x", [2, 3, 4], 4, 12, 7)
    got = {(r.k, r.start): r.cost for r in costs.collect()}
    whole = d.where("id <> 999").select("x")
    sample = np.array([list(r[0]) for r in whole.orderBy(F.xxhash64(F.lit(7), F.col("x")), "x").collect()])
    assert len(got) == 12
    for k, s in got:
        c = C.starts(sample, k, 7 + s)
        for _ in range(12):
            near = C.distances(x, c).argmin(1)
            c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
        assert got[k, s] == pytest.approx(C.distances(x, c).min(1).sum()), (k, s)
    labels = C.assigned(d.where("id <> 999").withColumn("first", F.get("x", F.lit(0))), "x", best, "first").where("k = 3").collect()
    by = {c: {r.id // 40 for r in labels if r.cluster == c} for c in range(3)}
    assert len(labels) == 120 and by[2] == {1} and all(len(v) == 1 for v in by.values())


def test_sweep_of_nothing(spark):
    d = spark.createDataFrame([(1, [1.0, 1.0])] * 3, "id long, x array<double>")
    costs, best = C.sweep(d, "x", [2], 2, 3)
    assert [r.cost for r in costs.collect()] == [0.0, 0.0] and best[2].shape == (2, 2)
    assert C.sweep(d.limit(0), "x", [2])[0].count() == 0


def test_runs_that_stand_still_take_no_more_steps(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(30, 2)), rng.normal(size=(30, 2)) + 9])
    d = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").coalesce(1)
    seen, step = [], C.step_sums
    monkeypatch.setattr(C, "step_sums", lambda df, c, centres: seen.append((len(centres), df.rdd.getNumPartitions())) or step(df, c, centres))
    C.sweep(d, "x", [2, 5], 3, 25, 1)
    runs = [n for n, _ in seen]
    assert runs[0] == runs[-1] == 6 and min(runs) < 6 and runs[:-1] == sorted(runs[:-1], reverse=True)
    assert {p for _, p in seen} == {4}  # one file's rows are spread


def test_equally_near_centres_and_vectors_without_a_place(spark):
    d = spark.createDataFrame([([0.0, 0.0],), ([2.0, 0.0],)], "x array<double>")
    one, two = np.array([[0.0, 0.0], [2.0, 0.0], [2.0, 0.0]]), np.array([[1.0, 0.0], [1.0, 5.0]])
    sums, cost = C.step_sums(d, "x", [one, two])
    assert sums[0].tolist() == [[1, 0, 0], [1, 2, 0], [0, 0, 0]] and sums[1].tolist() == [[2, 2, 0], [0, 0, 0]] and cost.tolist() == [0, 2]
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [2.0, None]), (4, [2.0, 0.0])], "id long, x array<double>")
    assert {(r.id, r.k, r.cluster) for r in C.assigned(odd, "x", {3: one, 2: two}, "id").collect()} == {(1, 3, 0), (4, 3, 1), (1, 2, 0), (4, 2, 0)}
