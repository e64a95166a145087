"""Kernel columns into heads: projection, known answer, attribution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodic.operators import heldout as H
from episodic.operators import rocket as R


def sequences(spark, n=120, steps=32, seed=4):
    """A bump in channel 1 makes class 1, whatever channel 0 does; five folds."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(size=(2, steps)) * 0.3
        x[0] += 3 * np.sin(np.arange(steps) / 3 + rng.uniform(0, 6))
        y = i % 2
        if y:
            at = rng.integers(4, steps - 8)
            x[1, at : at + 5] += [1, 3, 4, 3, 1]
        rows.append((i, y, i % 5, x.tolist()))
    return rows, spark.createDataFrame(rows, "id long, y long, fold long, seq array<array<double>>").repartition(3)


def test_projection_equals_the_whole_matrix(spark, monkeypatch):
    rows, d = sequences(spark, 40)
    kernels = R.bank(700, 2, 32, 1)  # more than a block
    z = R.columns(np.array([r[3] for r in rows]), kernels)
    fold = np.array([r[2] for r in rows])
    w = np.vstack([R.directions(b, min(2 * R.BLOCK, 1400 - b), 8, 5) for b in range(0, 1400, 2 * R.BLOCK)])
    got = {(r.id, r.run): r.x for r in R.projected(d, kernels, "seq", "fold", 8, 5).collect()}
    assert len(got) == 200
    for f in range(5):
        mean, sd = z[fold != f].mean(0), z[fold != f].std(0)
        want = (z - mean) / np.where(sd > 1e-9, sd, 1) @ w
        assert np.allclose([got[i, f] for i in range(40)], want, atol=1e-6)


def test_known_answer(spark):
    _, d = sequences(spark)
    rows = R.projected(d, R.bank(400, 2, 32), "seq", "fold", 48)
    p = R.heads(rows, "y", "fold", {"lda": H.components(0.95, H.lda()), "ridge": H.components(0.95, H.ridge())})
    assert p.count() == 240 and p.where("run <> fold").count() == 0
    f1 = {r.model: r.value for r in H.scores(p, "y", ["model"]).where("metric = 'macro_f1'").collect()}
    assert min(f1.values()) > 0.95, f1


def test_attribution_points_at_the_channel_and_adds_up(spark):
    rows, d = sequences(spark)
    kernels = R.bank(300, 2, 32)
    mean, weights = R.head_weights(d, kernels, "seq", "y", 48)
    z = R.columns(np.array([r[3] for r in rows]), kernels)
    assert np.allclose(mean, z.mean(0))
    found = R.importance(d, kernels, "seq", mean, weights)
    total = np.abs((z - z.mean(0)) * weights).mean(0)
    assert found.count() == 600 and found.agg(F.sum("importance")).first()[0] == pytest.approx(total.sum())
    told = R.described(spark, kernels)
    channel = {r.channel: r.importance for r in R.by_tag(found, told, ["channel"]).collect()}
    assert channel[1] > channel[0] and sum(channel.values()) == pytest.approx(total.sum())
    assert R.by_tag(found, told, ["dilation", "pool"]).agg(F.sum("importance")).first()[0] == pytest.approx(total.sum())
    assert R.by_step(found, told, 32).agg(F.sum("importance")).first()[0] == pytest.approx(total.sum())


def test_steps_of_three_kernels(spark):
    kernels = [{"channel": 0, "length": 3, "dilation": 1, "padding": 0}, {"channel": 1, "length": 3, "dilation": 2, "padding": 2}, {"channel": 1, "length": 3, "dilation": 2, "padding": 0}]
    found = spark.createDataFrame([(0, "max", 6.0), (1, "max", 1.0), (1, "ppv", 2.0), (2, "ppv", 4.0)], "kernel long, pool string, importance double")
    got = {(r.channel, r.step): r.importance for r in R.by_step(found, R.described(spark, kernels), 5).collect()}
    want = {(0, s): 6 * n / 9 for s, n in enumerate([1, 2, 3, 2, 1])}
    padded = [2, 2, 3, 2, 2]  # windows from -2 to 2 that cover each step
    alone = [1, 0, 1, 0, 1]
    want |= {(1, s): 3 * padded[s] / 11 + 4 * alone[s] / 3 for s in range(5)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
