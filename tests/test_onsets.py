"""Early warning against loops over hours."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodic.operators import heldout as H
from episodic.operators import onsets as O

START = dt.datetime(2024, 1, 1)
CHANNELS = {"event": "event", "threshold": 1.0, "level": "level_m", "salinity": "salt", "rain": "rain"}


def series(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    level = 3 * np.sin(2 * np.pi * t / 12.4206) + rng.normal(size=n) * 0.3
    event = np.where(level + rng.normal(size=n) > 3.2, 2.0, 0.5)
    salt, rain = np.cos(2 * np.pi * t / 24) + rng.normal(size=n) * 0.1, rng.exponential(size=n)
    rows = [(1, START + dt.timedelta(hours=int(i)), *(float(v[i]) for v in (event, level, salt, rain)), int(i // 200)) for i in t]
    d = spark.createDataFrame(rows, "series_id long, ts timestamp_ntz, event double, level_m double, salt double, rain double, part long")
    return d, event, level, salt, rain


def test_origins_look_back_and_labels_look_ahead(spark):
    d, event, level, salt, rain = series(spark)
    got = O.origins(d, **CHANNELS, first=100, stride=7, leads=(6, 48)).orderBy("ts").collect()
    at = list(range(100, 600, 7))
    assert [r.ts for r in got] == [START + dt.timedelta(hours=i) for i in at]
    for r, i in zip(got, at, strict=True):
        assert [r.level, r.level_rise_6h, r.level_rise_24h] == pytest.approx([level[i - 1], level[i - 1] - level[i - 7], level[i - 1] - level[i - 25]])
        assert [r.salinity, r.salinity_rise_6h] == pytest.approx([salt[i - 1], salt[i - 1] - salt[i - 7]])
        assert [r.rain_24h, r.rain_72h] == pytest.approx([rain[i - 24 : i].sum(), rain[i - 72 : i].sum()])
        for h in (6, 48):
            assert r[f"onset_{h}"] == int(event[i - 1] <= 1 and event[i : i + h].max() > 1)


def test_tides_are_fitted_to_training_rows_only(spark):
    d, *_ = series(spark)
    spoiled = d.withColumn("level_m", F.when(F.col("part") == 2, 1e6).otherwise(F.col("level_m")))
    a, b = (O.with_tides(x, "level_m", "salt", F.col("part") < 2, (6,)).orderBy("ts").select("ahead_6").collect() for x in (d, spoiled))
    assert np.allclose([r.ahead_6 for r in a[1:]], [r.ahead_6 for r in b[1:]])
    assert a[0].ahead_6[1] is None


def area(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_lead_times_equal_a_loop(spark):
    d, *_ = series(spark)
    got = {(r.lead_h, r.features): r for r in O.lead_times(d, "part", [1, 2], **CHANNELS, models={"lda": H.lda()}, leads=(6, 12), first=100, stride=3).collect()}
    assert set(got) == {(h, s) for h in (6, 12) for s in ("past only", "with tides")}
    for lead in (6, 12):
        found = {"past only": [], "with tides": []}
        for test in (1, 2):
            rows = O.origins(O.with_tides(d, "level_m", "salt", F.col("part") < test, (lead,)), **CHANNELS, first=100, stride=3, leads=(lead,)).orderBy("ts").collect()
            y, part = np.array([r[f"onset_{lead}"] for r in rows]), np.array([r.part for r in rows])
            for name in found:
                x = np.array([[r[c] for c in O.PAST] + (list(r[f"ahead_{lead}"]) if name != "past only" else []) for r in rows], float)
                train, held = part < test, part == test
                n = np.array([(y[train] == c).sum() for c in (0, 1)], float)
                s = np.array([x[train & (y == c)].sum(0) for c in (0, 1)])
                g = np.array([x[train & (y == c)].T @ x[train & (y == c)] for c in (0, 1)])
                w, b = H.lda()(n, s, g)
                scores = x[held] @ w[:, : x.shape[1]].T + b
                found[name].append(area(y[held], scores[:, 1] - scores[:, 0]))
        for name, areas in found.items():
            r = got[lead, name]
            assert r.folds == 2 and r.auc == pytest.approx(np.mean(areas), abs=1e-6) and r.auc_sd == pytest.approx(np.std(areas), abs=1e-6)


def test_too_few_onsets_give_no_score(spark):
    d, *_ = series(spark)
    got = O.lead_times(d.withColumn("event", F.lit(0.0)), "part", [2], **CHANNELS, models={"lda": H.lda()}, leads=(6,), first=100).collect()
    assert [(r.lead_h, r.auc, r.ap, r.folds, r.n_onsets) for r in got] == [(6, None, None, 0, 0)] * 2
