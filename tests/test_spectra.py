import numpy as np
import pytest
from pyspark.sql import functions as F

from episodic.operators import spectra as P


@pytest.mark.parametrize("group", [4, P.GROUP])
def test_transform_in_groups_equals_the_whole_one(spark, group, monkeypatch):
    monkeypatch.setattr(P, "GROUP", group)
    rng = np.random.default_rng(1)
    x = {"a": rng.normal(size=64), "b": np.append(rng.normal(size=9), 0.0)}
    rows = [(c, m, i, float(v), 0.0) for c, m in (("a", 64), ("b", 16)) for i, v in enumerate(x[c])]
    got = P.fourier(spark.createDataFrame(rows, "c string, m long, n long, re double, im double"), ["c"]).toPandas()
    for c, m in (("a", 64), ("b", 16)):
        own = got[got.c == c].sort_values("k")
        assert np.allclose(own.re + 1j * own.im, np.fft.fft(x[c], m)) and own.k.tolist() == list(range(m))


def test_power_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 64)
    rng = np.random.default_rng(2)
    x = {("p", 97): rng.normal(size=97), ("q", 97): rng.normal(size=97), ("r", 60): rng.normal(size=60), ("s", 2): np.array([1.0, -1.0]), ("t", 1): np.array([3.0])}
    rows = [(c, i, n, None if v is None else float(v)) for (c, n), values in x.items() for i, v in enumerate(values)]
    got = P.power_spectrum(spark.createDataFrame(rows, "c string, i long, n long, v double"), "i", "v", "n", ["c"]).toPandas()
    for (c, n), values in x.items():
        own = got[got.c == c].sort_values("k")
        assert np.allclose(own.power, np.abs(np.fft.rfft(values)[1 : n // 2 + 1]) ** 2) and own.k.tolist() == list(range(1, n // 2 + 1))


def test_periodogram_finds_a_day_and_leaves_a_constant(spark):
    d = spark.range(24 * 30 + 5).select(F.lit(1).cast("long").alias("series_id"), (F.timestamp_seconds(F.col("id") * 3600)).cast("timestamp_ntz").alias("ts"), F.sin(2 * F.pi() * F.col("id") / 24).alias("x"), F.lit(2.0).alias("flat"))
    got = P.periodogram(d, ["x", "flat"], 24).toPandas()
    x = got[got.variable == "x"]
    assert abs(x.loc[x.power.idxmax(), "freq"] - 1) < 0.02 and x.power.max() == 1
    assert got[got.variable == "flat"].power.isna().all()
    assert P.periodogram(d.limit(0), ["x"], 24).count() == 0
