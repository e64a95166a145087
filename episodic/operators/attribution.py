"""Attribution of fitted models: exact for linear ones, by sampled orders of the features for any other; ranks and long frames of both."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .heldout import Fit, moments

Predict = Callable[[np.ndarray], np.ndarray]


class Model(NamedTuple):
    """Scores of classes are w @ (x, x * x) + b; mean and sd are those of the features it was fitted to."""

    classes: list
    w: np.ndarray
    b: np.ndarray
    mean: np.ndarray
    sd: np.ndarray


def fitted_to_all(df: DataFrame, x: str, label: str, fit: Fit) -> Model:
    """A model of moments fitted to all rows with a label and whole features; one row a class comes to the driver."""
    rows = moments(df.where(F.col(label).isNotNull()), x, [label]).orderBy(label).collect()
    if len(rows) < 2:
        raise ValueError("fewer than two classes to train on")
    m = np.array([r.m for r in rows])
    k = int(np.sqrt(m.shape[1]))
    n, s, g = m[:, 0], m[:, 1 : k + 1], m[:, k + 1 :].reshape(len(m), k, k)
    mean = s.sum(0) / n.sum()
    sd = np.sqrt(np.maximum(np.diag(g.sum(0)) / n.sum() - mean**2, 0))
    return Model([r[label] for r in rows], *fit(n, s, g), mean, sd)


def _against(model: Model, of) -> np.ndarray:
    """Weights over classes: one against the mean of the others."""
    i = model.classes.index(of)
    return np.where(np.arange(len(model.classes)) == i, 1.0, -1.0 / (len(model.classes) - 1))


def log_odds(model: Model, of) -> Predict:
    """A class's score less the mean of the others'."""
    c = _against(model, of)
    w, b = c @ model.w, c @ model.b
    return lambda x: np.hstack([x, x * x]) @ w + b


def probability(model: Model, of) -> Predict:
    """A class's share in the softmax of the scores."""
    i, w, b = model.classes.index(of), model.w, model.b

    def predict(x: np.ndarray) -> np.ndarray:
        s = np.hstack([x, x * x]) @ w.T + b
        e = np.exp(s - s.max(1, keepdims=True))
        return e[:, i] / e.sum(1)

    return predict


def linear_weights(model: Model, of) -> np.ndarray:
    """A linear model's weight of each feature for a class against the mean of the others."""
    k = len(model.mean)
    if np.any(model.w[:, k:]):
        raise ValueError("the model is not linear")
    return _against(model, of) @ model.w[:, :k]


def linear(df: DataFrame, x: str, model: Model, of, name: str = "attribution") -> DataFrame:
    """df with each feature's weight times its distance from the mean; null where a feature is. They add up to the log odds less those of the mean."""
    w = linear_weights(model, of)
    each = F.zip_with(F.col(x).cast("array<double>"), _array(model.mean), lambda v, m: v - m)
    return df.withColumn(name, F.zip_with(each, _array(w), lambda d, a: d * a))


def _array(v: np.ndarray) -> Column:
    return F.array(*(F.lit(float(a)) for a in v))


def background(df: DataFrame, key: str, x: str, rows: int = 64) -> np.ndarray:
    """Features of a bounded sample: the rows with whole features that come first by a hash of their key."""
    v = F.col(x).cast("array<double>")
    whole = df.select(F.col(key).alias("key"), v.alias("x")).where(F.forall("x", lambda a: a.isNotNull() & ~F.isnan(a)))
    first = whole.orderBy(F.md5(F.col("key").cast("string")), "key").limit(rows).collect()
    if not first:
        raise ValueError("no row with whole features")
    return np.array([r.x for r in first])


def sampled(df: DataFrame, key: str, x: str, predict: Predict, against: np.ndarray, pairs: int = 16, seed: int = 0) -> DataFrame:
    """df with prediction, base, and attribution and error per feature: sampled Shapley values of any model.

    Features are set from a background row to the row's own in an order and its reverse (antithetic), for some seeded pairs
    of orders a row and every background row; a feature's gains are averaged. Attributions add up to prediction less base
    (the background's mean prediction) for every sample; error is the standard error over pairs, null for one pair. Orders
    depend on the key alone. Rows are scored where they stand, in coalitions of one row at a time: pairs * 2 * (k + 1) *
    background rows of k doubles. A row with a null or NaN feature has nulls.
    """
    against = np.asarray(against, float)
    k = against.shape[1]
    base = float(np.mean(predict(against)))

    def one(v: np.ndarray, start: int) -> tuple[float, np.ndarray, np.ndarray | None]:
        rng = np.random.default_rng([seed, start & 0xFFFFFFFF, (start >> 32) & 0xFFFFFFFF])
        half = np.argsort(rng.random((pairs, k)), axis=1)
        orders = np.stack([half, half[:, ::-1]], 1).reshape(2 * pairs, k)
        places = np.argsort(orders, axis=1)  # the place of each feature in its order
        own = places[:, None, :] < np.arange(k + 1)[None, :, None]
        mixed = np.where(own[:, :, None, :], v, against[None, None])
        values = predict(mixed.reshape(-1, k)).reshape(2 * pairs, k + 1, len(against)).mean(2)
        gains = np.take_along_axis(np.diff(values, axis=1), places, axis=1).reshape(pairs, 2, k).mean(1)
        return float(values[0, -1]), gains.mean(0), gains.std(0, ddof=1) / np.sqrt(pairs) if pairs > 1 else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for v, start in zip(batch["__x"], batch["__s"], strict=True):
                v = None if v is None else np.array(v, float)
                found.append((None, None, None) if v is None or np.isnan(v).any() else one(v, int(start)))
            out = batch.drop(columns=["__x", "__s"])
            yield out.assign(prediction=[f[0] for f in found], base=base, attribution=[f[1] for f in found], error=[f[2] for f in found])

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    ready = df.withColumns({"__x": F.col(x).cast("array<double>"), "__s": F.xxhash64(F.col(key))})
    return ready.mapInPandas(run, f"{kinds}, prediction double, base double, attribution array<double>, error array<double>")


def long_frame(df: DataFrame, keys: list[str], x: str, names: list[str], name: str = "attribution") -> DataFrame:
    """(keys, feature, attribution, scaled, raw): a row a feature, its value as it is and from 0 to 1 between the feature's least and largest (0.5 if these are equal)."""
    feature = F.get(F.array(*(F.lit(n) for n in names)), F.col("__i"))
    d = df.select(*keys, F.col(name).alias("__a"), F.posexplode(F.col(x).cast("array<double>")).alias("__i", "raw"))
    d = d.select(*keys, feature.alias("feature"), F.get("__a", F.col("__i")).alias("attribution"), "raw")
    ends = d.groupBy("feature").agg(F.min("raw").alias("__lo"), F.max("raw").alias("__hi"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col("raw") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).when(F.col("raw").isNotNull(), 0.5)
    return d.join(F.broadcast(ends), "feature").select(*keys, "feature", "attribution", scaled.alias("scaled"), "raw")  # a row a feature


def ranking(df: DataFrame, names: list[str], gains: np.ndarray, name: str = "attribution", error: str | None = None) -> DataFrame:
    """(rank, feature, mean_abs, gain, error): features by mean absolute attribution, equal ones by name, beside a gain of the model's own; error is the mean's standard error from that of the rows."""
    e = F.col(error) if error else F.transform(name, lambda v: F.lit(None).cast("double"))
    d = df.where(F.col(name).isNotNull()).select(F.posexplode(F.zip_with(name, e, lambda a, b: F.struct(F.abs(a).alias("a"), b.alias("e")))).alias("i", "v"))
    g = d.groupBy("i").agg(F.avg("v.a").alias("mean_abs"), (F.sqrt(F.sum(F.col("v.e") ** 2)) / F.count(F.lit(1))).alias("error"))
    g = g.select(F.get(F.array(*(F.lit(n) for n in names)), F.col("i")).alias("feature"), "mean_abs", F.get(_array(gains), F.col("i")).alias("gain"), "error")
    top = g.agg(F.sort_array(F.collect_list(F.struct((-F.col("mean_abs")).alias("o"), "feature", "mean_abs", "gain", "error"))).alias("r"))  # a row a feature
    return top.select(F.posexplode("r").alias("p", "r")).select((F.col("p") + 1).cast("long").alias("rank"), "r.feature", "r.mean_abs", "r.gain", "r.error")
