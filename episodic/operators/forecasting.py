"""Forecasts of many steps from many channels: linear models out of one Gram matrix, decomposition, boosted anchors, event-aware scores.

A row is an origin: arrays of past values by name, the future as an array, and the fold of time it falls in. Models are
trained on earlier folds only. The sums of products of all inputs are made once per fold; a fold's training sums are
the running total of those before it, and every model takes the rows and columns of its own inputs from that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .heldout import added
from .windows import series


def origins(df: DataFrame, past: list[str], target: str, length: int, horizon: int, stride: int) -> DataFrame:
    """(series_id, origin, one array of the last length values per column of past, future): every stride-th row with both whole."""
    w = series()
    d = df.withColumns({
        "__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy("series_id")),
        "__p": F.collect_list(F.struct(*past)).over(w.rowsBetween(-length, -1)), "__f": F.collect_list(F.struct(target)).over(w.rowsBetween(0, horizon - 1)),
    })
    whole = d.where((F.col("__i") >= length) & (F.col("__i") + horizon <= F.col("__n")) & (F.pmod(F.col("__i") - length, F.lit(stride)) == 0))
    field = lambda rows, c: F.transform(rows, lambda s: s[c].cast("double"))
    return whole.select("series_id", F.col("ts").alias("origin"), *(field("__p", c).alias(c) for c in past), field("__f", target).alias("future"))


def moving_average(values: Column, width: int) -> Column:
    """Centred means of an array, its first and last value repeated beyond its ends."""
    half, n = width // 2, F.size(values)
    padded = F.concat(F.array_repeat(F.element_at(values, 1), half), values, F.array_repeat(F.element_at(values, -1), half))
    total = lambda i: F.aggregate(F.slice(padded, i, width), F.lit(0.0), lambda a, v: a + v)
    return F.transform(F.sequence(F.lit(1), n), lambda i: total(i) / width)


def decomposed(df: DataFrame, column: str, width: int = 25) -> DataFrame:
    """df with trend, the moving average of an array column, and remainder, what it leaves."""
    return df.withColumn("trend", moving_average(F.col(column), width)).withColumn("remainder", F.zip_with(column, "trend", lambda v, t: v - t))


def product_sums(df: DataFrame, blocks: list[str], fold: str) -> DataFrame:
    """(fold, m): products of the inputs of all blocks and a 1 with each other and with the future, added up, flat."""
    kind = dict(df.dtypes)[fold]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[object, np.ndarray] = {}
        for batch in batches:
            for f, part in batch.groupby(fold, sort=False):
                x = np.column_stack([np.stack(part["x"].to_numpy()), np.ones(len(part))])
                m = np.hstack([x.T @ x, x.T @ np.stack(part["future"].to_numpy())]).ravel()
                held[f] = held[f] + m if f in held else m
        if held:
            yield pd.DataFrame({"fold": list(held), "m": list(held.values())})

    parts = df.select(F.col(fold), F.concat(*blocks).alias("x"), "future").mapInPandas(run, f"fold {kind}, m array<double>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    return added(added(parts, ["fold", "salt"]), ["fold"])


def solve(gram: np.ndarray, cross: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge on scaled inputs from raw sums; the last row and column belong to the intercept, which is not penalised."""
    n, mean = gram[-1, -1], gram[:-1, -1] / gram[-1, -1]
    scale = np.sqrt(np.maximum(np.diag(gram)[:-1] / n - mean**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.diag(np.append(1 / scale, 1.0))
    z[-1, :-1] = -mean / scale  # raw inputs to scaled ones
    return z @ np.linalg.solve(z.T @ gram @ z + alpha * np.diag([1.0] * len(mean) + [0.0]), z.T @ cross)


def linear_backtest(df: DataFrame, models: dict[str, list[str]], fold: str = "fold", alpha: float = 10.0) -> DataFrame:
    """Rows of all folds but the first, for each model, with model and forecast: ridge on the model's blocks, from the folds before.

    models: blocks (array columns of one length each in all rows) by model. Sums of a fold take (inputs + 1) * (inputs + 1 +
    steps) numbers, whatever the rows; folds are a bounded set.
    """
    blocks = list(dict.fromkeys(b for used in models.values() for b in used))
    first = df.select(*(F.size(b).alias(b) for b in blocks), F.size("future").alias("__h")).first()
    if first is None:
        return df.withColumns({"model": F.lit("").cast("string"), "forecast": F.array().cast("array<double>")})  # no rows
    ends = dict(zip(blocks, np.cumsum([first[b] for b in blocks]).tolist(), strict=True))
    k = ends[blocks[-1]] + 1
    sums = {r.fold: np.array(r.m).reshape(k, k + first["__h"]) for r in product_sums(df, blocks, fold).toLocalIterator()}
    coefficients: dict[object, dict[str, tuple[np.ndarray, np.ndarray]]] = {}
    total = None
    for f in sorted(sums):
        if total is not None:
            coefficients[f] = {}
            for name, used in models.items():
                at = np.concatenate([np.arange(ends[b] - first[b], ends[b]) for b in used] + [[k - 1]])
                coefficients[f][name] = at, solve(total[np.ix_(at, at)], total[at, k:], alpha)
        total = sums[f] if total is None else total + sums[f]
    shipped = df.sparkSession.sparkContext.broadcast(coefficients)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f, part in batch.groupby(fold, sort=False):
                x = np.column_stack([*(np.stack(part[b].to_numpy()) for b in blocks), np.ones(len(part))])
                for name, (at, w) in shipped.value.get(f, {}).items():
                    yield part.assign(model=name, forecast=list(x[:, at] @ w))

    return df.mapInPandas(run, ", ".join([*(f"{c} {t}" for c, t in df.dtypes), "model string", "forecast array<double>"]))


def between(anchors: list[int], values: Column, steps: int) -> Column:
    """An array of steps values on straight lines between those at the anchors; beyond the outer ones the outer ones."""
    out = []
    for i in range(steps):
        after = next((j for j, a in enumerate(anchors) if a >= i), len(anchors) - 1)
        before = max(after - 1, 0) if anchors[after] > i else after
        share = (i - anchors[before]) / (anchors[after] - anchors[before]) if after != before else 0.0
        out.append(F.get(values, F.lit(before)) * (1 - share) + F.get(values, F.lit(after)) * share)
    return F.array(*out)


def boosted_anchors(train: DataFrame, test: DataFrame, column: str, anchors: list[int], steps: int, last: int = 36, rounds: int = 20) -> DataFrame:
    """test with forecast: trees on the last values and the anchor, trained on one table with a row per origin and anchor; steps between anchors by straight lines."""
    inputs = F.slice(column, -last, last)
    ahead = lambda d, more: d.select(*more, F.posexplode(F.array(*(F.lit(a) for a in anchors))).alias("at", "anchor"), inputs.alias("__x"))
    vector = array_to_vector(F.concat("__x", F.array(F.col("anchor").cast("double"))))
    rows = ahead(train, ["future"]).select(vector.alias("features"), F.get("future", F.col("anchor")).alias("label"))
    model = GBTRegressor(maxIter=rounds, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, seed=0).fit(rows)
    made = model.transform(ahead(test, ["series_id", "origin"]).withColumn("features", vector))
    made = made.groupBy("series_id", "origin").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "prediction"))), lambda p: p.prediction).alias("__a"))
    return test.join(made, ["series_id", "origin"]).withColumn("forecast", between(anchors, F.col("__a"), steps)).drop("__a")


def naive(df: DataFrame, column: str, steps: int) -> DataFrame:
    """df twice, with model and forecast: the last value held, and the last day repeated."""
    day = F.slice(column, -24, 24)
    models = F.array(F.struct(F.lit("persistence").alias("model"), F.array_repeat(F.element_at(column, -1), steps).alias("forecast")), F.struct(F.lit("seasonal").alias("model"), F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.get(day, i % 24)).alias("forecast")))
    return df.select(*df.columns, F.inline(models))


def train_scale(df: DataFrame, column: str, fold: Column, season: int = 24) -> DataFrame:
    """(fold, scale): mean absolute difference of values a season apart, over the rows of earlier folds only."""
    d = df.select("series_id", "ts", fold.alias("fold"), F.abs(F.col(column) - F.lag(column, season).over(series())).alias("d"))
    per = d.groupBy("fold").agg(F.sum("d").alias("s"), F.count("d").alias("n"))  # a row a fold
    before = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("fold", (F.sum("s").over(before) / F.sum("n").over(before)).alias("scale"))


EVENT_SCORES = ["rmse", "event_rmse", "quiescent_rmse", "n_event_windows", "peak_mae", "mae", "mase", "rmse_last"]


def event_scores(df: DataFrame, scale: DataFrame, threshold: float) -> DataFrame:
    """(model, fold, metric, value) of rows (model, fold, future, forecast): eight scores; a window is active if its future passes the threshold anywhere."""
    e = F.zip_with("forecast", "future", lambda p, y: p - y)
    add = lambda f: F.aggregate(e, F.lit(0.0), lambda a, v: a + f(v))
    peak = F.abs(F.array_max("forecast") - F.array_max("future"))
    d = df.select("model", "fold", F.size("future").alias("n"), add(lambda v: v * v).alias("sq"), add(F.abs).alias("ab"), peak.alias("peak"), F.pow(F.element_at(e, -1), 2).alias("last"), (F.array_max("future") > threshold).alias("active"))
    root = lambda on: F.sqrt(F.sum(F.when(on, F.col("sq"))) / F.sum(F.when(on, F.col("n"))))
    g = d.groupBy("model", "fold").agg(
        root(F.lit(True)).alias("rmse"), root(F.col("active")).alias("event_rmse"), root(~F.col("active")).alias("quiescent_rmse"), F.count_if("active").cast("double").alias("n_event_windows"),
        F.avg("peak").alias("peak_mae"), (F.sum("ab") / F.sum("n")).alias("mae"), F.sqrt(F.avg("last")).alias("rmse_last"),
    )
    g = g.join(F.broadcast(scale), "fold", "left").withColumn("mase", F.col("mae") / F.col("scale"))  # a row a fold
    return g.select("model", "fold", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in EVENT_SCORES))))


def over_folds(scored: DataFrame) -> DataFrame:
    """(model, metric, mean, std, folds): over the folds where a score is defined."""
    return scored.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("folds"))
