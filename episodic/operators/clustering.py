"""Clusterings for many numbers of clusters and starts at once: one pass a step moves the centres of all runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .heldout import added

#: Rows that starts are chosen from: those first by a seeded hash of their values.
SAMPLE = 2_000


def starts(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of a sample, each likelier the farther it is from those before it."""
    rng = np.random.default_rng([seed, k])
    chosen = [sample[rng.integers(len(sample))]]
    far = np.full(len(sample), np.inf)
    while len(chosen) < k:
        far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(1))
        chosen.append(sample[rng.choice(len(sample), p=far / far.sum())] if far.sum() > 0 else sample[rng.integers(len(sample))])
    return np.array(chosen)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0)


def vectors(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays without nulls as a matrix, a row each."""
    if not pc.all(pc.equal(pc.list_value_length(column), width), min_count=0).as_py():
        raise ValueError(f"not all vectors have {width} values")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def step_sums(df: DataFrame, x: str, centres: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each run the count and sum of the rows nearest to each centre, side by side, and its cost.

    Runs with equally many centres that stand together are looked at together: a matrix of 0 and 1 says which centre is
    a row's nearest, and its product with the rows is the sums.
    """
    flat, sizes = np.vstack(centres), [len(c) for c in centres]
    shipped = df.sparkSession.sparkContext.broadcast((flat, sizes))
    width = flat.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, sizes_ = shipped.value
        groups, start = [], 0  # (first run, runs, centres of a run, first centre)
        for k, same in groupby(enumerate(sizes_), key=lambda r: r[1]):
            first, n = (runs := [r for r, _ in same])[0], len(runs)
            groups.append((first, n, k, start))
            start += n * k
        squares = (all_**2).sum(1)[:, None]
        sums, cost = np.zeros((len(all_), width)), np.zeros(len(sizes_))
        for batch in batches:
            rows = vectors(batch.column(0), width - 1)
            for i in range(0, len(rows), 500):
                v = rows[i : i + 500]
                d, hot = np.maximum((v**2).sum(1) - 2 * (all_ @ v.T) + squares, 0), np.empty((len(all_), len(v)))
                for first, n, k, at in groups:
                    each = d[at : at + n * k].reshape(n, k, -1)
                    low = each.min(1)
                    cost[first : first + n] += low.sum(1)
                    near = each == low[:, None]
                    if np.count_nonzero(near) != low.size:  # the first of equally near ones
                        near = np.arange(k)[:, None] == each.argmin(1)[:, None]
                    hot[at : at + n * k] = near.reshape(n * k, -1)
                sums += hot @ np.column_stack([np.ones(len(v)), v])
        yield pa.RecordBatch.from_pydict({"m": pa.array([np.concatenate([sums.ravel(), cost])], pa.list_(pa.float64()))})

    parts = df.select(F.col(x).cast("array<double>").alias("x")).mapInArrow(run, "m array<double>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    m = np.array(added(added(parts, ["salt"]).withColumn("salt", F.lit(0)), ["salt"]).first()["m"])  # as many numbers as the centres have
    shipped.destroy()
    sums = m[: len(flat) * width].reshape(-1, width)
    return np.split(sums, np.cumsum(sizes)[:-1]), m[len(flat) * width :]


def sweep(df: DataFrame, x: str, ks: list[int], n_starts: int = 20, iterations: int = 25, seed: int = 0) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(k, start, cost) of all runs, and the centres of the cheapest run of each k.

    Runs start from a sample of at most SAMPLE rows and move over all rows, each until its centres don't move or so many steps
    are done. A centre without rows stays. Rows with a null among their values are left out; no rows give no runs.
    """
    context = df.sparkSession.sparkContext
    whole = df.where(F.forall(x, lambda v: v.isNotNull())).select(x)
    order = F.xxhash64(F.lit(seed), F.col(x))
    sample = np.array([list(r[0]) for r in whole.orderBy(order, x).limit(SAMPLE).collect()], float)
    schema = "k long, start long, cost double"
    if not len(sample):
        return df.sparkSession.createDataFrame([], schema), {}
    spread = max(context.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = whole.repartition(spread).persist()  # read by every step; a small file would be one task
    runs = [(k, s) for k in ks for s in range(n_starts)]
    centres = [starts(sample, k, seed + s) for k, s in runs]
    moving = list(range(len(runs)))
    for _ in range(iterations):
        sums, _ = step_sums(whole, x, [centres[r] for r in moving])
        moved = {r: np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1), centres[r]) for r, s in zip(moving, sums, strict=True)}
        moving = [r for r in moving if not np.allclose(moved[r], centres[r], rtol=0, atol=1e-9)]
        for r, c in moved.items():
            centres[r] = c
        if not moving:
            break
    _, cost = step_sums(whole, x, centres)
    whole.unpersist()
    best = {k: centres[min((i for i, r in enumerate(runs) if r[0] == k), key=lambda i: (cost[i], i))] for k in ks}
    return df.sparkSession.createDataFrame([(k, s, float(c)) for (k, s), c in zip(runs, cost, strict=True)], schema), best


def assigned(df: DataFrame, x: str, best: dict[int, np.ndarray], rank_by: str) -> DataFrame:
    """df for each k: k and cluster, numbered from 0 by the median of a column among its rows. Rows with a null among their values are left out."""
    whole = F.when(F.forall(x, lambda v: v.isNotNull()), F.col(x).cast("array<double>"))
    d = df.select(*df.columns, F.posexplode(_nearest(list(best.values()))(whole)).alias("k", "raw"))
    d = d.withColumn("k", F.get(F.array(*(F.lit(k).cast("long") for k in best)), F.col("k")))
    rank = d.groupBy("k", "raw").agg(F.percentile_approx(rank_by, 0.5, 100_000).alias("m")).withColumn("cluster", (F.row_number().over(Window.partitionBy("k").orderBy("m", "raw")) - 1).cast("long"))
    return d.join(F.broadcast(rank.select("k", "raw", "cluster")), ["k", "raw"]).drop("raw")  # a row a cluster


def composition(df: DataFrame, keys: list[str], cls: str) -> DataFrame:
    """(keys, class, n, share): how many rows of each class a cluster has, and their share of it; a null class is one of its own."""
    n = df.groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))  # a row a class


def _nearest(runs: list[np.ndarray]) -> Callable[[Column], Column]:
    """For each run the place of the first of its nearest centres; null for a null or a vector of another length."""

    @F.arrow_udf("array<int>")
    def near(column: pa.Array) -> pa.Array:
        width = runs[0].shape[1]
        fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
        rows = vectors(column.filter(fits), width).T
        found = []
        for c in runs:
            d = np.zeros((rows.shape[1], len(c)))
            for j in range(width):  # added up in order, so that it is the same on every machine
                d += (rows[j][:, None] - c[:, j]) ** 2
            found.append(np.where(np.isnan(d), np.inf, d).argmin(1))
        ends = np.concatenate([[0], np.cumsum(fits.to_numpy(zero_copy_only=False)) * len(runs)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(found, np.int32).T.ravel()), mask=pc.invert(fits))

    return near
