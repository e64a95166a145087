"""Random convolution kernels over fixed-length sequences: bank, transform, channel scaling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .heldout import Fit, added, fitted, predictions, ridge
from .heldout import moments as moments_of

def bank(n: int, channels: int, steps: int, seed: int = 0) -> list[dict]:
    """n kernels: a channel, a length of 7, 9 or 11, a dilation of a random power of two that fits, padding or not, centred normal weights, a bias in -1..1."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        length = int(rng.choice([7, 9, 11]))
        dilation = 2 ** int(rng.integers(1 + max(int(np.log2((steps - 1) / (length - 1))), 0)))
        w = rng.normal(size=length)
        out.append({"channel": int(rng.integers(channels)), "length": length, "dilation": dilation, "padding": (length - 1) * dilation // 2 if rng.random() < 0.5 else 0, "weights": (w - w.mean()).tolist(), "bias": float(rng.uniform(-1, 1))})
    return out


def described(spark: SparkSession, kernels: list[dict]) -> DataFrame:
    """(kernel, channel, length, dilation, padding) of a bank, one row a kernel."""
    rows = [(i, *(k[c] for c in ("channel", "length", "dilation", "padding"))) for i, k in enumerate(kernels)]
    return spark.createDataFrame(rows, "kernel long, channel long, length long, dilation long, padding long")


def convolve(x: np.ndarray, kernel: dict) -> np.ndarray:
    """Rows of x (units by steps) with a kernel slid over them, not flipped."""
    p, d, w = kernel["padding"], kernel["dilation"], kernel["weights"]
    x = np.pad(np.nan_to_num(x), ((0, 0), (p, p)))
    out = x.shape[1] - (len(w) - 1) * d
    return sum(c * x[:, i * d : i * d + out] for i, c in enumerate(w)) + kernel["bias"]


def transform(df: DataFrame, kernels: list[dict], key: str, sequence: str) -> DataFrame:
    """(key, rocket) of df(key, sequence: array of channels of arrays): the maximum and the share above 0 of each kernel, in turn. Units are independent; the bank goes to every task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([[np.asarray(c, float) for c in s] for s in batch[sequence]])
            cols = []
            for k in kernels if len(batch) else []:
                y = convolve(x[:, k["channel"], :], k)
                cols += [y.max(1), (y > 0).mean(1)]
            yield pd.DataFrame({key: batch[key], "rocket": list(np.array(cols).T) if cols else []})

    return df.select(key, sequence).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, rocket array<double>")


def scale_channels(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """Sequences with every channel's mean and population deviation over all units taken out; NaN and null become 0."""
    long = df.select(key, F.posexplode(sequence).alias("channel", "v")).select(key, "channel", F.explode("v").alias("x"))
    s = long.where(~F.isnan("x")).groupBy("channel").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = s.agg(F.sort_array(F.collect_list(F.struct("channel", "m", "s"))).alias("st"))
    scaled = F.transform(sequence, lambda v, i: F.transform(v, lambda x: F.coalesce(F.nanvl((x - F.get("st", i).m) / F.when(F.get("st", i).s > 0, F.get("st", i).s), F.lit(0.0)), F.lit(0.0))))
    return df.crossJoin(F.broadcast(stats)).withColumn(sequence, scaled).drop("st")  # one row, an entry a channel


#: Kernels whose two columns each a task computes at a time, and units at a time.
BLOCK, UNITS = 500, 1_000


def columns(x: np.ndarray, kernels: list[dict]) -> np.ndarray:
    """Maximum and share above 0 of each kernel, in turn, for units x (units, channels, steps)."""
    out = np.empty((len(x), 2 * len(kernels)))
    for i, k in enumerate(kernels):
        y = convolve(x[:, k["channel"], :], k)
        out[:, 2 * i], out[:, 2 * i + 1] = y.max(1), (y > 0).mean(1)
    return out


def blocks(batches: Iterator[pd.DataFrame], sequence: str, kernels: list[dict]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, np.ndarray]]]]:
    """Some units at a time, with an iterator over their columns, some kernels at a time: a task never holds all columns."""
    for batch in batches:
        for i in range(0, len(batch), UNITS):
            part = batch.iloc[i : i + UNITS]
            x = np.array([[np.asarray(c, float) for c in s] for s in part[sequence]])
            yield part, ((2 * b, columns(x, kernels[b : b + BLOCK])) for b in range(0, len(kernels), BLOCK))


def column_moments(df: DataFrame, kernels: list[dict], sequence: str, fold: str) -> DataFrame:
    """(fold, block, m): count, sums and sums of squares of the columns from each block on, over the units of each fold."""
    kind = dict(df.dtypes)[fold]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for part, made in blocks(batches, sequence, kernels):
            for start, z in made:
                for f in part[fold].unique():
                    own = z[(part[fold] == f).to_numpy()]
                    m = np.concatenate([[len(own)], own.sum(0), (own**2).sum(0)])
                    held[f, start] = held[f, start] + m if (f, start) in held else m
        if held:
            yield pd.DataFrame([(f, b, m) for (f, b), m in held.items()], columns=["fold", "block", "m"])

    parts = df.select(fold, sequence).mapInPandas(run, f"fold {kind}, block int, m array<double>")
    parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    return added(added(parts, ["fold", "block", "salt"]), ["fold", "block"])


def scales(moments: DataFrame, n_columns: int) -> dict[object, tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of every column over the units outside each fold: two vectors a fold, whatever the units."""
    own: dict[object, dict[int, np.ndarray]] = {}
    for r in moments.toLocalIterator():
        own.setdefault(r.fold, {})[r.block] = np.array(r.m)
    out = {}
    for f in own:
        mean, sd = np.zeros(n_columns), np.ones(n_columns)
        for b in own[f]:
            m = sum((x[b] for g, x in own.items() if g != f), np.zeros_like(own[f][b]))
            k, n = len(m) // 2, max(m[0], 1)
            mean[b : b + k] = m[1 : k + 1] / n
            dev = np.sqrt(np.maximum(m[k + 1 :] / n - mean[b : b + k] ** 2, 0))
            sd[b : b + k] = np.where(dev > 1e-9, dev, 1.0)
        out[f] = mean, sd
    return out


def directions(start: int, n: int, width: int, seed: int) -> np.ndarray:
    """The random projection's rows of n columns from start on; made where they are used, from the seed."""
    return np.random.default_rng([seed, start]).normal(size=(n, width)) / np.sqrt(width)


def projected(df: DataFrame, kernels: list[dict], sequence: str, fold: str, width: int = 64, seed: int = 0) -> DataFrame:
    """df without the sequence, for each fold as run: x, the unit's columns, scaled by the units outside that fold and projected at random to width.

    Folds are a bounded set; their scales (two vectors of columns each) go to every task.
    """
    spark = df.sparkSession
    scale = scales(column_moments(df, kernels, sequence, fold), 2 * len(kernels))
    shipped = spark.sparkContext.broadcast((kernels, scale))
    kept = [c for c in df.columns if c != sequence]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bank_, scale_ = shipped.value
        for part, made in blocks(batches, sequence, bank_):
            x = {f: np.zeros((len(part), width)) for f in scale_}
            for start, z in made:
                w = directions(start, z.shape[1], width, seed)
                for f, (mean, sd) in scale_.items():
                    x[f] += ((z - mean[start : start + z.shape[1]]) / sd[start : start + z.shape[1]]) @ w
            for f in scale_:
                yield part[kept].assign(run=f, x=list(x[f]))

    return df.mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in kept), f"run {kinds[fold]}", "x array<double>"]))


def heads(rows: DataFrame, label: str, fold: str, models: dict[str, Fit]) -> DataFrame:
    """projected rows of held-out units with predicted and probability, for each model fitted outside their fold."""
    fits = fitted(rows, "x", label, fold, models, "run").where(F.col("run") == F.col("fold"))
    return predictions(rows.where(F.col("run") == F.col(fold)), "x", fold, fits, "run")


def head_weights(df: DataFrame, kernels: list[dict], sequence: str, label: str, width: int = 64, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Means of all columns, and the weights of the last class against the first in a ridge head on all units: those of the projection carried back to the columns."""
    whole = df.withColumns({"fold": F.lit(1), "label": F.col(label)}).select("fold", "label", sequence)
    moments = column_moments(whole, kernels, sequence, "fold").withColumn("fold", F.lit(0))  # so that they count as outside fold 1
    scale = scales(moments.unionByName(moments.select(F.lit(1).alias("fold"), "block", "m")), 2 * len(kernels))
    mean, sd = scale[1]
    shipped = df.sparkSession.sparkContext.broadcast(kernels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, made in blocks(batches, sequence, shipped.value):
            x = sum(((z - mean[b : b + z.shape[1]]) / sd[b : b + z.shape[1]]) @ directions(b, z.shape[1], width, seed) for b, z in made)
            yield pd.DataFrame({"label": part["label"], "x": list(x)})

    rows = whole.mapInPandas(run, f"label {dict(whole.dtypes)['label']}, x array<double>")
    total = moments_of(rows, "x", ["label"]).orderBy("label").toPandas()  # a row a class
    m = np.stack(total["m"].to_numpy())
    w, _ = ridge()(np.round(m[:, 0]), m[:, 1 : width + 1], m[:, width + 1 :].reshape(len(m), width, width))
    back = [directions(b, min(2 * BLOCK, 2 * len(kernels) - b), width, seed) @ (w[-1] - w[0])[:width] for b in range(0, 2 * len(kernels), 2 * BLOCK)]
    return mean, np.concatenate(back) / sd


def importance(df: DataFrame, kernels: list[dict], sequence: str, mean: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(kernel, pool, importance): mean absolute contribution weight * (column - mean) of each column over all units."""
    shipped = df.sparkSession.sparkContext.broadcast((kernels, mean, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bank_, mean_, weights_ = shipped.value
        held: dict[int, np.ndarray] = {}
        for part, made in blocks(batches, sequence, bank_):
            for start, z in made:
                at = slice(start, start + z.shape[1])
                m = np.append(np.abs((z - mean_[at]) * weights_[at]).sum(0), len(part))
                held[start] = held[start] + m if start in held else m
        if held:
            yield pd.DataFrame({"block": list(held), "m": list(held.values())})

    parts = df.select(sequence).mapInPandas(run, "block int, m array<double>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    total = added(added(parts, ["block", "salt"]), ["block"])
    each = total.select("block", F.element_at("m", -1).alias("n"), F.posexplode(F.slice("m", F.lit(1), F.size("m") - 1)).alias("i", "v"))
    column = F.col("block") + F.col("i")
    return each.select(F.floor(column / 2).cast("long").alias("kernel"), F.when(column % 2 == 0, "max").otherwise("ppv").alias("pool"), (F.col("v") / F.col("n")).alias("importance"))


def by_tag(found: DataFrame, kernels: DataFrame, tags: list[str]) -> DataFrame:
    """Importances of (kernel, pool) summed by tags of the described kernels, such as channel, or dilation and pool."""
    return found.join(kernels, "kernel").groupBy(*tags).agg(F.sum("importance").alias("importance"))


def by_step(found: DataFrame, kernels: DataFrame, steps: int) -> DataFrame:
    """(channel, step, importance): each kernel's importance spread over the steps its windows cover, a step as often as it is covered."""
    taps = F.transform(F.sequence(F.lit(0), (F.col("length") - 1).cast("int")), lambda i: i * F.col("dilation") - F.col("padding"))
    windows = F.sequence(F.lit(0), (steps + 2 * F.col("padding") - (F.col("length") - 1) * F.col("dilation") - 1).cast("int"))
    covered = F.flatten(F.transform(taps, lambda t: F.filter(F.transform(windows, lambda w: w + t), lambda p: (p >= 0) & (p < steps))))
    d = found.groupBy("kernel").agg(F.sum("importance").alias("importance")).join(kernels, "kernel").withColumn("at", covered)
    d = d.select("channel", (F.col("importance") / F.size("at")).alias("share"), F.explode("at").alias("step"))
    return d.groupBy("channel", F.col("step").cast("long").alias("step")).agg(F.sum("share").alias("importance"))
