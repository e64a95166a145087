"""Held-out validation from moments: every fold's model out of one pass over the rows.

A row adds its class's count, sums and products of features to the moments of its fold. The moments of all rows but
a fold's are the totals less the fold's own, so leave-one-group-out over any number of groups, or all folds of all
repeats, cost one scan; fitting works on the moments alone, a task a fold. Models are functions of moments: ridge on
class indicators, linear discriminants, Gaussian naive Bayes, and principal components before a linear one. All weigh
classes evenly. A fit that fails becomes a row with its error, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import mean_std_text
from .metrics import average_precision, class_metrics, roc_auc

#: Fitted models that are broadcast to the rows they score; beyond that the join shuffles by fold.
FITTED = 2_000
#: Doubles of moments that a task holds before it hands them on.
HELD = 4_000_000

Fit = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _spread(n: np.ndarray, s: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, population deviation (1 where it is 0) and covariance of all rows."""
    mean = s.sum(0) / n.sum()
    cov = g.sum(0) / n.sum() - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    return mean, np.where(sd > 1e-12 * np.maximum(1, np.abs(mean)), sd, 1.0), cov


def _linear(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.hstack([w, np.zeros_like(w)]), b


def ridge(alpha: float = 1.0) -> Fit:
    """Least squares of 1 for a row's class and -1 for the others on scaled features, penalised but for the intercept."""

    def fit(n, s, g):
        mean, sd, _ = _spread(n, s, g)
        weight = n.sum() / (len(n) * n)
        z = (s - n[:, None] * mean) / sd
        zz = (g - s[:, :, None] * mean - mean[:, None] * s[:, None, :] + n[:, None, None] * np.outer(mean, mean)) / np.outer(sd, sd)
        k = s.shape[1]
        gram, cross = np.zeros((k + 1, k + 1)), np.zeros((k + 1, len(n)))
        for c in range(len(n)):
            gram[:k, :k] += weight[c] * zz[c]
            gram[:k, k] += weight[c] * z[c]
            gram[k, k] += weight[c] * n[c]
            cross += np.outer(np.append(z[c], n[c]) * weight[c], np.where(np.arange(len(n)) == c, 1.0, -1.0))
        gram[k, :k] = gram[:k, k]
        solved = np.linalg.solve(gram + alpha * np.diag([1.0] * k + [0.0]), cross)
        w = solved[:k].T / sd
        return _linear(w, solved[k] - w @ mean)

    return fit


def lda(shrink: float = 1e-3) -> Fit:
    """Linear discriminants with the pooled covariance inside classes, shrunk towards its diagonal's mean."""

    def fit(n, s, g):
        means = s / n[:, None]
        inside = (g - n[:, None, None] * means[:, :, None] * means[:, None, :]).sum(0) / n.sum()
        inside = (1 - shrink) * inside + shrink * max(np.trace(inside) / len(inside), 1e-12) * np.eye(len(inside))
        w = np.linalg.solve(inside, means.T).T
        return _linear(w, -(w * means).sum(1) / 2)

    return fit


def bayes(smooth: float = 1e-9) -> Fit:
    """Independent normal features per class; smooth times the largest variance is added to all."""

    def fit(n, s, g):
        means = s / n[:, None]
        var = np.diagonal(g, axis1=1, axis2=2) / n[:, None] - means**2
        var = var + smooth * np.diag(_spread(n, s, g)[2]).max()
        if (var <= 0).any():
            raise ValueError("a feature without variance")
        return np.hstack([means / var, -0.5 / var]), -0.5 * (np.log(2 * np.pi * var) + means**2 / var).sum(1)

    return fit


def components(share: float, inner: Fit) -> Fit:
    """A linear model on the principal components of scaled features that hold a share of the variance."""

    def fit(n, s, g):
        mean, sd, cov = _spread(n, s, g)
        values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        kept = int(np.searchsorted(np.cumsum(values) / values.sum(), share - 1e-12)) + 1
        to = vectors[:, :kept] / sd[:, None]  # features to components, after the mean is taken out
        moved = s - n[:, None] * mean
        central = g - s[:, :, None] * mean - mean[:, None] * s[:, None, :] + n[:, None, None] * np.outer(mean, mean)
        w, b = inner(n, moved @ to, np.einsum("ik,cij,jl->ckl", to, central, to))
        if np.any(w[:, kept:]):
            raise ValueError("components need a linear model")
        w = w[:, :kept] @ to.T
        return _linear(w, b - w @ mean)

    return fit


def moments(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """(keys, m): n, sums and products of the array column x for each key, flat; rows with a null or NaN feature are left out."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "m array<double>", "salt int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pd.DataFrame:
            rows = [(*key, m, i % 32) for i, (key, m) in enumerate(held.items())]
            held.clear()
            return pd.DataFrame(rows, columns=[*keys, "m", "salt"])

        for batch in batches:
            for key, part in batch.groupby(keys, sort=False, dropna=False):
                v = np.stack(part["x"].to_numpy())
                m = np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])
                held[key] = held[key] + m if key in held else m
            if held and len(held) * len(next(iter(held.values()))) > HELD:
                yield out()
        if held:
            yield out()

    full = df.select(*keys, F.col(x).cast("array<double>").alias("x")).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    parts = full.mapInPandas(run, schema).withColumn("salt", F.pmod(F.spark_partition_id() + F.col("salt"), F.lit(32)))
    return added(added(parts, [*keys, "salt"]), keys)


def added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m): arrays m of equal keys added up."""
    kinds = dict(parts.dtypes)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[keys].iloc[:1].assign(m=[np.sum(np.stack(pdf["m"].to_numpy()), axis=0)])

    return parts.select(*keys, "m").groupBy(*keys).applyInPandas(add, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "m array<double>"]))


def fitted(df: DataFrame, x: str, label: str, fold: str, models: dict[str, Fit], run: str | None = None) -> DataFrame:
    """(run, fold, model, classes, w, b, error): each model fitted to all rows of a run but a fold's, or why it could not be."""
    named = df.select(*([run] if run else []), fold, label, x).withColumnRenamed(fold, "fold").withColumnRenamed(label, "label")
    named = named.withColumnRenamed(run, "run") if run else named.withColumn("run", F.lit(0).cast("long"))
    own = moments(named, x, ["run", "fold", "label"])
    totals = added(own, ["run", "label"]).withColumnRenamed("m", "total")
    pairs = own.select("run", "fold").distinct().join(totals, "run").join(own, ["run", "fold", "label"], "left")
    kinds = dict(pairs.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("label")
        classes, tables = [], []
        for row in pdf.itertuples():
            rest = np.array(row.total) if row.m is None else np.array(row.total) - np.array(row.m)
            if rest[0] > 0.5:
                classes.append(row.label)
                tables.append(rest)
        k = int(np.sqrt(len(pdf["total"].iloc[0])))
        out = []
        for name, model in models.items():
            w = b = error = None
            try:
                if len(classes) < 2:
                    raise ValueError("fewer than two classes to train on")
                m = np.array(tables)
                w, b = model(np.round(m[:, 0]), m[:, 1 : k + 1], m[:, k + 1 :].reshape(len(m), k, k))
                if not (np.isfinite(w).all() and np.isfinite(b).all()):
                    raise ValueError("coefficients are not finite")
            except Exception as e:  # a model that fails is a row, not the end of the sweep
                w, b, error = None, None, f"{type(e).__name__}: {e}"
            out.append((pdf["run"].iloc[0], pdf["fold"].iloc[0], name, classes, None if w is None else w.tolist(), None if b is None else b.tolist(), error))
        return pd.DataFrame(out, columns=["run", "fold", "model", "classes", "w", "b", "error"])

    return pairs.groupBy("run", "fold").applyInPandas(fit, f"run {kinds['run']}, fold {kinds['fold']}, model string, classes array<{kinds['label']}>, w array<array<double>>, b array<double>, error string")


def predictions(df: DataFrame, x: str, fold: str, models: DataFrame, run: str | None = None) -> DataFrame:
    """df for each model that was fitted without the row's fold: model, predicted, classes and probability per class (softmax of the scores)."""
    good = models.where("error IS NULL").drop("error").withColumnRenamed("fold", "__f").withColumnRenamed("run", "__r")
    good = F.broadcast(good) if good.limit(FITTED + 1).count() <= FITTED else good
    on = F.col(fold).eqNullSafe(F.col("__f")) & (F.col(run).eqNullSafe(F.col("__r")) if run else F.lit(True))
    full = F.concat(F.col(x).cast("array<double>"), F.transform(F.col(x).cast("array<double>"), lambda v: v * v))
    d = df.join(good, on).withColumn("__x", full)
    score = F.transform("w", lambda row, c: F.aggregate(F.zip_with(row, "__x", lambda a, v: a * v), F.lit(0.0), lambda a, v: a + v) + F.get("b", c))
    d = d.withColumn("__s", score)
    d = d.withColumn("__e", F.transform("__s", lambda v: F.exp(v - F.array_max("__s"))))
    total = F.aggregate("__e", F.lit(0.0), lambda a, v: a + v)
    return d.withColumns({"predicted": F.get("classes", (F.array_position("__s", F.array_max("__s")) - 1).cast("int")), "probability": F.transform("__e", lambda v: v / total)}).drop("__f", "__r", "__x", "__s", "__e", "w", "b")


METRICS = ["macro_f1", "balanced", "kappa", "mcc", "roc_auc", "pr_auc"]


def against_rest(predicted: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """(keys, cls, y, p): a row for each row and class, whether it is the row's class and its probability."""
    one = predicted.select(*keys, F.col(label).alias("__l"), F.explode(F.arrays_zip("classes", "probability")).alias("__z"))
    return one.select(*keys, F.col("__z.classes").alias("cls"), (F.col("__l") == F.col("__z.classes")).cast("int").alias("y"), F.col("__z.probability").alias("p"))


def scores(predicted: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """(keys, metric, value) of predictions; the two areas are one class against the rest, averaged over classes."""
    cells = predicted.groupBy(*keys, F.col(label).alias("true"), F.col("predicted").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    one = against_rest(predicted, label, keys)
    areas = roc_auc(one, "y", "p", [*keys, "cls"]).join(average_precision(one, "y", "p", [*keys, "cls"]), [*keys, "cls"])
    areas = areas.groupBy(*keys).agg(F.avg("auc").alias("roc_auc"), F.avg("ap").alias("pr_auc"))
    wide = class_metrics(cells, keys).join(areas, keys)
    return wide.select(*keys, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))))


def results(values: DataFrame, table: str) -> DataFrame:
    """(table, model, metric, mean, std) of (model, ..., metric, value): std over folds, null for a single one."""
    g = values.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.when(F.count(F.lit(1)) > 1, F.stddev_pop("value")).alias("std"))
    return g.select(F.lit(table).alias("table"), "model", "metric", "mean", "std")


def with_chance(tidy: DataFrame, classes: int) -> DataFrame:
    """results with lo and hi, a deviation below and above the mean (the mean itself where there is none), and chance: what even guessing reaches among so many classes, null for metrics without one."""
    even = F.when(F.col("metric").isin("macro_f1", "balanced"), F.lit(1.0 / classes)).when(F.col("metric") == "roc_auc", 0.5)
    return tidy.withColumns({"lo": F.col("mean") - F.coalesce("std", F.lit(0.0)), "hi": F.col("mean") + F.coalesce("std", F.lit(0.0)), "chance": even})


def per_pass(cells: DataFrame, repeats: int) -> DataFrame:
    """confusion_frame with per_pass, the count of an average repeat, and share, that among rows of its true class (null where a class is never true)."""
    n = F.sum("count").over(Window.partitionBy("table", "model", "true"))
    return cells.withColumns({"per_pass": F.col("count") / repeats, "share": F.when(n > 0, F.col("count") / n)})


def compare_routes(frames: dict[str, DataFrame], table: str, metrics: list[str]) -> DataFrame:
    """A row a model: its rank and, for each route and metric, "mean ± std" (the mean alone without a deviation) as a column "route · metric".

    Models are ranked by the first route's first metric, best first, models without it last, equal ones by name. A model that a
    route lacks has nulls there; a route without the table gives no columns.
    """
    tidy = [f.where(F.col("table") == table).select(F.lit(r).alias("route"), "model", "metric", "mean", "std").where(F.col("metric").isin(metrics)) for r, f in frames.items()]
    every = reduce(DataFrame.unionByName, tidy).persist()  # read for the routes that there are, and pivoted
    there = {r.route for r in every.select("route").distinct().collect()}
    names = [f"{r} · {m}" for r in frames if r in there for m in metrics]
    text = F.when(F.col("std").isNull(), F.format_string("%.3f", "mean")).otherwise(mean_std_text(F.col("mean"), F.col("std")))
    first = F.concat_ws(" · ", "route", "metric") == f"{next(iter(frames))} · {metrics[0]}"
    ranks = every.groupBy("model").agg(F.max(F.when(first, F.col("mean"))).alias("by"))
    ranks = ranks.withColumn("rank", F.row_number().over(Window.orderBy(F.col("by").desc_nulls_last(), "model")).cast("long"))  # a row a model
    if not names:
        return ranks.select("rank", "model")
    wide = every.groupBy("model").agg(*(F.max(F.when(F.concat_ws(" · ", "route", "metric") == n, text)).alias(n) for n in names))
    return ranks.join(wide, "model").select("rank", "model", *(F.col(f"`{n}`") for n in names))


def confusion_frame(predicted: DataFrame, label: str, table: str) -> DataFrame:
    """(table, model, true, pred, count) with every pair of classes, summed over folds and runs."""
    n = predicted.groupBy("model", F.col(label).alias("true"), F.col("predicted").alias("pred")).agg(F.count(F.lit(1)).alias("count"))
    classes = n.select(F.col("true").alias("c")).union(n.select("pred")).distinct()
    grid = n.select("model").distinct().join(F.broadcast(classes.agg(F.collect_list("c").alias("cs")))).select("model", F.explode("cs").alias("true"), "cs").select("model", "true", F.explode("cs").alias("pred"))  # classes
    return grid.join(n, ["model", "true", "pred"], "left").select(F.lit(table).alias("table"), "model", "true", "pred", F.coalesce("count", F.lit(0)).alias("count"))


def boundary(predicted: DataFrame, group: str) -> DataFrame:
    """(group, n, median_bits, others_bits, above): a group's median entropy of probabilities, that of all other groups' rows, and the share of rows above it.

    Medians come from counts of distinct entropies (rounded to 9 digits), so rows don't meet.
    """
    p = F.least(F.greatest(F.array_max("probability"), F.lit(1e-9)), F.lit(1 - 1e-9))
    bits = F.round(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)), 9)
    n = predicted.select(F.col(group).alias("g"), bits.alias("h")).groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"))
    groups = n.select("g").distinct()
    other = F.broadcast(groups.agg(F.collect_list("g").alias("gs")))  # a name a group
    apart = n.crossJoin(other).select("h", "n", F.explode(F.filter("gs", lambda x: x != F.col("g"))).alias("g"))
    middle = apart.groupBy("g", "h").agg(F.sum("n").alias("n")).groupBy("g").agg(F.expr("percentile(h, 0.5, n)").alias("others_bits"))
    own = n.join(F.broadcast(middle), "g")  # a row a group
    out = own.groupBy("g", "others_bits").agg(F.sum("n").alias("n"), F.expr("percentile(h, 0.5, n)").alias("median_bits"), F.sum(F.when(F.col("h") > F.col("others_bits"), F.col("n")).otherwise(0)).alias("up"))
    return out.select(F.col("g").alias(group), "n", "median_bits", "others_bits", (F.col("up") / F.col("n")).alias("above"))


def repeated(df: DataFrame, group: str, label: str, k: int, repeats: int, deal: Callable[[DataFrame, str, str, int, int], DataFrame]) -> DataFrame:
    """df for each repeat (run) with fold: groups dealt anew to k folds by deal(df, group, label, k, seed)."""
    out = None
    for seed in range(repeats):
        groups = deal(df.select(group, label), group, label, k, seed).select(F.col(group).alias("__g"), "fold").distinct().withColumn("run", F.lit(seed).cast("long"))
        out = groups if out is None else out.unionByName(groups)
    return df.join(out, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def sweep(models: dict[str, Callable[[], DataFrame]], table: str) -> DataFrame:
    """(table, model, metric, mean, std, error): each model's (metric, mean, std), or one row with what it raised."""
    rows = []
    for name, make in models.items():
        try:
            rows += [(table, name, r.metric, r.mean, r.std, None) for r in make().select("metric", "mean", "std").collect()]  # a row a metric
        except Exception as e:
            rows.append((table, name, None, None, None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    return SparkSession.active().createDataFrame(rows, "table string, model string, metric string, mean double, std double, error string")
