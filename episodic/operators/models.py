"""Learners and protocols on tables, with pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import class_metrics
from .windows import prefix_sum


def matrix(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """df with features (median-imputed) and label, the index of the sorted classes."""
    filled = [f"__{c}" for c in columns]
    steps = [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc")]
    return Pipeline(stages=steps).fit(df).transform(df).drop("raw", *filled)


def require_same_units(a: DataFrame, b: DataFrame, key: str, shown: int = 5) -> None:
    """Raise ValueError unless both hold each key equally often (null counts as a key), naming how many differ and the first of them."""
    n = lambda d, name: d.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias(name))
    x, y = n(a, "left"), n(b, "right").withColumnRenamed("k", "k2")
    both = x.join(y, F.col("k").eqNullSafe(F.col("k2")), "full").select(F.coalesce("k", "k2").alias("k"), F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"))
    odd = both.where(F.col("left") != F.col("right"))
    total = odd.count()
    if total:
        first = ", ".join(f"{r.k} ({r.left} against {r.right})" for r in odd.orderBy(F.col("k").asc_nulls_first()).limit(shown).collect())
        raise ValueError(f"{total} units differ: {first}")


def sequences(curves: DataFrame, units: DataFrame, channels: list[str], steps: int) -> DataFrame:
    """(unit_id, seq): channel x step values of each training unit of curves(unit_id, split, step, channels).

    Raises ValueError unless the training units of both tables (unit_id, split) are the same and each has every step from 0 to steps - 1 once.
    """
    d = curves.where("split = 'train'")
    require_same_units(d.select("unit_id").distinct(), units.where("split = 'train'").select("unit_id"), "unit_id")
    g = d.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("step", *channels))).alias("v"), F.count_distinct("step").alias("n"), F.min("step").alias("lo"), F.max("step").alias("hi"))
    odd = g.where((F.size("v") != steps) | (F.col("n") != steps) | (F.col("lo") != 0) | (F.col("hi") != steps - 1)).select("unit_id").orderBy("unit_id").limit(5).collect()
    if odd:
        raise ValueError(f"units without each of {steps} steps once, such as {', '.join(str(r.unit_id) for r in odd)}")
    return g.select("unit_id", F.array(*(F.col(f"v.{c}") for c in channels)).alias("seq"))


def balanced(df: DataFrame) -> DataFrame:
    """df with weight: n / (classes * rows of the class)."""
    n = df.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    return df.join(F.broadcast(n.crossJoin(n.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k")))), "label").withColumn("weight", F.col("n") / (F.col("k") * F.col("c"))).drop("c", "n", "k")  # one row a class


def logistic(c: float = 1.0) -> Callable[[DataFrame], LogisticRegression]:
    """L2 logistic regression with weight 1/c on the penalty, for weighted rows."""
    return lambda train: LogisticRegression(family="multinomial", elasticNetParam=0.0, regParam=1.0 / (c * max(train.agg(F.sum("weight")).first()[0] or 1.0, 1.0)), weightCol="weight", standardization=False, maxIter=50)


def boosted(rounds: int = 20) -> Callable[[DataFrame], object]:
    """Shallow boosted trees; one against the rest where there are more than two classes."""

    def make(train: DataFrame):
        tree = GBTClassifier(maxDepth=3, maxIter=rounds, stepSize=0.05, subsamplingRate=0.9, seed=0, weightCol="weight")
        return tree if train.select("label").distinct().count() <= 2 else OneVsRest(classifier=tree, weightCol="weight")

    return make


def out_of_fold(df: DataFrame, make: Callable, fold: str = "fold") -> DataFrame:
    """Rows with prediction from a model that did not see their fold; the folds are a bounded set."""
    out = None
    for (f,) in df.select(fold).distinct().orderBy(fold).collect():
        train = balanced(df.where(F.col(fold) != f))
        scored = make(train).fit(train).transform(df.where(F.col(fold) == f)).drop("rawPrediction", "probability")
        out = scored if out is None else out.unionByName(scored)
    return out


def fold_metrics(predicted: DataFrame, fold: str = "fold") -> DataFrame:
    """(fold, macro_f1, kappa, ...) of each fold."""
    out = None
    for (f,) in predicted.select(fold).distinct().orderBy(fold).collect():
        cells = predicted.where(F.col(fold) == f).groupBy(F.col("label").alias("true"), F.col("prediction").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
        row = class_metrics(cells).withColumn("fold", F.lit(f))
        out = row if out is None else out.unionByName(row)
    return out


def ranked(df: DataFrame, key: Column, name: str, slices: int = 64) -> DataFrame:
    """df with its rows numbered from 1 in order of an ordering key of type long, no task holding more than a range of keys."""
    return prefix_sum(df.withColumns({"__k": key, "__one": F.lit(1)}), ["__k"], "__one", name, slices).drop("__k", "__one")


def permuted(df: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """df with a column's values dealt anew in a seeded order of a unique key; totals stay."""
    shuffled = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 13), 16, 10).cast("long")
    a = ranked(df, F.col(key).cast("long"), "__i")
    b = ranked(df.select(key, F.col(column).alias("__v")), shuffled, "__i").select("__v", "__i")
    return a.join(b, "__i").withColumn(column, F.col("__v")).drop("__i", "__v")


def clusters(df: DataFrame, k: int, rank_by: str, seeds: range = range(20)) -> DataFrame:
    """df(features, ...) with cluster: the cheapest of some starts, numbered by the median of a column."""
    best = min((KMeans(k=k, seed=s, maxIter=20).fit(df) for s in seeds), key=lambda m: m.summary.trainingCost)
    placed = best.transform(df)
    rank = placed.groupBy("prediction").agg(F.median(rank_by).alias("m")).withColumn("cluster", F.row_number().over(Window.orderBy("m", "prediction")) - 1)
    return placed.join(F.broadcast(rank.select("prediction", "cluster")), "prediction").drop("prediction")  # k rows


def components(df: DataFrame, k: int) -> DataFrame:
    """df(features, ...) with pcs, its first k principal components."""
    return PCA(k=k, inputCol="features", outputCol="pc").fit(df).transform(df).withColumn("pcs", vector_to_array("pc")).drop("pc")


def explained(df: DataFrame, share: float) -> DataFrame:
    """(component, share, total): the first principal components of features that together hold a share of the variance."""
    size = len(df.select("features").first()[0])
    held = PCA(k=size, inputCol="features", outputCol="pc").fit(df).explainedVariance.toArray()
    totals = held.cumsum()
    kept = int((totals < share - 1e-12).sum()) + 1
    return df.sparkSession.createDataFrame([(i + 1, float(held[i]), float(totals[i])) for i in range(min(kept, size))], "component long, share double, total double")


def components_holding(df: DataFrame, share: float) -> DataFrame:
    """df(features, ...) with pcs, as many principal components as hold a share of the variance."""
    return components(df, explained(df, share).count())


def vectors(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
