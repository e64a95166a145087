"""Classification metrics from tables of (true, pred) and (y, score), by aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, true: str, pred: str, labels: list) -> DataFrame:
    """(true, pred, n) for every pair of labels, zeros kept."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[true]
    grid = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in labels)).cast(f"array<{kind}>")).alias("true"), F.array(*(F.lit(x) for x in labels)).cast(f"array<{kind}>").alias("p")).select("true", F.explode("p").alias("pred"))
    n = df.groupBy(F.col(true).alias("true"), F.col(pred).cast(kind).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A row (for each key): accuracy, macro_f1 (classes that are true or predicted), balanced (true classes), kappa, mcc, from cells (keys, true, pred, n)."""
    keys = keys or []
    by_true = cells.groupBy(*keys, F.col("true").alias("c")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = cells.groupBy(*keys, F.col("pred").alias("c")).agg(F.sum("n").alias("p"))
    m = by_true.join(by_pred, [*keys, "c"], "full").select(*keys, "c", *(F.coalesce(x, F.lit(0)).cast("double").alias(x) for x in ("t", "p", "tp")))
    a = m.groupBy(*keys).agg(
        F.sum("tp").alias("hit"), F.sum("t").alias("n"), F.sum(F.col("t") * F.col("p")).alias("tp_sum"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"),
        F.avg(F.when(F.col("t") + F.col("p") > 0, 2 * F.col("tp") / (F.col("t") + F.col("p")))).alias("macro_f1"), F.avg(F.when(F.col("t") > 0, F.col("tp") / F.col("t"))).alias("balanced"),
    )
    n, chance = F.col("n"), F.col("tp_sum") / (F.col("n") * F.col("n"))
    root = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))
    return a.select(*keys, (F.col("hit") / n).alias("accuracy"), "macro_f1", "balanced", F.when(chance < 1, (F.col("hit") / n - chance) / (1 - chance)).alias("kappa"), F.when(root > 0, (F.col("hit") * n - F.col("tp_sum")) / root).otherwise(0.0).alias("mcc"))


def _by_score(df: DataFrame, y: str, score: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, F.col(score).alias("s")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, y: str, score: str, keys: list[str]) -> DataFrame:
    """Exact, ties counting half; null where a group has one class. Windows run over distinct scores."""
    d = _by_score(df, y, score, keys)
    below = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    a = d.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    return a.select(*keys, F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("u") / (F.col("n1") * F.col("n0"))).alias("auc"))


def average_precision(df: DataFrame, y: str, score: str, keys: list[str]) -> DataFrame:
    """Sum over distinct thresholds of the gain in recall times precision."""
    d = _by_score(df, y, score, keys)
    w = Window.partitionBy(*keys).orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w)})
    a = d.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("g"), F.sum("pos").alias("n1"))
    return a.select(*keys, F.when(F.col("n1") > 0, F.col("g") / F.col("n1")).alias("ap"))
