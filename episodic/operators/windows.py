"""Operators over ordered readings of each series.

Windows are partitioned by series_id. prefix_sum is for orders over all rows: ranges, their totals, then
sums inside a range, so no task sees more than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import micros
from .quantiles import exact_quantiles

HOUR_US = 3_600_000_000


def series(*more: str) -> Window:
    return Window.partitionBy("series_id").orderBy("ts", *more)


def rolling(df: DataFrame, columns: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Aggregates over the last so many hours, (t - hours, t]: name -> (function, column, hours)."""
    out = df.withColumn("__us", micros(F.col("ts")))
    for name, (fn, column, hours) in columns.items():
        w = Window.partitionBy("series_id").orderBy("__us").rangeBetween(1 - hours * HOUR_US, 0)
        out = out.withColumn(name, getattr(F, fn)(column).over(w))
    return out.drop("__us")


def run_ids(df: DataFrame, value: Column, name: str = "rid") -> DataFrame:
    """Numbers of runs of equal values; a null is a run of its own."""
    w = series()
    changed = F.coalesce(value != F.lag(value).over(w), F.lit(True)).cast("int")
    return df.withColumn("__c", changed).withColumn(name, F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__c")


def absorb_gaps(df: DataFrame, value: str, gap: int) -> DataFrame:
    """df(series_id, ts, value) with active: value not 0, or in a run of zeros of at most gap rows; null stays null; and rid, its runs."""
    runs = run_ids(df.withColumn("__on", F.col(value) != 0), F.col("__on"), "__r")
    length = F.count(F.lit(1)).over(Window.partitionBy("series_id", "__r"))
    runs = runs.withColumn("active", F.when(F.col("__on").isNull(), None).otherwise(F.col("__on") | (length <= gap))).drop("__on", "__r")
    return run_ids(runs, F.col("active"))


def forward_fill(df: DataFrame, columns: dict[str, float]) -> DataFrame:
    """Nulls take the last value before them, or the constant where there is none."""
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(v)) for c, v in columns.items()})


def causal_fill(df: DataFrame, levels: list[str], fluxes: list[str]) -> DataFrame:
    """Nulls take the last value before them; where there is none, a level takes its median over all rows and a flux 0. A level without any value stays null."""
    middles = exact_quantiles(df, levels, [0.5])
    return forward_fill(df, {**{c: m for c, (m,) in middles.items()}, **{c: 0.0 for c in fluxes}})


def leading_null_guard(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per series and column, nulls left and whether they are all at the beginning after filling forward."""
    d = df.withColumn("__i", F.row_number().over(series()))
    filled = d.withColumns({f"__f_{c}": F.last(c, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0)) for c in columns})
    parts = [F.struct(F.lit(c).alias("channel"), F.count_if(F.col(f"__f_{c}").isNull()).alias("n_null"), F.coalesce(F.max(F.when(F.col(f"__f_{c}").isNull(), F.col("__i"))), F.lit(0)).cast("long").alias("last_null")) for c in columns]
    out = filled.groupBy("series_id").agg(F.array(*parts).alias("p")).select("series_id", F.inline("p"))
    return out.withColumn("prefix_only", F.col("n_null") == F.col("last_null"))


def complete_grid(df: DataFrame, step: str = "1 hour") -> DataFrame:
    """df with a row for every step between the first and last time of each series."""
    grid = df.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("series_id", F.explode(F.expr(f"sequence(a, b, INTERVAL {step})")).alias("ts"))
    return grid.join(df, ["series_id", "ts"], "left")


def interpolate_gaps(df: DataFrame, column: str) -> DataFrame:
    """Nulls of a column on the straight line between their neighbours in time; at the ends the nearest value."""
    w = series()
    at = F.when(F.col(column).isNotNull(), F.struct(micros(F.col("ts")).alias("t"), F.col(column).alias("v")))
    d = df.withColumn("__p", F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    line = F.col("__p.v") + (F.col("__n.v") - F.col("__p.v")) * (micros(F.col("ts")) - F.col("__p.t")) / (F.col("__n.t") - F.col("__p.t"))
    return d.withColumn(column, F.coalesce(F.col(column), line, F.col("__p.v"), F.col("__n.v"))).drop("__p", "__n")


def downsample(df: DataFrame, n: int, levels: list[str], fluxes: list[str]) -> DataFrame:
    """n bins of equally many rows per series: means of levels, sums of fluxes (all-null is 0)."""
    idx, total = F.row_number().over(series()) - 1, F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    d = df.withColumn("bin", F.floor(idx * n / F.greatest(total, F.lit(n))).cast("long"))
    return d.groupBy("series_id", "bin").agg(F.min("ts").alias("ts"), *(F.avg(c).alias(c) for c in levels), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in fluxes))


def lag_correlation(df: DataFrame, driver: str, target: str, lags: list[int]) -> DataFrame:
    """Correlation of a driver with the target so many rows later, both centred on the whole series, nulls as the mean.

    Where one of them never changes it is 0 / 0, NaN.
    """
    mean = Window.partitionBy("series_id")
    d = df.withColumns({"__a": F.coalesce(F.col(driver) - F.avg(driver).over(mean), F.lit(0.0)), "__b": F.coalesce(F.col(target) - F.avg(target).over(mean), F.lit(0.0))})
    led = d.select("series_id", "__a", *(F.lead("__b", k).over(series()).alias(f"__b{k}") for k in lags))
    row = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("lag"), F.col("__a").alias("a"), F.col(f"__b{k}").alias("b")) for k in lags)))
    long = led.select("series_id", row.alias("x")).select("series_id", "x.*").where("b IS NOT NULL")
    both, apart = F.avg(F.col("a") * F.col("b")), F.stddev_pop("a") * F.stddev_pop("b")
    flat = F.when(both == 0, F.lit(float("nan"))).otherwise(F.signum(both) * F.lit(float("inf")))  # division as of doubles, without an error
    return long.groupBy("series_id", "lag").agg(F.coalesce(F.try_divide(both, apart), flat).alias("corr"))


def histories(df: DataFrame, column: str, length: int, horizon: int, stride: int) -> DataFrame:
    """One row per origin: the length values before it and the horizon values from it, at every stride-th row with both whole."""
    w = series()
    d = df.withColumns({
        "__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy("series_id")),
        "history": F.transform(F.collect_list(F.struct(column)).over(w.rowsBetween(-length, -1)), lambda s: s[column]),
        "future": F.transform(F.collect_list(F.struct(column)).over(w.rowsBetween(0, horizon - 1)), lambda s: s[column]),
    })
    return d.where((F.col("__i") >= length) & (F.col("__i") + horizon <= F.col("__n")) & (F.pmod(F.col("__i") - length, F.lit(stride)) == 0)).select("series_id", F.col("ts").alias("origin"), "history", "future")


def prefix_sum(df: DataFrame, order: list[str], value: str, name: str = "running", slices: int = 256) -> DataFrame:
    """Running sums of value over all rows in order of a first numeric or time column and ties by the rest.

    Rows are put in slices by quantiles of the first column; sums per slice come first (one row each), then
    sums inside the slices. Equal values share a slice.
    """
    key = F.col(order[0]).cast("double")
    cuts = sorted(set(df.agg(F.percentile_approx(key, [i / slices for i in range(1, slices)], 10_000).alias("c")).first()["c"] or []))
    d = df.withColumn("__s", F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < key)) if cuts else F.lit(0))
    totals = d.groupBy("__s").agg(F.sum(value).alias("__t"))
    base = totals.select("__s", F.coalesce(F.sum("__t").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inside = Window.partitionBy("__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("__in", F.sum(value).over(inside)).join(F.broadcast(base), "__s").withColumn(name, F.col("__in") + F.col("__b")).drop("__s", "__in", "__b")  # base: one row a slice
