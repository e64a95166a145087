"""Mutual information of continuous features with a class, by distances to nearest neighbours.

For each point: the distance r to the k-th nearest point of its own class (k less in small classes), then the number m of
points of all classes nearer than that. The information is psi(N) + mean psi(k) - mean psi(class size) - mean psi(m), at
least 0. Everything is sorting in one dimension: equal values are counted first and put in slices of bounded size by
quantiles of the feature. Nearly all points have r and m inside their slice. The rest, at most k at either end of a class in a
slice and few more, take neighbours from the ends of the slices around, and m from a second look into the slices
in which the ends of their distance lie. No point meets all others.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a feature that a slice is meant to hold.
SLICE = 250_000
#: Classes of one row that are broadcast.
FEW = 20_000


def digamma(n, log: Callable):
    """The digamma function of whole numbers from 1, as doubles: the series at n + 8, less the steps up to there."""
    m = n + 8
    series = log(m) - 1 / (2 * m) - 1 / (12 * m**2) + 1 / (120 * m**4) - 1 / (252 * m**6)
    return series - sum((1 / (n + i) for i in range(1, 8)), 1 / n)


def psi(n: Column) -> Column:
    return digamma(n.cast("double"), F.log)


def sliced(df: DataFrame, columns: list[str], cuts: list[list[float]]) -> DataFrame:
    """df with slices: for each column how many of its cut points are not above its value; for nulls and NaN anything."""
    cut = [i for i, c in enumerate(cuts) if c]
    if cut:
        splits = [[-math.inf, *cuts[i], math.inf] for i in cut]
        df = Bucketizer(splitsArray=splits, inputCols=[columns[i] for i in cut], outputCols=[f"__s{i}" for i in cut], handleInvalid="keep").transform(df)
    return df.withColumn("slices", F.array(*((F.col(f"__s{i}") if c else F.lit(0)).cast("int") for i, c in enumerate(cuts)))).drop(*(f"__s{i}" for i in cut))


def cut_points(wide: DataFrame, columns: list[str], slices: list[int]) -> list[list[float]]:
    """For each column the values that cut it into about so many slices of equally many rows; equal values share a slice."""
    shares = [F.percentile_approx(F.when(~F.isnan(c), F.col(c)), [i / s for i in range(1, s)] or [0.5], max(10_000, 20 * s)) for c, s in zip(columns, slices, strict=True)]
    found = wide.agg(*(a.alias(c) for a, c in zip(shares, columns, strict=True))).first()  # a number a slice
    return [sorted({v for v in found[c] or [] if math.isfinite(v)}) if s > 1 else [] for c, s in zip(columns, slices, strict=True)]


def tall(wide: DataFrame, columns: list[str], cuts: list[list[float]]) -> DataFrame:
    """(f, slice, y, x): a row a value that is neither null nor NaN, f the place of its column."""
    pairs = F.array(*(F.struct(F.lit(i).alias("f"), F.get("slices", F.lit(i)).alias("slice"), F.col(c).alias("x")) for i, c in enumerate(columns)))
    return sliced(wide, columns, cuts).select("y", F.explode(pairs).alias("p")).select("p.f", "p.slice", "y", "p.x").where(F.col("x").isNotNull() & ~F.isnan("x"))


def settled(k: int) -> Callable[[pa.Table], pa.Table]:
    """For the values of a slice (f, slice, y, x, c): one row with their total and what the points add that need no other slice,
    and the rows needed beyond it: a class's first and last 2k values, and the asked points, which are not settled yet, with r if it is known.
    """

    def run(part: pa.Table) -> pa.Table:
        x, c, y = part["x"].to_numpy(), part["c"].to_numpy(), part["y"].combine_chunks().dictionary_encode().indices.to_numpy()
        by_x = np.argsort(x, kind="stable")
        every, below = x[by_x], np.concatenate([[0], np.cumsum(c[by_x])])
        order = by_x[np.argsort(y[by_x], kind="stable")]  # by class, then value
        x, c, y = x[order], c[order], y[order]
        n, place = len(x), np.arange(len(x))
        first, end = np.searchsorted(y, y, "left"), np.searchsorted(y, y, "right")
        left, right, seen, r = place - 1, place + 1, c - 1, np.zeros(n)
        with np.errstate(invalid="ignore", over="ignore"):
            for _ in range(k):  # the nearer of both sides, until k are seen
                a = np.where(left >= first, x - x[np.maximum(left, 0)], np.inf)
                b = np.where(right < end, x[np.minimum(right, n - 1)] - x, np.inf)
                more, nearer = seen < k, a <= b
                r = np.where(more, np.where(nearer, a, b), r)
                seen = seen + np.where(more, c[np.where(nearer, np.maximum(left, 0), np.minimum(right, n - 1))], 0)
                left, right = left - (more & nearer), right + (more & ~nearer)
            lo, hi = every[0], every[-1]  # what is in other slices lies beyond
            known = ((place - first >= k) & (end - place > k)) | ((x - lo >= r) & (hi - x >= r))
            done = known & (x - r >= lo) & (x + r <= hi)
        at, reach = x[done], r[done]
        upper = np.where(reach == 0, np.searchsorted(every, at, "right"), np.searchsorted(every, at + reach, "left"))
        lower = np.where(reach == 0, np.searchsorted(every, at, "left"), np.searchsorted(every, at - reach, "right"))
        adds = c[done] * (digamma(float(k), np.log) - digamma((below[upper] - below[lower]).astype(float), np.log))
        kept = np.flatnonzero((place - first < 2 * k) | (end - place <= 2 * k) | ~done)
        rows = part.take(order[kept]).append_column("r", pa.array(r[kept], mask=~known[kept])).append_column("asked", pa.array(~done[kept]))
        whole = part.slice(0, 1).select(["f", "slice"]).append_column("total", pa.array([int(below[-1])])).append_column("adds", pa.array([float(adds.sum())]))
        return pa.concat_tables([rows, whole], promote_options="default")

    return run


def reach(d: DataFrame, k: int) -> DataFrame:
    """d(x, c, near, size) with k: as many neighbours as count, and reach: the distance to the last of them."""
    d = d.withColumn("k", F.least(F.lit(k).cast("long"), F.col("size") - 1))
    far = F.array_sort(F.transform("near", lambda p: F.struct(F.abs(p.x - F.col("x")).alias("d"), p.c.alias("c"))))
    start = F.struct((F.col("c") - 1).alias("seen"), F.lit(0.0).alias("r"))
    step = lambda a, p: F.when(a.seen < F.col("k"), F.struct((a.seen + p.c).alias("seen"), p.d.alias("r"))).otherwise(a)
    return d.withColumn("reach", F.aggregate(far, start, step).r).drop("near")


def neighbours(ends: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(f, y, x, c, k, r) of the asked points, by the rows of their class that settled left: at most 4k a slice, and asked ones."""
    order, point = Window.partitionBy("f", "y").orderBy("x"), F.struct("x", "c")
    near = F.concat(F.collect_list(point).over(order.rowsBetween(-k, -1)), F.collect_list(point).over(order.rowsBetween(1, k)))
    asked = ends.withColumn("near", near).where("asked").join(sizes, ["f", "y"])
    return reach(asked, k).select("f", "y", "x", "c", "k", F.coalesce("r", "reach").alias("r"))


def looked_up(asked: pa.Table, part: pa.Table) -> pa.Table:
    """asked(at, upto) of a slice with below: how much of its values lies below a place, or up to it."""
    x, c, at = part["x"].to_numpy(), part["c"].to_numpy(), asked["at"].to_numpy()
    order = np.argsort(x, kind="stable")
    every, below = x[order], np.concatenate([[0], np.cumsum(c[order])]).astype(np.int64)
    found = np.where(asked["upto"].to_numpy(), np.searchsorted(every, at, "right"), np.searchsorted(every, at, "left"))
    return asked.append_column("below", pa.array(below[found]))


def inside(values: DataFrame, points: DataFrame, totals: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """points(f, y, x, c, k, r) with m: how much of values(f, slice, x, c) lies less than r from x, or on x where r is 0."""
    spark, zero = values.sparkSession, F.col("r") == 0
    # up to the upper end less up to the lower one
    ends = F.array(F.struct((F.col("x") + F.col("r")).alias("at"), zero.alias("upto"), F.lit(1).alias("sign")), F.struct((F.col("x") - F.col("r")).alias("at"), (~zero).alias("upto"), F.lit(-1).alias("sign")))
    places = points.select("f", "y", "x", "c", "k", F.explode(ends).alias("e")).select("f", "y", "x", "c", "k", "e.*")
    columns = [f"__a{i}" for i in range(len(cuts))]
    places = sliced(places.withColumns({a: F.when(F.col("f") == i, F.col("at")) for i, a in enumerate(columns)}), columns, cuts).drop(*columns)
    places = places.withColumn("slice", F.get("slices", F.col("f"))).drop("slices")
    every = spark.createDataFrame([(i, s) for i, c in enumerate(cuts) for s in range(len(c) + 1)], "f int, slice int")  # slices without values too
    base = every.join(totals, ["f", "slice"], "left").select("f", "slice", F.coalesce(F.sum("total").over(Window.partitionBy("f").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    schema = ", ".join(f"`{n}` {t}" for n, t in places.dtypes)
    found = places.groupBy("f", "slice").cogroup(values.select("f", "slice", "x", "c").groupBy("f", "slice")).applyInArrow(looked_up, f"{schema}, below long")
    found = found.join(F.broadcast(base), ["f", "slice"])  # a row a slice
    return found.groupBy("f", "y", "x", "c", "k").agg(F.sum(F.col("sign") * (F.col("below") + F.col("base"))).alias("m"))


def neighbour_information(df: DataFrame, features: list[str], label: str, k: int = 3, slices: int | None = None) -> DataFrame:
    """(feature, n, information in nats). Null labels, null and NaN values, and classes of one row are left out of a feature.

    A feature is cut into so many slices, or else into one for every SLICE rows. The input is read three times: for the sizes of
    classes, the cut points and the values.
    """
    columns = [f"x{i}" for i in range(len(features))]
    wide = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), *((F.col(f).cast("double") + 0.0).alias(c) for f, c in zip(features, columns, strict=True)))
    sizes = tall(wide, columns, [[] for _ in columns]).groupBy("f", "y").agg(F.count(F.lit(1)).alias("size")).persist()  # a row a feature and class
    held = [sizes]
    try:
        rows = {r.f: r for r in sizes.groupBy("f").agg(F.sum("size").alias("n"), F.count_if(F.col("size") == 1).alias("alone")).collect()}
        cuts = cut_points(wide, columns, [slices or math.ceil(rows[i].n / SLICE) if i in rows else 1 for i in range(len(columns))])
        values = tall(wide, columns, cuts).groupBy("f", "slice", "y", "x").agg(F.count(F.lit(1)).alias("c"))
        if alone := sum(r.alone for r in rows.values()):
            lone = sizes.where("size = 1").select("f", "y")
            values = values.join(F.broadcast(lone) if alone <= FEW else lone, ["f", "y"], "left_anti").select(values.columns)
        sizes = sizes.where("size > 1")
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(len(c) + 1 for c in cuts))
        values = values.repartition(parts, "f", "slice").persist()  # read for what is inside a slice, and for the rest
        held.append(values)
        schema = ", ".join(f"`{n}` {t}" for n, t in values.dtypes)
        left = values.groupBy("f", "slice").applyInArrow(settled(k), f"{schema}, r double, asked boolean, total long, adds double").persist()  # about 4k rows a slice and class
        held.append(left)
        totals = left.where("total IS NOT NULL")
        m = inside(values, neighbours(left.where("total IS NULL"), sizes, k), totals.select("f", "slice", "total"), cuts)
        none = F.lit(0).cast("long")
        adds = sizes.select("f", F.col("size").alias("n"), (-F.col("size") * psi(F.col("size"))).alias("adds"))
        adds = adds.unionByName(totals.select("f", none.alias("n"), "adds")).unionByName(m.select("f", none.alias("n"), (F.col("c") * (psi(F.col("k")) - psi(F.col("m")))).alias("adds")))
        out = adds.groupBy("f").agg(F.sum("n").alias("n"), F.sum("adds").alias("adds"))
        found = out.select("f", "n", F.greatest(psi(F.col("n")) + F.col("adds") / F.col("n"), F.lit(0.0)).alias("information")).collect()  # a row a feature
    finally:
        for d in held:
            d.unpersist()
    return df.sparkSession.createDataFrame([(features[r.f], r.n, r.information) for r in found], "feature string, n long, information double")
