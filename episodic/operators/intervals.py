"""Joins between readings and intervals, and between intervals.

Every join has series_id and a time bucket as equality keys, so it is a hash or sort-merge join whose
work grows with the rows that meet, and never a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import micros, seconds_between

DAY = 86_400


def bucket(ts: Column, seconds: int = DAY) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def buckets(start: Column, end: Column, seconds: int = DAY) -> Column:
    """All buckets that an interval touches; none if it ends before it starts."""
    return F.when(end >= start, F.sequence(bucket(start, seconds), bucket(end, seconds)))


def effective(intervals: DataFrame) -> DataFrame:
    """Intervals and next_start: where the next one of the series starts, after which no reading belongs to it. Of equal starts the last (by id) wins."""
    w = Window.partitionBy("series_id").orderBy("start_time", "interval_id")
    return intervals.withColumn("next_start", F.lead("start_time").over(w))


def asof_samples(readings: DataFrame, intervals: DataFrame, seconds: int = DAY) -> DataFrame:
    """Readings tagged with the latest-started interval of their series, kept if they are not after its end, and elapsed_min."""
    iv = effective(intervals).withColumn("last", F.least("end_time", F.coalesce("next_start", "end_time")))
    iv = iv.withColumn("bucket", F.explode(buckets(F.col("start_time"), F.col("last"), seconds)))
    iv = iv.withColumnRenamed("series_id", "iv_series").withColumnRenamed("bucket", "iv_bucket")
    r = readings.withColumn("bucket", bucket(F.col("ts"), seconds))
    hit = (r.series_id == iv.iv_series) & (r.bucket == iv.iv_bucket) & (r.ts >= iv.start_time) & (r.ts <= iv.end_time) & (iv.next_start.isNull() | (r.ts < iv.next_start))
    out = r.join(iv, hit).drop("iv_series", "iv_bucket", "bucket", "last", "next_start")
    return out.withColumn("elapsed_min", seconds_between(F.col("start_time"), F.col("ts")) / 60)


def asof_lookup(left: DataFrame, right: DataFrame, at: str, values: list[str]) -> DataFrame:
    """left and the values of the last row of right (series_id, ts) at or before left's time: both sides in one ordered window."""
    a = left.withColumns({"__t": F.col(at), "__side": F.lit(1), "__v": F.lit(None)})
    b = right.select("series_id", F.col("ts").alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__v"))
    both = a.drop("__v").unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy("series_id").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return both.select(*left.columns, *(F.col(f"__v.{v}").alias(v) for v in values))


def overlap_pairs(a: DataFrame, b: DataFrame, seconds: int = DAY) -> DataFrame:
    """Pairs of a(series_id, a_id, a_start, a_end) and b(series_id, b_id, b_start, b_end) that touch, with overlap_s.

    Both sides are dealt to the buckets they touch; a pair counts in the bucket of its later start only.
    """
    x = a.withColumn("bucket", F.explode(buckets(F.col("a_start"), F.col("a_end"), seconds)))
    y = b.withColumn("bucket", F.explode(buckets(F.col("b_start"), F.col("b_end"), seconds)))
    met = x.join(y, ["series_id", "bucket"]).where("a_start <= b_end AND a_end >= b_start")
    met = met.where(F.col("bucket") == bucket(F.greatest("a_start", "b_start"), seconds)).drop("bucket")
    return met.withColumn("overlap_s", seconds_between(F.greatest("a_start", "b_start"), F.least("a_end", "b_end")))


def best_overlap(pairs: DataFrame) -> DataFrame:
    """For each a the b it overlaps most; ties by b's start, then id."""
    w = Window.partitionBy("series_id", "a_id").orderBy(F.col("overlap_s").desc(), "b_start", "b_id")
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def padded_members(readings: DataFrame, intervals: DataFrame, pad_s: float, seconds: int = DAY) -> DataFrame:
    """Every (interval, reading) with the reading inside the interval widened by pad_s on both sides; overlaps allowed."""
    pad = F.expr(f"INTERVAL '{pad_s}' SECOND")
    iv = intervals.withColumns({"lo": F.col("start_time") - pad, "hi": F.col("end_time") + pad})
    iv = iv.withColumn("bucket", F.explode(buckets(F.col("lo"), F.col("hi"), seconds)))
    return readings.withColumn("bucket", bucket(F.col("ts"), seconds)).join(iv, ["series_id", "bucket"]).where("ts BETWEEN lo AND hi").drop("bucket")


def unclaimed(intervals: DataFrame, matched: DataFrame) -> DataFrame:
    """Intervals that no match names."""
    return intervals.join(matched.select("series_id", F.col("b_id").alias("interval_id")).distinct(), ["series_id", "interval_id"], "left_anti")


def span(readings: DataFrame) -> DataFrame:
    """First and last time of each series."""
    return readings.groupBy("series_id").agg(F.min("ts").alias("r0"), F.max("ts").alias("r1"))


def covered(intervals: DataFrame, readings: DataFrame, how: str = "start") -> DataFrame:
    """Intervals by their place to the readings' span: start (starts inside), overlap, before or after."""
    tests = {"start": "start_time BETWEEN r0 AND r1", "overlap": "end_time >= r0 AND start_time <= r1", "before": "end_time < r0", "after": "start_time > r1"}
    return intervals.join(span(readings), "series_id").where(tests[how])
