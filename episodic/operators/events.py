"""Excursions of a signal from its zero baseline: detection, labels, shape features, curves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import from_micros, interpolate, linspace, micros, seconds_between
from .intervals import asof_lookup, asof_samples, best_overlap, overlap_pairs, padded_members, unclaimed
from .windows import absorb_gaps, rolling


def excursions(readings: DataFrame, peak_min: float = 0.1, merge_gap: int = 12) -> DataFrame:
    """(series_id, eid, peak, start_time, end_time): runs off zero, short runs of zeros absorbed, with a peak of at least peak_min."""
    runs = absorb_gaps(readings.select("series_id", "ts", "target"), "target", merge_gap).where("active")
    events = runs.groupBy("series_id", "rid").agg(F.max("target").alias("peak"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time")).where(F.col("peak") >= peak_min)
    eid = F.row_number().over(Window.partitionBy("series_id").orderBy("start_time")).cast("long")
    return events.select("series_id", eid.alias("eid"), "peak", "start_time", "end_time")


def inherit_labels(events: DataFrame, intervals: DataFrame) -> DataFrame:
    """Events with the label of the interval they overlap most, and intervals that no event claims as units of their own."""
    a = events.select("series_id", F.col("eid").alias("a_id"), F.col("start_time").alias("a_start"), F.col("end_time").alias("a_end"))
    b = intervals.select("series_id", F.col("interval_id").alias("b_id"), F.col("start_time").alias("b_start"), F.col("end_time").alias("b_end"), "label")
    pairs = overlap_pairs(a, b)
    best = best_overlap(pairs).select("series_id", F.col("a_id").alias("eid"), F.col("b_id").alias("interval_id"), "label", "overlap_s")
    auto = events.join(best, ["series_id", "eid"], "left").select("series_id", F.format_string("auto#%d", "eid").alias("unit_id"), "start_time", "end_time", "label", F.lit("auto").alias("source"))
    rest = unclaimed(intervals, pairs).select("series_id", F.format_string("label#%d", "interval_id").alias("unit_id"), "start_time", "end_time", "label", F.lit("fallback").alias("source"))
    return auto.unionByName(rest)


def member_rows(events: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings of each event (series_id, eid, ...) with idx, their number from 0."""
    iv = events.select("series_id", F.col("eid").alias("interval_id"), "start_time", "end_time")
    samples = asof_samples(readings, iv).withColumnRenamed("interval_id", "eid")
    w = Window.partitionBy("series_id", "eid").orderBy("ts")
    return samples.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


#: name -> aggregate over an event's rows (columns target, idx, prev, top, and sal, lvl, temp); users may add their own.
FEATURES: dict[str, Callable[[], Column]] = {
    "n_samples": lambda: F.count(F.lit(1)),
    "peak_do": lambda: F.max("target"),
    "mean_do": lambda: F.avg("target"),
    "area": lambda: F.coalesce(F.sum("target"), F.lit(0.0)) * 5 / 60,
    "arg_peak": lambda: F.max_by("idx", F.when(F.col("target").isNotNull(), F.struct("target", -F.col("idx")))),
    "sal_in": lambda: F.avg("sal"),
    "wl_in": lambda: F.avg("lvl"),
    "temp_in": lambda: F.avg("temp"),
    "centroid_frac": lambda: F.when((F.count(F.lit(1)) > 1) & (F.sum("target") != 0), F.sum(F.col("idx") * F.col("target")) / F.sum("target") / (F.count(F.lit(1)) - 1)),
    "plateau_frac": lambda: F.when(F.max("top") > 0, F.avg((F.col("target") >= 0.8 * F.col("top")).cast("double"))),
    "max_rise_norm": lambda: F.when(F.max("top") > 0, F.max(F.col("target") - F.col("prev")) / F.max("top")),
}


def register_feature(name: str, aggregate: Callable[[], Column]) -> None:
    FEATURES[name] = aggregate


def shape_features(members: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """One row per (series_id, eid) with FEATURES, further aggregates by name, and what follows from them; times assume 5-minute readings."""
    w = Window.partitionBy("series_id", "eid")
    d = members.withColumns({"prev": F.lag("target").over(w.orderBy("ts")), "top": F.max("target").over(w)})
    f = d.groupBy("series_id", "eid").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), *(fn().alias(name) for name, fn in FEATURES.items()), *(c.alias(name) for name, c in (more or {}).items()))
    last = F.greatest(F.col("n_samples") - 1, F.lit(1))
    f = f.withColumns({
        "dur_min": F.floor(seconds_between(F.col("start_time"), F.col("end_time")) / 60).cast("long"),
        "peak_frac": F.col("arg_peak") / last,
        "rise_min": F.col("arg_peak") * 5,
        "fall_min": (F.col("n_samples") - 1 - F.col("arg_peak")) * 5,
    })
    rate = lambda c: F.col("peak_do") / F.greatest(F.col(c) / 60, F.lit(0.0833))
    return f.withColumns({"rise_rate": rate("rise_min"), "fall_rate": rate("fall_min")})


def driver_steps(features: DataFrame, readings: DataFrame) -> DataFrame:
    """Precipitation sums and driver means before each event's start, and the drivers' steps into the event."""
    spec = {"precip_24h": ("sum", "precip", 24), "precip_72h": ("sum", "precip", 72), "precip_168h": ("sum", "precip", 168), "sal_pre": ("avg", "sal", 24), "wl_pre": ("avg", "lvl", 24), "temp_pre": ("avg", "temp", 24)}
    context = rolling(readings, spec)
    out = asof_lookup(features, context, "start_time", list(spec))
    return out.withColumns({f"{s}_step": F.col(f"{s}_in") - F.col(f"{s}_pre") for s in ("sal", "wl", "temp")})


def hystereses(members: DataFrame, drivers: dict[str, str], points: int = 10) -> DataFrame:
    """(series_id, eid, a column per name): mean gap between the rising and the falling limb over each scaled driver, all drivers in one shuffle.

    Null if the driver is flat, the peak at an edge or nothing known. Equal driver values are in order of time.
    """
    each = F.inline(F.array(*(F.struct(F.lit(name).alias("driver"), F.col(c).alias("drv")) for name, c in drivers.items())))
    long = members.repartition("series_id", "eid").select("series_id", "eid", "ts", "target", each)
    keys = ("series_id", "eid", "driver")
    known = F.col("target").isNotNull() & F.col("drv").isNotNull()
    w = Window.partitionBy(*keys)
    # rows in which something is unknown stand behind the others and only keep their unit in the result
    d = long.withColumn("known", known).withColumn("idx", F.when(F.col("known"), F.row_number().over(w.orderBy(F.col("known").desc(), "ts")) - 1))
    if_known = lambda c: F.when(F.col("known"), c)
    d = d.withColumns({
        "lo": F.min(if_known(F.col("drv"))).over(w), "hi": F.max(if_known(F.col("drv"))).over(w), "top": F.max(if_known(F.col("target"))).over(w), "n": F.count_if("known").over(w),
        "ap": F.max_by("idx", if_known(F.struct("target", -F.col("idx")))).over(w),
    })
    fit = F.col("known") & (F.col("hi") - F.col("lo") >= 1e-9) & (F.col("ap") >= 1) & (F.col("ap") < F.col("n") - 1)
    point = F.struct(((F.col("drv") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("x"), "idx", (F.col("target") / F.col("top")).alias("y"))
    limb = lambda side: F.sort_array(F.collect_list(F.when(fit & side, point)))
    g = d.groupBy(*keys).agg(limb(F.col("idx") <= F.col("ap")).alias("r"), limb(F.col("idx") >= F.col("ap")).alias("f"))
    at = lambda side, x: interpolate(x, F.transform(side, lambda p: p.x), F.transform(side, lambda p: p.y))
    gaps = F.transform(linspace(F.lit(0.05), F.lit(0.95), points), lambda x: at(F.col("r"), x) - at(F.col("f"), x))
    mean = F.when(F.size("r") > 0, F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / points)
    return g.withColumn("v", mean).groupBy("series_id", "eid").agg(*(F.max(F.when(F.col("driver") == name, F.col("v"))).alias(name) for name in drivers))


def hysteresis(members: DataFrame, driver: str, points: int = 10) -> DataFrame:
    """(series_id, eid, hysteresis) over one driver."""
    return hystereses(members, {"hysteresis": driver}, points)


def curves(readings: DataFrame, intervals: DataFrame, channels: list[str], steps: int = 128, pad_frac: float = 0.5, cap_h: float = 12.0) -> DataFrame:
    """(series_id, interval_id, step, t_min, valid, channels): each interval, widened on both sides, resampled to steps points on straight lines between readings. A channel with fewer than two readings is null; an interval without readings is left out."""
    length = seconds_between(F.col("start_time"), F.col("end_time"))
    pad = (F.least(pad_frac * length, F.lit(cap_h * 3600)) * 1_000_000).cast("long")
    iv = intervals.withColumns({"start_time": from_micros(micros(F.col("start_time")) - pad), "end_time": from_micros(micros(F.col("end_time")) + pad)}).select("series_id", "interval_id", "start_time", "end_time")
    met = padded_members(readings, iv, 0)
    at = micros(F.col("ts")).cast("double")
    lists = [F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(at.alias("x"), F.col(c).alias("y"))))).alias(c) for c in channels]
    g = met.groupBy("series_id", "interval_id", "start_time", "end_time").agg(F.min(at).alias("first"), F.max(at).alias("last"), *lists)
    a, b = micros(F.col("start_time")).cast("double"), micros(F.col("end_time")).cast("double")
    g = g.select("series_id", "interval_id", a.alias("a"), "first", "last", *channels, F.posexplode(linspace(a, b, steps)).alias("step", "x"))
    line = lambda c: F.when(F.size(c) >= 2, interpolate(F.col("x"), F.transform(c, lambda p: p.x), F.transform(c, lambda p: p.y)))
    return g.select("series_id", "interval_id", F.col("step").cast("long").alias("step"), ((F.col("x") - F.col("a")) / 60e6).alias("t_min"), F.col("x").between(F.col("first"), F.col("last")).alias("valid"), *(line(c).alias(c) for c in channels))
