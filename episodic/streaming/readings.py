"""Streaming forms of the batch roll-up and of the keep-first dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(stream: DataFrame, width: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Means of levels and sums of fluxes per series and window of ts, once no row can be later than the watermark; late None: the stream has one."""
    w = (stream.withWatermark("ts", late) if late else stream).groupBy("series_id", F.window("ts", width))
    return w.agg(F.avg("lvl").alias("lvl"), F.sum("precip").alias("precip")).select("series_id", F.col("window.start").alias("bin"), "lvl", "precip")


def deduplicated(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first row of each series and time, within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["series_id", "ts"])
