"""Early warning: what is known before an hour, whether an event starts within some hours of it, and how well the one tells the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import heldout as H
from .metrics import average_precision, roc_auc
from .regression import harmonic_fit
from .windows import series

PAST = ["level", "level_rise_6h", "level_rise_24h", "salinity", "salinity_rise_6h", "rain_24h", "rain_72h", "doy_sin", "doy_cos", "year"]
AHEAD = ["tide_max", "tide_rise", "tide_salinity_max"]
LEADS = (6, 12, 24, 48, 72)


def origins(df: DataFrame, event: str, threshold: float, level: str, salinity: str, rain: str, first: int = 168, stride: int = 6, leads: tuple[int, ...] = LEADS) -> DataFrame:
    """df's rows from the first on, one in stride, with PAST and onset_h per lead, of a complete, filled hourly grid.

    PAST ends an hour before the row; an onset of lead h is an hour before the row at or under the threshold and one over it among
    the h hours that begin with the row (fewer at the end of a series).
    """
    w = series()
    ago = lambda c, h: F.lag(c, h).over(w)
    turn = 2 * F.pi() * F.dayofyear("ts") / F.lit(365.25)
    past = [
        ago(level, 1), ago(level, 1) - ago(level, 7), ago(level, 1) - ago(level, 25), ago(salinity, 1), ago(salinity, 1) - ago(salinity, 7),
        F.sum(rain).over(w.rowsBetween(-24, -1)), F.sum(rain).over(w.rowsBetween(-72, -1)), F.sin(turn), F.cos(turn), F.year("ts") + F.dayofyear("ts") / F.lit(365.25),
    ]
    quiet = ago(event, 1) <= threshold
    coming = {f"onset_{h}": (quiet & (F.max(event).over(w.rowsBetween(0, h - 1)) > threshold)).cast("int") for h in leads}
    d = df.withColumns({**dict(zip(PAST, past, strict=True)), **coming, "__i": F.row_number().over(w) - 1})
    return d.where((F.col("__i") >= first) & (F.pmod(F.col("__i") - first, F.lit(stride)) == 0)).drop("__i")


def with_tides(df: DataFrame, level: str, salinity: str, train: Column, leads: tuple[int, ...] = LEADS) -> DataFrame:
    """df with ahead_h per lead: AHEAD for the hours of the lead, from harmonics fitted to the rows of train."""
    w = series()
    d = harmonic_fit(df, level, train).withColumnRenamed("fit", "__l")
    d = harmonic_fit(d, salinity, train).withColumnRenamed("fit", "__s")
    top = lambda c, h: F.max(c).over(w.rowsBetween(0, h - 1))
    out = {f"ahead_{h}": F.array(top("__l", h), top("__l", h) - F.lag("__l").over(w), top("__s", h)) for h in leads}
    return d.withColumns(out).drop("__l", "__s")


def lead_times(df: DataFrame, fold: str, tests: list, event: str, threshold: float, level: str, salinity: str, rain: str, models: dict[str, H.Fit], leads: tuple[int, ...] = LEADS, least: tuple[int, int] = (5, 3), first: int = 168, stride: int = 6) -> DataFrame:
    """(model, lead_h, features, auc, auc_sd, ap, folds, n_onsets): skill per lead and feature set, past only or with the tides ahead.

    For each test value of fold a model is fitted to the rows of lower folds, the tides too; tests with fewer onsets than least in
    training and test rows don't count, and a lead without any test has null scores. All leads' models of a test and set come out
    of one pass of moments; a lead's rows are kept apart by its number.
    """
    spread = None
    for test in tests:
        part = with_tides(df, level, salinity, F.col(fold) < test, leads)
        part = origins(part, event, threshold, level, salinity, rain, first, stride, leads).where(F.col(fold) <= test)
        each = F.inline(F.array(*(F.struct(F.lit(h).cast("long").alias("lead_h"), F.col(f"onset_{h}").cast("long").alias("y"), F.col(f"ahead_{h}").alias("ahead")) for h in leads)))
        part = part.select(F.lit(test).cast("long").alias("test"), (F.col(fold) == test).cast("long").alias("held"), F.array(*(F.col(c).cast("double") for c in PAST)).alias("past"), each)
        spread = part if spread is None else spread.unionByName(part)
    rows = spread.withColumn("both", F.concat("past", "ahead")).withColumn("run", F.col("test") * 1000 + F.col("lead_h")).persist()  # read by both sets' fits and scores
    counted = rows.groupBy("run").agg(F.sum(F.when(F.col("held") == 0, F.col("y"))).alias("a"), F.sum(F.when(F.col("held") == 1, F.col("y"))).alias("b"))
    enough = counted.where((F.col("a") >= least[0]) & (F.col("b") >= least[1])).select("run")
    used = rows.join(F.broadcast(enough), "run")  # a row per test and lead
    keys = ["model", "lead_h", "test"]
    parts = []
    for name, x in (("past only", "past"), ("with tides", "both")):
        fits = H.fitted(used, x, "y", "held", models, "run")
        p = H.predictions(used.where("held = 1"), x, "held", fits, "run")
        p = p.select(*keys, "y", F.get("probability", F.array_position("classes", F.lit(1).cast("long")).cast("int") - 1).alias("p"))
        s = roc_auc(p, "y", "p", keys).join(average_precision(p, "y", "p", keys), keys)
        parts.append(s.groupBy("model", "lead_h").agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("auc_sd"), F.avg("ap").alias("ap"), F.count("auc").alias("folds")).withColumn("features", F.lit(name)))
    scored = reduce(DataFrame.unionByName, parts)
    onsets = origins(df, event, threshold, level, salinity, rain, first, stride, leads)
    onsets = onsets.agg(*(F.sum(f"onset_{h}").alias(f"n{h}") for h in leads))
    grid = onsets.select(F.inline(F.array(*(F.struct(F.lit(h).cast("long").alias("lead_h"), F.coalesce(F.col(f"n{h}"), F.lit(0)).alias("n_onsets")) for h in leads))))
    grid = grid.select("*", F.explode(F.array(*(F.lit(m) for m in models))).alias("model")).select("*", F.explode(F.array(F.lit("past only"), F.lit("with tides"))).alias("features"))
    out = grid.join(scored, ["model", "lead_h", "features"], "left")
    return out.select("model", "lead_h", "features", "auc", "auc_sd", "ap", F.coalesce("folds", F.lit(0)).alias("folds"), "n_onsets")
