"""Queries of harmonic fits, spectra, forecasts and early warning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import heldout as H
from ..operators import metrics as M
from ..operators import models as D
from ..operators import onsets as O
from ..operators import regression as G
from ..operators import spectra as P
from ..operators import windows as W
from .registry import query, rounded
from .series import GRID
from .tables import _filled, forecast_score


@query("readings")
def harmonic_fit(readings):
    half = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return rounded(G.explained(G.harmonic_fit(readings, "lvl", half), "lvl"))


@query("readings")
def variance_bands(readings):
    return rounded(G.variance_bands(readings, "lvl"))


SPECTRAL = ["lvl", "sal", "temp", "target"]
_filled_sql = lambda c: f"""SELECT series_id, '{c}' AS variable, ts, coalesce({c}, pv + (nv - pv) * epoch(ts - pt) / epoch(nt - pt), pv, nv) AS v FROM (SELECT series_id, ts, {c}, last_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS pt, last_value({c} IGNORE NULLS) OVER w AS pv,
 first_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER f AS nt, first_value({c} IGNORE NULLS) OVER f AS nv FROM gc WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""  # noqa: E731


@query("readings", sql=f"""WITH {GRID}, v AS ({" UNION ALL ".join(_filled_sql(c) for c in SPECTRAL)}),
x AS (SELECT series_id, variable, v - avg(v) OVER p AS v, row_number() OVER (PARTITION BY series_id, variable ORDER BY ts) - 1 AS i, count(*) OVER p AS n FROM v WINDOW p AS (PARTITION BY series_id, variable)),
q AS (SELECT series_id, variable, n, k, pow(sum(coalesce(v, 0) * cos(2 * pi() * ((i * k) % n) / n)), 2) + pow(sum(coalesce(v, 0) * sin(2 * pi() * ((i * k) % n) / n)), 2) AS power FROM (SELECT *, unnest(range(1, n // 2 + 1)) AS k FROM x) GROUP BY ALL),
b AS (SELECT series_id, variable, round(log10(k * 24.0::DOUBLE / n) * 120) AS bin, median(k * 24.0::DOUBLE / n) AS freq, max(power) AS power FROM q WHERE k * 24.0::DOUBLE / n BETWEEN 1 / 2000.0 AND 48 GROUP BY 1, 2, 3)
SELECT series_id, variable, round(freq, 5) AS freq, round(power / max(power) OVER (PARTITION BY series_id, variable), 5) + 0.0 AS power FROM b""")
def log_bin_spectrum(readings):
    """Spectra of four channels of each series on the complete grid, gaps on straight lines."""
    filled = reduce(W.interpolate_gaps, SPECTRAL, W.complete_grid(readings))
    return rounded(P.periodogram(filled.select("series_id", "ts", *SPECTRAL), SPECTRAL, 24))


def folds(readings):
    """Origins with the week they fall in."""
    h = W.histories(_filled(readings), "lvl", 48, 12, 6)
    return h.withColumn("fold", F.weekofyear("origin").cast("long"))


@query("readings")
def ridge_backtest(readings):
    """Scores per test week, each from a model of the weeks before it; weeks are a bounded set."""
    d = folds(readings)
    weeks = [r.fold for r in d.select("fold").distinct().orderBy("fold").collect()]
    out = [forecast_score(G.ridge_forecast(d.where(F.col("fold") < f), d.where(F.col("fold") == f))).withColumn("fold", F.lit(f).cast("long")) for f in weeks[1:]]
    scored = reduce(lambda a, b: a.unionByName(b), out)
    return rounded(scored.groupBy("fold").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.count(F.lit(1)).alias("n")), 4)


@query("readings")
def model_ranking(readings):
    """Persistence, seasonal naive and ridge by mean error over one split."""
    d = folds(readings)
    cut = d.agg(F.max("fold")).first()[0]
    test = d.where(F.col("fold") == cut)
    models = {
        "persistence": test.withColumn("forecast", F.array_repeat(F.element_at("history", -1), 12)),
        "seasonal": test.withColumn("forecast", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.get("history", 24 + k % 24))),
        "ridge": G.ridge_forecast(d.where(F.col("fold") < cut), test),
    }
    rows = [forecast_score(m).agg(F.avg("rmse").alias("rmse")).withColumn("model", F.lit(k)) for k, m in models.items()]
    return rounded(reduce(lambda a, b: a.unionByName(b), rows).orderBy("rmse"), 4)


@query("readings")
def forecast_vs_actual(readings):
    """One origin's horizon, step by step: the window with the highest peak."""
    d = folds(readings).withColumn("peak", F.array_max("future"))
    best = d.agg(F.max_by(F.struct("series_id", "origin", "history", "future"), F.struct("peak", "series_id", "origin")).alias("b")).select("b.*")
    p = F.element_at("history", -1)
    return rounded(best.select("series_id", "origin", F.posexplode("future").alias("step", "actual"), p.alias("forecast")))


@query("readings")
def lead_time_skill(readings):
    """Area under the curve and average precision of onset by lead time, from a logistic model of the rows up to the median time; features end an hour before the label's hours."""
    d = _filled(readings)
    w, v = W.series(), F.col("lvl")
    ago = lambda h: F.lag(v, h).over(w)
    base = d.withColumns({"lvl_1": ago(1), "rise_6h": F.coalesce(ago(1) - ago(7), F.lit(0.0)), "rise_24h": F.coalesce(ago(1) - ago(25), F.lit(0.0)), "quiet": ago(1) <= 60})
    middle = d.agg(F.percentile_approx("ts", 0.5, 1_000_000)).first()[0]
    half = F.col("ts") <= F.lit(str(middle)).cast("timestamp_ntz")
    out = []
    for h in (6, 12, 24, 48, 72):
        x = base.withColumn("y", (F.max(v).over(w.rowsBetween(0, h - 1)) > 60).cast("int")).where("quiet")
        x = D.matrix(x.withColumn("cls", F.when(F.col("y") == 1, "onset").otherwise("calm")), ["lvl_1", "rise_6h", "rise_24h"], "cls")
        train = D.balanced(x.where(half))
        if train.select("label").distinct().count() < 2:
            continue
        s = D.logistic(1.0)(train).fit(train).transform(x.where(~half)).select("y", F.get(D.vector_to_array("probability"), F.lit(1)).alias("p"), F.lit(h).cast("long").alias("lead_h"))
        out.append(M.roc_auc(s, "y", "p", ["lead_h"]).join(M.average_precision(s, "y", "p", ["lead_h"]), "lead_h"))
    if not out:
        return readings.sparkSession.createDataFrame([], "lead_h long, auc double, ap double")
    return rounded(reduce(lambda a, b: a.unionByName(b), out), 4)


EVENT_OVER = 20.0


def hours(readings):
    """The complete grid, filled from the past, with the week as fold."""
    return W.causal_fill(W.complete_grid(readings), ["lvl", "sal"], ["target", "precip"]).withColumn("fold", F.weekofyear("ts").cast("long"))


CHANNELS = {"event": "target", "threshold": EVENT_OVER, "level": "lvl", "salinity": "sal", "rain": "precip"}


@query("readings", sql=f"""WITH {GRID}, f AS (SELECT series_id, ts, coalesce(last_value(lvl IGNORE NULLS) OVER w, (SELECT median(lvl) FROM readings)) AS lvl, coalesce(last_value(sal IGNORE NULLS) OVER w, (SELECT median(sal) FROM readings)) AS sal,
  coalesce(last_value(target IGNORE NULLS) OVER w, 0.0) AS target, coalesce(last_value(precip IGNORE NULLS) OVER w, 0.0) AS precip, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i FROM gc WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
o AS (SELECT series_id, ts, i, lag(lvl) OVER w AS level, lag(lvl) OVER w - lag(lvl, 7) OVER w AS level_rise_6h, lag(lvl) OVER w - lag(lvl, 25) OVER w AS level_rise_24h, lag(sal) OVER w AS salinity, lag(sal) OVER w - lag(sal, 7) OVER w AS salinity_rise_6h,
  sum(precip) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS rain_24h, sum(precip) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING) AS rain_72h,
  sin(2 * pi() * dayofyear(ts) / 365.25::DOUBLE) AS doy_sin, cos(2 * pi() * dayofyear(ts) / 365.25::DOUBLE) AS doy_cos, year(ts) + dayofyear(ts) / 365.25::DOUBLE AS year,
  {", ".join(f"CAST(lag(target) OVER w <= {EVENT_OVER} AND max(target) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING) > {EVENT_OVER} AS INT) AS onset_{h}" for h in O.LEADS)} FROM f WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, ts, {", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in O.PAST)}, {", ".join(f"onset_{h}" for h in O.LEADS)} FROM o WHERE i >= 168 AND (i - 168) % 6 = 0""")
def onset_inputs(readings):
    """What is known an hour before every sixth hour, and whether an event starts within each lead time."""
    return rounded(O.origins(hours(readings), **CHANNELS).select("series_id", "ts", *O.PAST, *(f"onset_{h}" for h in O.LEADS)))


@query("readings")
def lead_time_table(readings):
    """Skill at all lead times, from the past only and with the tides ahead, over the last three weeks, each foretold from the weeks before it."""
    d = hours(readings)
    weeks = sorted(r.fold for r in d.select("fold").distinct().collect())[-3:]  # weeks are a bounded set
    return rounded(O.lead_times(d, "fold", weeks, models={"ridge": H.ridge(), "lda": H.lda()}, **CHANNELS), 4)
