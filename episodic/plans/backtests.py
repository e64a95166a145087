"""Queries of forecasts over several channels and weeks, with event-aware scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecasting as P
from ..operators import windows as W
from .registry import query, rounded
from .tables import GRID

PAST, STEPS, STRIDE, EVENT = 48, 72, 6, 200.0
#: The steps that boosted models are trained for.
ANCHORS = [0, 5, 11, 17, 23, 35, 47, 59, 71]


def filled(readings):
    d = W.forward_fill(W.complete_grid(readings), {"lvl": 50.0, "sal": 50.0, "temp": 50.0, "precip": 0.0, "target": 0.0})
    turn = 2 * F.pi() * F.hour("ts") / 24
    return d.withColumns({"hour_sin": F.sin(turn), "hour_cos": F.cos(turn)})


def week(column):
    return F.weekofyear(column).cast("long")


def origins(readings):
    d = P.origins(filled(readings), ["lvl", "sal", "temp", "precip", "hour_sin", "hour_cos"], "lvl", PAST, STEPS, STRIDE)
    return d.withColumn("fold", week("origin"))


def scored(readings, forecasts):
    return P.event_scores(forecasts, P.train_scale(filled(readings), "lvl", week("ts")), EVENT)


FILLED = GRID + """, f AS (SELECT series_id, ts, weekofyear(ts) AS wk, coalesce(last_value(lvl IGNORE NULLS) OVER w, 50.0) AS v, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM gc WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING))"""
ORIGINS = f"o AS (SELECT series_id, ts AS origin, wk AS fold, i FROM f WHERE i >= {PAST} AND i + {STEPS} <= n AND (i - {PAST}) % {STRIDE} = 0)"


@query("readings", sql=f"""WITH {FILLED}, {ORIGINS},
h AS (SELECT o.series_id, o.origin, x.i - o.i + {PAST} AS p, x.v FROM o JOIN f x ON x.series_id = o.series_id AND x.i BETWEEN o.i - {PAST} AND o.i - 1),
t AS (SELECT a.series_id, a.origin, a.p, any_value(a.v) AS v, sum(b.v) / 25 AS trend FROM h a JOIN range(-12, 13) AS k(d) ON true JOIN h b ON b.series_id = a.series_id AND b.origin = a.origin AND b.p = least(greatest(a.p + d, 0), {PAST - 1}) GROUP BY 1, 2, 3)
SELECT series_id, origin, round(sum(trend), 4) AS trend_sum, round(max(trend), 4) AS trend_max, round(sum(abs(v - trend)), 4) AS remainder_abs, round(max(CASE WHEN p = {PAST - 1} THEN trend END), 4) AS trend_last FROM t GROUP BY 1, 2""")
def trend_remainder(readings):
    """Moving average and remainder of each origin's past."""
    d = P.decomposed(origins(readings), "lvl")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return rounded(d.select("series_id", "origin", add("trend").alias("trend_sum"), F.array_max("trend").alias("trend_max"), add(F.transform("remainder", F.abs)).alias("remainder_abs"), F.element_at("trend", -1).alias("trend_last")), 4)


@query("readings", sql=f"""WITH {FILLED}, {ORIGINS},
y AS (SELECT o.*, x.i - o.i AS k, x.v AS y FROM o JOIN f x ON x.series_id = o.series_id AND x.i BETWEEN o.i AND o.i + {STEPS - 1}),
p AS (SELECT y.*, 'persistence' AS model, l.v AS p FROM y JOIN f l ON l.series_id = y.series_id AND l.i = y.i - 1 UNION ALL SELECT y.*, 'seasonal', l.v FROM y JOIN f l ON l.series_id = y.series_id AND l.i = y.i - 24 + k % 24),
w AS (SELECT model, fold, series_id, origin, sum(pow(p - y, 2)) AS sq, sum(abs(p - y)) AS ab, count(*) AS n, abs(max(p) - max(y)) AS peak, sum(pow(p - y, 2)) FILTER (WHERE k = {STEPS - 1}) AS last, max(y) > {EVENT} AS active FROM p GROUP BY 1, 2, 3, 4),
d AS (SELECT wk AS fold, sum(d) AS s, count(d) AS n FROM (SELECT wk, abs(v - lag(v, 24) OVER (PARTITION BY series_id ORDER BY i)) AS d FROM f) GROUP BY 1),
c AS (SELECT fold, sum(s) OVER b / sum(n) OVER b AS scale FROM d WINDOW b AS (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT model, fold, sqrt(sum(sq) / sum(n)) AS rmse, sqrt(sum(sq) FILTER (WHERE active) / sum(n) FILTER (WHERE active)) AS event_rmse, sqrt(sum(sq) FILTER (WHERE NOT active) / sum(n) FILTER (WHERE NOT active)) AS quiescent_rmse,
  CAST(count(*) FILTER (WHERE active) AS DOUBLE) AS n_event_windows, avg(peak) AS peak_mae, sum(ab) / sum(n) AS mae, sqrt(avg(last)) AS rmse_last FROM w GROUP BY 1, 2),
s AS (SELECT model, fold, unnest([{", ".join(f"{{'metric': '{m}', 'value': {m if m != 'mase' else 'mae / scale'}}}" for m in P.EVENT_SCORES)}]) AS m FROM g JOIN c USING (fold))
SELECT model, m.metric AS metric, round(avg(m.value), 4) AS mean, round(stddev_pop(m.value), 4) AS std, count(m.value) AS folds FROM s GROUP BY 1, 2""")
def naive_event_scores(readings):
    """All eight scores of the two naive forecasts, mean and deviation over weeks."""
    return rounded(P.over_folds(scored(readings, P.naive(origins(readings), "lvl", STEPS))), 4)


#: Inputs of the nested sets: the target alone, then calendar, weather and water besides.
ABLATION = {"target": ["lvl"], "calendar": ["lvl", "hour_sin", "hour_cos"], "weather": ["lvl", "hour_sin", "hour_cos", "temp", "precip"], "all": ["lvl", "hour_sin", "hour_cos", "temp", "precip", "sal"]}


@query("readings")
def covariate_ablation(readings):
    """Ridge on nested sets of inputs, all solved from one matrix of products a week."""
    forecasts = P.linear_backtest(origins(readings), ABLATION)
    wanted = P.over_folds(scored(readings, forecasts)).where(F.col("metric").isin("event_rmse", "peak_mae", "rmse"))
    return rounded(wanted.groupBy(F.col("model").alias("inputs")).pivot("metric", ["event_rmse", "peak_mae", "rmse"]).agg(F.first(F.struct("mean", "std"))).select("inputs", *(F.col(f"{m}.{v}").alias(f"{m}_{v}") for m in ("event_rmse", "peak_mae", "rmse") for v in ("mean", "std"))), 4)


@query("readings")
def decomposition_linear(readings):
    """Trend, remainder and the last step's covariates in one joint linear model, beside ridge on the raw past."""
    d = P.decomposed(origins(readings), "lvl").withColumn("now", F.array(*(F.element_at(c, -1) for c in ("sal", "temp", "precip", "hour_sin", "hour_cos"))))
    return rounded(P.over_folds(scored(readings, P.linear_backtest(d, {"decomposition": ["trend", "remainder", "now"], "ridge": ["lvl"]}))), 4)


@query("readings")
def boosted_horizons(readings):
    """All steps of the last week with a future, from trees trained for nine anchors on the weeks before."""
    d = origins(readings)
    last = d.agg(F.max("fold")).first()[0]
    made = P.boosted_anchors(d.where(F.col("fold") < last), d.where(F.col("fold") == last), "lvl", ANCHORS, STEPS)
    return rounded(P.over_folds(scored(readings, made.withColumn("model", F.lit("boosted")))), 4)
