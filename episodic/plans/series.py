"""Queries over readings, intervals and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import events as E
from ..operators import intervals as I
from ..operators import windows as W
from ..operators.quantiles import exact_quantiles
from .registry import query, rounded

GAP, PEAK = 2, 0.1

DETECT = f"""r AS (SELECT *, target <> 0 AS on_ FROM readings),
c AS (SELECT *, CASE WHEN on_ = lag(on_) OVER (PARTITION BY series_id ORDER BY ts) THEN 0 ELSE 1 END AS ch FROM r),
d AS (SELECT *, sum(ch) OVER (PARTITION BY series_id ORDER BY ts) AS g FROM c),
a AS (SELECT *, CASE WHEN on_ IS NULL THEN NULL ELSE on_ OR count(*) OVER (PARTITION BY series_id, g) <= {GAP} END AS act FROM d),
c2 AS (SELECT *, CASE WHEN act = lag(act) OVER (PARTITION BY series_id ORDER BY ts) THEN 0 ELSE 1 END AS ch2 FROM a),
d2 AS (SELECT *, sum(ch2) OVER (PARTITION BY series_id ORDER BY ts) AS g2 FROM c2),
ev0 AS (SELECT series_id, g2, max(target) AS peak, min(ts) AS start_time, max(ts) AS end_time FROM d2 WHERE act GROUP BY 1, 2 HAVING max(target) >= {PEAK}),
ev AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY start_time) AS eid, peak, start_time, end_time FROM ev0)"""
MEMBERS = DETECT + """,
nx AS (SELECT *, lead(start_time) OVER (PARTITION BY series_id ORDER BY start_time, eid) AS nxt FROM ev),
mem AS (SELECT readings.*, eid, start_time, end_time, row_number() OVER (PARTITION BY readings.series_id, eid ORDER BY ts) - 1 AS idx
  FROM readings JOIN nx ON readings.series_id = nx.series_id AND ts >= start_time AND ts <= end_time AND (nxt IS NULL OR ts < nxt))"""
PAIRS = DETECT + """,
pr AS (SELECT ev.series_id, eid, ev.start_time, iv.interval_id, iv.start_time AS b_start, label,
  epoch(least(ev.end_time, iv.end_time) - greatest(ev.start_time, iv.start_time)) AS overlap_s
  FROM ev JOIN iv ON ev.series_id = iv.series_id AND ev.start_time <= iv.end_time AND ev.end_time >= iv.start_time),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, eid ORDER BY overlap_s DESC, b_start, interval_id) AS rn FROM pr) WHERE rn = 1)"""


@query("readings", sql=f"WITH {DETECT} SELECT series_id, eid, round(peak, 5) AS peak, start_time, end_time FROM ev")
def excursion_detect(readings):
    return rounded(E.excursions(readings, PEAK, GAP))


@query("readings", "iv", sql=f"""WITH {PAIRS}
SELECT ev.series_id, 'auto#' || ev.eid AS unit_id, ev.start_time, end_time, label, 'auto' AS source FROM ev LEFT JOIN be ON ev.series_id = be.series_id AND ev.eid = be.eid
UNION ALL SELECT series_id, 'label#' || interval_id, start_time, end_time, label, 'fallback' FROM iv WHERE interval_id NOT IN (SELECT interval_id FROM pr)""")
def label_inheritance(readings, iv):
    return E.inherit_labels(E.excursions(readings, PEAK, GAP), iv)


@query("readings", "iv", sql=f"WITH {PAIRS} SELECT series_id, eid, interval_id, overlap_s FROM pr")
def overlap_pairs(readings, iv):
    return _pairs(readings, iv).select("series_id", F.col("a_id").alias("eid"), F.col("b_id").alias("interval_id"), "overlap_s")


def _pairs(readings, iv):
    a = E.excursions(readings, PEAK, GAP).select("series_id", F.col("eid").alias("a_id"), F.col("start_time").alias("a_start"), F.col("end_time").alias("a_end"))
    b = iv.select("series_id", F.col("interval_id").alias("b_id"), F.col("start_time").alias("b_start"), F.col("end_time").alias("b_end"), "label")
    return I.overlap_pairs(a, b)


@query("readings", "iv", sql=f"WITH {PAIRS} SELECT series_id, eid, interval_id, label, overlap_s FROM be")
def best_overlap_label(readings, iv):
    return I.best_overlap(_pairs(readings, iv)).select("series_id", F.col("a_id").alias("eid"), F.col("b_id").alias("interval_id"), "label", "overlap_s")


@query("readings", "iv", sql=f"WITH {PAIRS} SELECT series_id, interval_id, label FROM iv WHERE interval_id NOT IN (SELECT interval_id FROM pr)")
def unclaimed_fallback(readings, iv):
    return I.unclaimed(iv, _pairs(readings, iv)).select("series_id", "interval_id", "label")


@query("readings", "iv", sql="""SELECT r.series_id, r.ts, interval_id, label, epoch(r.ts - start_time) / 60 AS elapsed_min FROM readings r
ASOF JOIN (SELECT series_id, start_time, last(interval_id ORDER BY interval_id) AS interval_id, last(label ORDER BY interval_id) AS label, last(end_time ORDER BY interval_id) AS end_time FROM iv GROUP BY 1, 2) i
ON r.series_id = i.series_id AND r.ts >= i.start_time WHERE r.ts <= end_time""")
def asof_samples(readings, iv):
    return I.asof_samples(readings, iv).select("series_id", "ts", "interval_id", "label", "elapsed_min")


@query("iv", "readings", sql="""SELECT iv.series_id, interval_id, round(lvl, 5) AS lvl, round(sal, 5) AS sal FROM iv ASOF LEFT JOIN readings r ON iv.series_id = r.series_id AND iv.start_time >= r.ts""")
def asof_context_lookup(iv, readings):
    return rounded(I.asof_lookup(iv, readings, "start_time", ["lvl", "sal"]).select("series_id", "interval_id", "lvl", "sal"))


@query("readings", "iv", sql="""SELECT iv.series_id, interval_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM iv JOIN readings r
ON iv.series_id = r.series_id AND ts BETWEEN start_time - INTERVAL 2 HOUR AND end_time + INTERVAL 2 HOUR GROUP BY 1, 2""")
def padded_window_members(readings, iv):
    return I.padded_members(readings, iv, 7200).groupBy("series_id", "interval_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("iv", "moments", sql="""SELECT i.series_id, interval_id, row_number() OVER (PARTITION BY i.series_id, interval_id ORDER BY greatest(m.start_time, i.start_time), parent_id, moment_idx) AS segment,
parent_id, moment_idx, greatest(m.start_time, i.start_time) AS seg_start, least(m.end_time, i.end_time) AS seg_end
FROM iv i JOIN moments m ON i.series_id = m.series_id AND i.start_time <= m.end_time AND i.end_time >= m.start_time""")
def clip_segments(iv, moments):
    a = iv.select("series_id", F.col("interval_id").alias("a_id"), F.col("start_time").alias("a_start"), F.col("end_time").alias("a_end"))
    b = moments.select("series_id", F.col("parent_id").alias("b_id"), "moment_idx", F.col("start_time").alias("b_start"), F.col("end_time").alias("b_end"))
    d = I.overlap_pairs(a, b).withColumns({"seg_start": F.greatest("a_start", "b_start"), "seg_end": F.least("a_end", "b_end")})
    w = Window.partitionBy("series_id", "a_id").orderBy("seg_start", "b_id", "moment_idx")
    return d.select("series_id", F.col("a_id").alias("interval_id"), F.row_number().over(w).cast("long").alias("segment"), F.col("b_id").alias("parent_id"), "moment_idx", "seg_start", "seg_end")


SPAN = "sp AS (SELECT series_id, min(ts) AS r0, max(ts) AS r1 FROM readings GROUP BY 1)"


@query("readings", "iv", sql=f"WITH {SPAN} SELECT series_id, interval_id FROM iv JOIN sp USING (series_id) WHERE start_time BETWEEN r0 AND r1")
def coverage_filter(readings, iv):
    return I.covered(iv, readings, "start").select("series_id", "interval_id")


@query("readings", "iv", sql=f"WITH {SPAN} SELECT series_id, interval_id FROM iv JOIN sp USING (series_id) WHERE end_time >= r0 AND start_time <= r1")
def overlap_filter(readings, iv):
    return I.covered(iv, readings, "overlap").select("series_id", "interval_id")


@query("readings", "iv", sql="""WITH sp AS (SELECT series_id, min(ts) + INTERVAL 5 DAY AS r0, max(ts) - INTERVAL 5 DAY AS r1 FROM readings GROUP BY 1),
o AS (SELECT series_id, interval_id, start_time, end_time, CASE WHEN end_time < r0 THEN 'before' ELSE 'after' END AS side FROM iv JOIN sp USING (series_id) WHERE end_time < r0 OR start_time > r1)
SELECT series_id, side, count(*) AS n, min(start_time) AS band_start, max(end_time) AS band_end, CAST(floor(epoch(max(end_time) - min(start_time)) / 86400) AS BIGINT) AS days, min(start_time) + (max(end_time) - min(start_time)) / 2 AS mid FROM o GROUP BY 1, 2""")
def gap_bands(readings, iv):
    trimmed = I.span(readings).selectExpr("series_id", "r0 + INTERVAL '5' DAY AS r0", "r1 - INTERVAL '5' DAY AS r1")
    ends = trimmed.select("series_id", F.col("r0").alias("ts")).unionByName(trimmed.select("series_id", F.col("r1").alias("ts")))
    both = I.covered(iv, ends, "before").withColumn("side", F.lit("before")).unionByName(I.covered(iv, ends, "after").withColumn("side", F.lit("after")))
    return both.groupBy("series_id", "side").agg(F.count(F.lit(1)).alias("n"), F.min("start_time").alias("band_start"), F.max("end_time").alias("band_end"), F.floor(S.seconds_between(F.min("start_time"), F.max("end_time")) / 86400).cast("long").alias("days"), S.from_micros(F.floor((S.micros(F.min("start_time")) + S.micros(F.max("end_time"))) / 2).cast("long")).alias("mid"))


@query("readings", "iv", sql=f"""WITH {SPAN} SELECT iv.series_id, interval_id, start_time BETWEEN r0 AND r1 AS is_covered, label || ' ' || interval_id || CASE WHEN start_time BETWEEN r0 AND r1 THEN '' ELSE ' *' END AS display,
row_number() OVER (PARTITION BY iv.series_id ORDER BY start_time, interval_id) AS ord FROM iv JOIN sp USING (series_id)""")
def coverage_marker(readings, iv):
    seen = I.covered(iv, readings).select("series_id", "interval_id", F.lit(True).alias("is_covered"))
    d = iv.join(seen, ["series_id", "interval_id"], "left").withColumn("is_covered", F.coalesce("is_covered", F.lit(False)))
    w = Window.partitionBy("series_id").orderBy("start_time", "interval_id")
    return d.select("series_id", "interval_id", "is_covered", F.concat("label", F.lit(" "), F.col("interval_id").cast("string"), F.when(F.col("is_covered"), "").otherwise(" *")).alias("display"), F.row_number().over(w).cast("long").alias("ord"))


ROLL = {"precip_24h": ("sum", "precip", 24), "precip_72h": ("sum", "precip", 72), "precip_168h": ("sum", "precip", 168), "sal_24h": ("avg", "sal", 24)}


@query("readings", sql="SELECT series_id, ts, " + ", ".join(f"round({f}({c}) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL {h * 3600 - 1} SECOND PRECEDING AND CURRENT ROW), 5) AS {n}" for n, (f, c, h) in ROLL.items()) + " FROM readings")
def rolling_24_72_168(readings):
    return rounded(W.rolling(readings, ROLL).select("series_id", "ts", *ROLL))


@query("readings", sql=f"WITH {DETECT} SELECT series_id, g AS rid, count(*) AS n, round(max(target), 5) AS top, min(ts) AS first_ts FROM d GROUP BY 1, 2")
def run_lengths(readings):
    d = W.run_ids(readings, F.col("target") != 0)
    return rounded(d.groupBy("series_id", "rid").agg(F.count(F.lit(1)).alias("n"), F.max("target").alias("top"), F.min("ts").alias("first_ts")))


@query("readings", sql=f"WITH {DETECT} SELECT series_id, g2 AS rid, bool_and(act) AS active, count(*) AS n, min(ts) AS run_start, max(ts) AS run_end FROM d2 GROUP BY 1, 2")
def run_summary(readings):
    d = W.absorb_gaps(readings, "target", GAP)
    return d.groupBy("series_id", "rid").agg(F.bool_and("active").alias("active"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("run_start"), F.max("ts").alias("run_end"))


@query("readings", sql=f"WITH {DETECT} SELECT series_id, g2 AS rid, round(max(target), 5) AS peak FROM d2 WHERE act GROUP BY 1, 2 HAVING max(target) >= 20")
def peak_having(readings):
    d = W.absorb_gaps(readings, "target", GAP).where("active")
    return rounded(d.groupBy("series_id", "rid").agg(F.max("target").alias("peak")).where("peak >= 20"))


@query("readings", sql="""WITH x AS (SELECT *, floor((row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1) * 50 / greatest(count(*) OVER (PARTITION BY series_id), 50)) AS b FROM readings)
SELECT series_id, CAST(b AS BIGINT) AS bin, min(ts) AS ts, round(avg(target), 5) AS target, round(avg(lvl), 5) AS lvl, round(coalesce(sum(precip), 0), 5) AS precip FROM x GROUP BY 1, 2""")
def downsample_bins(readings):
    return rounded(W.downsample(readings, 50, ["target", "lvl"], ["precip"]))


GRID = """gr AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM readings GROUP BY 1),
gc AS (SELECT gr.series_id, gr.ts, target, sal, lvl, temp, precip FROM gr LEFT JOIN readings r ON gr.series_id = r.series_id AND gr.ts = r.ts)"""


@query("readings", sql=f"WITH {GRID} SELECT series_id, ts, round(target, 5) AS target, round(precip, 5) AS precip FROM gc")
def gap_complete_grid(readings):
    return rounded(W.complete_grid(readings).select("series_id", "ts", "target", "precip"))


@query("readings", sql=f"""WITH {GRID},
p AS (SELECT *, last_value(CASE WHEN lvl IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS pt, last_value(lvl IGNORE NULLS) OVER w AS pv,
 first_value(CASE WHEN lvl IS NOT NULL THEN ts END IGNORE NULLS) OVER f AS nt, first_value(lvl IGNORE NULLS) OVER f AS nv FROM gc
 WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, ts, round(coalesce(lvl, pv + (nv - pv) * epoch(ts - pt) / epoch(nt - pt), pv, nv), 5) AS lvl FROM p""")
def upsample_interpolate(readings):
    return rounded(W.interpolate_gaps(W.complete_grid(readings), "lvl").select("series_id", "ts", "lvl"))


FRAME = """fr AS (SELECT series_id, ts, target, sal, lvl, temp, precip, CAST(target IS NULL AS INT) AS target_missing, CAST(lvl IS NULL AS INT) AS lvl_missing, CAST(precip IS NULL AS INT) AS precip_missing,
 lvl IS NOT NULL AND sal IS NOT NULL AND temp IS NOT NULL AS covar_valid, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
 sin(2 * pi() * dayofyear(ts) / 365.25::DOUBLE) AS doy_sin, cos(2 * pi() * dayofyear(ts) / 365.25::DOUBLE) AS doy_cos FROM gc)"""


def frame(readings):
    g = W.complete_grid(readings)
    missing = {f"{c}_missing": F.col(c).isNull().cast("int") for c in ("target", "lvl", "precip")}
    return g.withColumns(missing | {"covar_valid": F.col("lvl").isNotNull() & F.col("sal").isNotNull() & F.col("temp").isNotNull()} | S.calendar(F.col("ts")))


@query("readings", sql=f"WITH {GRID}, {FRAME} SELECT series_id, ts, round(target, 5) AS target, target_missing, lvl_missing, precip_missing, covar_valid FROM fr")
def hourly_frame(readings):
    return rounded(frame(readings).select("series_id", "ts", "target", "target_missing", "lvl_missing", "precip_missing", "covar_valid"))


@query("readings", sql=f"WITH {GRID}, {FRAME} SELECT series_id, ts, round(hour_sin, 5) + 0.0 AS hour_sin, round(hour_cos, 5) + 0.0 AS hour_cos, round(doy_sin, 5) + 0.0 AS doy_sin, round(doy_cos, 5) + 0.0 AS doy_cos FROM fr")
def calendar_encoding(readings):
    return rounded(frame(readings).select("series_id", "ts", "hour_sin", "hour_cos", "doy_sin", "doy_cos"))


@query("readings", sql=f"""WITH {GRID} SELECT series_id, ts, round(coalesce(last_value(lvl IGNORE NULLS) OVER w, (SELECT median(lvl) FROM readings)), 5) AS lvl, round(coalesce(last_value(precip IGNORE NULLS) OVER w, 0.0), 5) AS precip
FROM gc WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def causal_fill(readings):
    return rounded(W.causal_fill(W.complete_grid(readings), ["lvl"], ["precip"]).select("series_id", "ts", "lvl", "precip"))


@query("readings", sql=f"""WITH {GRID}, x AS (SELECT series_id, row_number() OVER w AS i, last_value(lvl IGNORE NULLS) OVER w AS lvl, last_value(precip IGNORE NULLS) OVER w AS precip FROM gc WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
u AS (SELECT series_id, i, 'lvl' AS channel, lvl AS v FROM x UNION ALL SELECT series_id, i, 'precip', precip FROM x)
SELECT series_id, channel, count(*) FILTER (WHERE v IS NULL) AS n_null, coalesce(max(i) FILTER (WHERE v IS NULL), 0) AS last_null, count(*) FILTER (WHERE v IS NULL) = coalesce(max(i) FILTER (WHERE v IS NULL), 0) AS prefix_only FROM u GROUP BY 1, 2""")
def fill_guard(readings):
    return W.leading_null_guard(W.complete_grid(readings), ["lvl", "precip"])


@query("readings", sql=f"""WITH {MEMBERS}, g AS (SELECT series_id, eid, count(*) AS n_samples, max(target) AS peak, avg(target) AS mean_do, coalesce(sum(target), 0) * 5 / 60 AS area, arg_max(idx, target) AS ap,
  min(start_time) AS s, max(end_time) AS e FROM (SELECT * FROM mem ORDER BY idx) GROUP BY 1, 2)
SELECT series_id, eid, n_samples, round(peak, 5) AS peak_do, round(mean_do, 5) AS mean_do, round(area, 5) AS area, ap AS arg_peak, CAST(floor(epoch(e - s) / 60) AS BIGINT) AS dur_min,
round(ap / greatest(n_samples - 1, 1), 5) AS peak_frac, ap * 5 AS rise_min, (n_samples - 1 - ap) * 5 AS fall_min, round(peak / greatest(ap * 5 / 60, 0.0833::DOUBLE), 5) AS rise_rate, round(peak / greatest((n_samples - 1 - ap) * 5 / 60, 0.0833::DOUBLE), 5) AS fall_rate FROM g""")
def event_shape_features(readings):
    f = E.shape_features(E.member_rows(E.excursions(readings, PEAK, GAP), readings))
    return rounded(f.select("series_id", "eid", "n_samples", "peak_do", "mean_do", "area", "arg_peak", "dur_min", "peak_frac", "rise_min", "fall_min", "rise_rate", "fall_rate"))


@query("readings", sql=f"""WITH {MEMBERS}, t AS (SELECT *, max(target) OVER (PARTITION BY series_id, eid) AS top, count(*) OVER (PARTITION BY series_id, eid) AS n FROM mem)
SELECT series_id, eid, round(CASE WHEN max(n) > 1 AND sum(target) <> 0 THEN sum(idx * target) / sum(target) / (max(n) - 1) END, 5) AS centroid_frac,
round(CASE WHEN max(top) > 0 THEN avg(CASE WHEN target IS NULL THEN NULL WHEN target >= 0.8::DOUBLE * top THEN 1.0 ELSE 0 END) END, 5) AS plateau_frac FROM t GROUP BY 1, 2""")
def centroid_plateau(readings):
    f = E.shape_features(E.member_rows(E.excursions(readings, PEAK, GAP), readings))
    return rounded(f.select("series_id", "eid", "centroid_frac", "plateau_frac"))


@query("readings", sql=f"""WITH {MEMBERS}, t AS (SELECT *, target - lag(target) OVER (PARTITION BY series_id, eid ORDER BY ts) AS st FROM mem)
SELECT series_id, eid, round(CASE WHEN max(target) > 0 THEN max(st) / max(target) END, 5) AS max_rise_norm FROM t GROUP BY 1, 2""")
def max_step(readings):
    return rounded(E.shape_features(E.member_rows(E.excursions(readings, PEAK, GAP), readings)).select("series_id", "eid", "max_rise_norm"))


@query("readings", sql=f"""WITH {MEMBERS}, cx AS (SELECT series_id, ts, sum(precip) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 86399 SECOND PRECEDING AND CURRENT ROW) AS p24, avg(lvl) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 86399 SECOND PRECEDING AND CURRENT ROW) AS wl_pre FROM readings),
g AS (SELECT series_id, eid, min(start_time) AS s, avg(lvl) AS wl_in FROM mem GROUP BY 1, 2)
SELECT g.series_id, eid, round(p24, 5) AS precip_24h, round(wl_in - wl_pre, 5) + 0.0 AS wl_step FROM g ASOF LEFT JOIN cx ON g.series_id = cx.series_id AND g.s >= cx.ts""")
def driver_steps(readings):
    f = E.shape_features(E.member_rows(E.excursions(readings, PEAK, GAP), readings))
    return rounded(E.driver_steps(f, readings).select("series_id", "eid", "precip_24h", "wl_step"))


_rain = lambda h: f"sum(precip) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL {h * 3600 - 1} SECOND PRECEDING AND CURRENT ROW) AS p{h}"
_pre = lambda c: f"avg({c}) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 86399 SECOND PRECEDING AND CURRENT ROW) AS {c}_pre"


@query("readings", sql=f"""WITH {MEMBERS}, cx AS (SELECT series_id, ts, {_rain(72)}, {_rain(168)}, {_pre("sal")}, {_pre("temp")} FROM readings),
g AS (SELECT series_id, eid, min(start_time) AS s, avg(sal) AS sal_in, avg(lvl) AS wl_in, avg(temp) AS temp_in FROM mem GROUP BY 1, 2)
SELECT g.series_id, eid, round(sal_in, 5) AS sal_in, round(wl_in, 5) AS wl_in, round(temp_in, 5) AS temp_in, round(sal_in - sal_pre, 5) + 0.0 AS sal_step, round(temp_in - temp_pre, 5) + 0.0 AS temp_step,
round(p72, 5) AS precip_72h, round(p168, 5) AS precip_168h FROM g ASOF LEFT JOIN cx ON g.series_id = cx.series_id AND g.s >= cx.ts""")
def driver_context(readings):
    """What the drivers are inside each event, and how they and the rain before it compare."""
    f = E.shape_features(E.member_rows(E.excursions(readings, PEAK, GAP), readings))
    return rounded(E.driver_steps(f, readings).select("series_id", "eid", "sal_in", "wl_in", "temp_in", "sal_step", "temp_step", "precip_72h", "precip_168h"))


CURVE = """ex AS (SELECT series_id, interval_id, start_time - least(0.5::DOUBLE * epoch(end_time - start_time), 43200) * INTERVAL 1 SECOND AS a, end_time + least(0.5::DOUBLE * epoch(end_time - start_time), 43200) * INTERVAL 1 SECOND AS b FROM iv),
mm AS (SELECT ex.series_id, interval_id, a, b, ts, lvl FROM ex JOIN readings r ON ex.series_id = r.series_id AND ts BETWEEN a AND b),
sp AS (SELECT series_id, interval_id, epoch(any_value(a)) AS a, epoch(any_value(b)) AS b, min(epoch(ts)) AS f, max(epoch(ts)) AS l, count(lvl) AS n FROM mm GROUP BY 1, 2),
st AS (SELECT *, k AS step, a + (b - a) * k / 15 AS x FROM sp, range(0, 16) AS q(k)),
pt AS (SELECT series_id, interval_id, epoch(ts) AS t, lvl AS v FROM mm WHERE lvl IS NOT NULL),
lo AS (SELECT st.*, p.t AS t0, p.v AS v0 FROM st ASOF LEFT JOIN pt p ON st.series_id = p.series_id AND st.interval_id = p.interval_id AND st.x >= p.t),
hi AS (SELECT lo.*, p.t AS t1, p.v AS v1 FROM lo ASOF LEFT JOIN pt p ON lo.series_id = p.series_id AND lo.interval_id = p.interval_id AND lo.x < p.t)"""


@query("readings", "iv", sql=f"""WITH {CURVE} SELECT series_id, interval_id, CAST(step AS BIGINT) AS step, round((x - a) / 60, 4) AS t_min, x BETWEEN f AND l AS valid,
round(CASE WHEN n >= 2 THEN CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (x - t0) / (t1 - t0) END END, 4) AS lvl FROM hi""")
def curve_resample(readings, iv):
    return rounded(E.curves(readings, iv, ["lvl"], steps=16), 4)


@query("readings", sql="""WITH m AS (SELECT *, coalesce(precip - avg(precip) OVER (PARTITION BY series_id), 0) AS a, coalesce(target - avg(target) OVER (PARTITION BY series_id), 0) AS b FROM readings),
l AS (SELECT series_id, k AS lag, a, lead(b, k) OVER (PARTITION BY series_id, k ORDER BY ts) AS b FROM m, range(0, 49, 3) AS v(k))
SELECT series_id, CAST(lag AS BIGINT) AS lag, round(avg(a * b) / (stddev_pop(a) * stddev_pop(b)), 5) AS corr FROM l WHERE b IS NOT NULL GROUP BY 1, 2""")
def lag_crosscorr(readings):
    return rounded(W.lag_correlation(readings, "precip", "target", list(range(0, 49, 3))))


@query("readings", sql="SELECT series_id, hour(ts) AS hour, round(avg(target), 5) AS target, round(avg(lvl), 5) AS lvl FROM readings GROUP BY 1, 2")
def diurnal_profile(readings):
    return rounded(readings.groupBy("series_id", F.hour("ts").cast("long").alias("hour")).agg(F.avg("target").alias("target"), F.avg("lvl").alias("lvl")))


@query("readings", sql="SELECT series_id, date_trunc('day', ts)::TIMESTAMP AS day, round(avg(lvl), 5) AS lvl, round(sum(precip), 5) AS precip FROM readings GROUP BY 1, 2")
def daily_rollup(readings):
    return rounded(readings.groupBy("series_id", S.hour_of(F.col("ts"), "day").alias("day")).agg(F.avg("lvl").alias("lvl"), F.sum("precip").alias("precip")))


@query("readings", sql="SELECT series_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bin, round(avg(target), 5) AS target, round(sum(precip), 5) AS precip FROM readings GROUP BY 1, 2")
def bin_rollup_flux(readings):
    return rounded(readings.groupBy("series_id", F.window("ts", "6 hours").start.alias("bin")).agg(F.avg("target").alias("target"), F.sum("precip").alias("precip")))


@query("readings", sql="SELECT round(min(target), 5) AS low, round(max(target), 5) AS high, round(avg(target), 5) AS mean, round(median(target), 5) AS mid, round(avg((target < 1)::INT), 5) AS below, count(*) FILTER (WHERE target IS NULL) AS n_null FROM readings")
def global_stats(readings):
    middle = F.lit(exact_quantiles(readings, ["target"], [0.5])["target"][0])
    return rounded(readings.agg(F.min("target").alias("low"), F.max("target").alias("high"), F.avg("target").alias("mean"), middle.alias("mid"), F.avg((F.col("target") < 1).cast("int")).alias("below"), F.count_if(F.col("target").isNull()).alias("n_null")))


@query("readings", sql="SELECT series_id, round(quantile_cont(lvl, 0.33), 5) AS p33, round(quantile_cont(lvl, 0.67), 5) AS p67, round(quantile_cont(lvl, 0.95), 5) AS p95 FROM readings GROUP BY 1")
def exact_percentiles(readings):
    return rounded(readings.groupBy("series_id").agg(*(F.percentile("lvl", F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.33, 0.67, 0.95))))


HIST = """lh AS (SELECT min(lvl) AS lo, CASE WHEN max(lvl) > min(lvl) THEN max(lvl) ELSE min(lvl) + 1 END AS hi FROM readings)"""


def histogram(df, column, bins):
    """Counts of bins of equal width; the last one closed, a range of no width widened by 1."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).withColumn("hi", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("long")
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # ends is one row


@query("readings", sql=f"WITH {HIST} SELECT CAST(least(floor((lvl - lo) / ((hi - lo) / 12)), 11) AS BIGINT) AS bin, count(*) AS n FROM readings, lh WHERE lvl IS NOT NULL GROUP BY 1")
def hist_equal_width(readings):
    return histogram(readings, "lvl", 12)


@query("readings", sql=f"WITH {HIST}, h AS (SELECT CAST(least(floor((lvl - lo) / ((hi - lo) / 59)), 58) AS BIGINT) AS bin, count(*) AS n FROM readings, lh WHERE lvl IS NOT NULL GROUP BY 1) SELECT CAST(b AS BIGINT) AS bin, coalesce(n, 0) AS n FROM range(0, 59) AS r(b) LEFT JOIN h ON b = bin")
def hist_zero_bins(readings):
    grid = readings.sparkSession.range(59).select(F.col("id").alias("bin"))
    return grid.join(histogram(readings, "lvl", 59), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("readings", "iv", sql="SELECT series_id, interval_id, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM iv JOIN readings USING (series_id) WHERE ts BETWEEN start_time AND end_time GROUP BY 1, 2")
def event_minmax(readings, iv):
    return I.padded_members(readings, iv, 0).groupBy("series_id", "interval_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))


@query("readings", sql="SELECT series_id, ts, round(lvl - lag(lvl) OVER (PARTITION BY series_id ORDER BY ts), 5) + 0.0 AS step, round(lag(target, 7) OVER (PARTITION BY series_id ORDER BY ts), 5) AS target_7 FROM readings")
def lag_shift(readings):
    w = W.series()
    return rounded(readings.select("series_id", "ts", (F.col("lvl") - F.lag("lvl").over(w)).alias("step"), F.lag("target", 7).over(w).alias("target_7")))


@query("orders", sql="SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM orders")
def prefix_sum_global(orders):
    d = orders.select("o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return W.prefix_sum(d, ["day", "o_orderkey"], "cents", slices=32).select("o_orderkey", "running")
