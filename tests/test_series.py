from datetime import datetime, timedelta

from pyspark.sql import functions as F

from episodic.functions import scalar as S
from episodic.operators import events as E
from episodic.operators import intervals as I
from episodic.operators import metrics as M
from episodic.operators import windows as W

T0 = datetime(2024, 1, 1)
AT = lambda m: T0 + timedelta(minutes=m)
READINGS = "series_id long, ts timestamp_ntz, target double, sal double, lvl double, temp double, precip double"
IV = "series_id long, interval_id long, start_time timestamp_ntz, end_time timestamp_ntz"


def readings(spark, targets, step=5, lvl=None):
    rows = [(1, AT(step * i), t, 1.0, (lvl or targets)[i], 1.0, 1.0) for i, t in enumerate(targets)]
    return spark.createDataFrame(rows, READINGS)


def test_run_lengths_and_gaps(spark):
    got = E.excursions(readings(spark, [0.0, 1.0, 2.0, 0.0, 0.0, 3.0, None, 4.0, 0.0]), 0.1, 2).orderBy("eid").collect()
    assert [(r.peak, r.start_time, r.end_time) for r in got] == [(3.0, AT(0), AT(25)), (4.0, AT(35), AT(40))]


def test_nested_intervals(spark):
    r = spark.createDataFrame([(1, AT(5)), (1, AT(15)), (1, AT(50))], "series_id long, ts timestamp_ntz")
    iv = spark.createDataFrame([(1, 1, AT(0), AT(100)), (1, 2, AT(10), AT(20))], IV)
    assert {(x.ts, x.interval_id) for x in I.asof_samples(r, iv).collect()} == {(AT(5), 1), (AT(15), 2)}
    assert (AT(50), 1) in {(x.ts, x.interval_id) for x in I.padded_members(r, iv, 0).collect()}
    ties = spark.createDataFrame([(1, 1, AT(0), AT(10)), (1, 2, AT(0), AT(5))], IV)
    assert I.asof_samples(spark.createDataFrame([(1, AT(7))], "series_id long, ts timestamp_ntz"), ties).count() == 0


def test_overlaps_over_many_days_count_once(spark):
    a = spark.createDataFrame([(1, 1, AT(0), AT(60 * 24 * 9))], "series_id long, a_id long, a_start timestamp_ntz, a_end timestamp_ntz")
    b = spark.createDataFrame([(1, 7, AT(60), AT(60 * 24 * 5)), (1, 8, AT(60 * 24 * 30), AT(60 * 24 * 31))], "series_id long, b_id long, b_start timestamp_ntz, b_end timestamp_ntz")
    assert [(r.b_id, r.overlap_s) for r in I.overlap_pairs(a, b).collect()] == [(7, (24 * 5 - 1) * 3600.0)]


def test_rolling_edge(spark):
    r = readings(spark, [1.0, 2.0, 4.0], step=24 * 60)
    got = W.rolling(r, {"s": ("sum", "target", 24)}).orderBy("ts").collect()
    assert [x.s for x in got] == [1.0, 2.0, 4.0]


def features(spark, targets, lvl=None):
    r = readings(spark, targets, lvl=lvl)
    members = r.withColumns({"eid": F.lit(1), "start_time": F.lit(AT(0)), "end_time": F.lit(AT(5 * len(targets) - 5)), "idx": (F.row_number().over(W.series()) - 1).cast("long")})
    return E.shape_features(members).first(), E.hysteresis(members, "lvl").first().hysteresis


def test_shape_features(spark):
    f, _ = features(spark, [1.0, 5.0, 5.0, 2.0])
    assert (f.arg_peak, round(f.peak_frac, 6), f.rise_min, f.fall_min) == (1, round(1 / 3, 6), 5, 10)
    assert features(spark, [0.0, 1.0, 0.0])[0].centroid_frac == 0.5
    assert features(spark, [0.0, 0.0])[0].centroid_frac is None
    assert features(spark, [1.0, 8.0, 10.0, 8.0, 1.0])[0].plateau_frac == 0.6
    assert features(spark, [0.0, 4.0, 5.0])[0].max_rise_norm == 0.8
    f, _ = features(spark, [None, None])
    assert f.area == 0 and f.arg_peak is None


def test_hysteresis(spark):
    assert features(spark, [1.0, 3.0, 1.0], lvl=[2.0, 2.0, 2.0])[1] is None
    assert features(spark, [5.0, 3.0, 1.0], lvl=[1.0, 2.0, 3.0])[1] is None
    assert abs(features(spark, [1.0, 3.0, 5.0, 3.0, 1.0], lvl=[1.0, 3.0, 5.0, 3.0, 1.0])[1]) < 1e-9


def test_scalars(spark):
    d = spark.sql("SELECT TIMESTAMP_NTZ '2024-09-30 12:02:29.9' AS a, TIMESTAMP_NTZ '2024-10-01 12:02:30' AS b")
    r = d.select(S.water_year(F.col("a")).alias("x"), S.water_year(F.col("b")).alias("y"), S.snap(F.col("a")).alias("p"), S.snap(F.col("b")).alias("q")).first()
    assert (r.x, r.y, r.p, r.q) == (2024, 2025, datetime(2024, 9, 30, 12, 0), datetime(2024, 10, 1, 12, 5))
    d = spark.createDataFrame([("mx",), ("Hx1",), ("e2",), ("o",), ("h1",), (None,), ("z",)], "s string")
    assert [x.c for x in d.select(S.suffix_class(F.col("s")).alias("c")).collect()] == ["mixed", "mixed", "pulse", "pulse", "hot", "ignore", "ignore"]


def test_metrics(spark):
    cells = spark.createDataFrame([(0, 0, 20), (0, 1, 5), (1, 0, 10), (1, 1, 15)], "true int, pred int, n long")
    m = M.class_metrics(cells).first()
    assert round(m.kappa, 6) == 0.4 and round(m.mcc, 6) == 0.408248
    ties = spark.createDataFrame([(0, 0.5), (1, 0.5), (0, 0.5), (1, 0.5)], "y int, s double").withColumn("k", F.lit(1))
    assert M.roc_auc(ties, "y", "s", ["k"]).first().auc == 0.5 and M.average_precision(ties, "y", "s", ["k"]).first().ap == 0.5


def test_prefix_sum_matches_window(spark):
    d = spark.range(500).select((F.col("id") * 37 % 101).alias("k"), "id", F.lit(1).alias("one"))
    got = W.prefix_sum(d, ["k", "id"], "one", slices=8).orderBy("k", "id").collect()
    assert [r.running for r in got] == list(range(1, 501))


def test_lead_times_at_any_date(spark):
    from episodic.plans import forecasts

    start = datetime(2031, 5, 1)
    rows = [(s, start + timedelta(hours=i), 0.0, 1.0, 70.0 if i % 150 < 3 else float(i * 13 % 50), 1.0, 0.0) for s in (0, 1) for i in range(600)]
    readings = spark.createDataFrame(rows, "series_id long, ts timestamp_ntz, target double, sal double, lvl double, temp double, precip double")
    got = forecasts.lead_time_skill(readings).collect()
    assert sorted(r.lead_h for r in got) == [6, 12, 24, 48, 72]
    assert all(0 <= r.auc <= 1 for r in got)
