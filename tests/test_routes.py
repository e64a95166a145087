from datetime import datetime, timedelta

from pyspark.sql import functions as F

from episodic.operators import events as E
from episodic.operators import routes as R

T0 = datetime(2024, 1, 1)
AT = lambda m: T0 + timedelta(minutes=m)
READINGS = "series_id long, ts timestamp_ntz, target double, sal double, lvl double, temp double, precip double, is_backfill boolean"
PARENTS = "series_id long, interval_id long, start_time timestamp_ntz, end_time timestamp_ntz, label string, subtype string"
CHILDREN = "series_id long, parent_id long, moment_idx long, start_time timestamp_ntz, end_time timestamp_ntz, type string"
TARGETS = [0.0, 1.0, 3.0, 2.0, 0.0, 0.0, 0.0, 0.0, 5.0, 0.0]


def tables(spark):
    r = spark.createDataFrame([(1, AT(5 * i), t, 1.0 * i, 2.0, 3.0, 0.5, i < 2) for i, t in enumerate(TARGETS)], READINGS)
    p = spark.createDataFrame([(1, 7, AT(0), AT(15), "hot", "h"), (1, 8, AT(5), AT(12), "pulse", "o2"), (1, 9, AT(600), AT(700), "hot", None)], PARENTS)
    c = spark.createDataFrame([(1, 7, 1, AT(5), AT(10), "hot"), (1, 99, 1, AT(5), AT(10), "oxic")], CHILDREN)
    return r, p, c


def test_units_of_routes(spark):
    r, p, c = tables(spark)
    auto = R.units("auto", r, p, c, 0.1, 1)
    assert [(u.eid, u.event_id, u.subtype, u.label, u.label_source, u.split) for u in auto.orderBy("eid").collect()] == [(1, 7, "h", "hot", "expert", "train"), (2, None, None, None, "inferred", "holdout")]
    assert {(s.event_id, s.n_segments) for s in R.segments(auto).collect()} == {(7, 1)}
    assert {(u.unit_id, u.subtype) for u in R.units("moments", r, p, c, 0.1, 1).collect()} == {("7#1", "h"), ("99#1", None)}
    assert {u.subtype for u in R.units("events", r, p.drop("subtype"), c, 0.1, 1).collect()} == {None}


def test_features_know_spliced_readings(spark):
    r, p, c = tables(spark)
    got = {u.unit_id: u.is_backfill for u in R.feature_table(R.units("auto", r, p, c, 0.1, 1), r).collect()}
    assert got == {"auto#1": True, "auto#2": False}
    assert {u.is_backfill for u in R.feature_table(R.units("auto", r, p, c, 0.1, 1), r.drop("is_backfill")).collect()} == {False}
    assert R.feature_table(R.units("events", r, p, c, 0.1, 1), r).where("eid = 9").count() == 0  # no readings inside


def test_route_written_and_read_again(spark, tmp_path):
    r, p, c = tables(spark)
    R.run("events", r, p, c, str(tmp_path), steps=8)
    got = R.load(spark, "events", str(tmp_path))
    assert {(u.unit_id, u.cls) for u in got.collect()} == {("7", "hot"), ("8", "oxic")}
    assert spark.read.parquet(f"{tmp_path}/events_curves").groupBy("unit_id").count().where("count <> 8").count() == 0


def test_card_of_an_event_with_unknowns(spark):
    d = spark.createDataFrame([(1, 7, "7", "hot", "h7", AT(0), AT(90), 90, None, -0.5, None, 0.25, 4)], "series_id long, eid long, unit_id string, label string, subtype string, start_time timestamp_ntz, end_time timestamp_ntz, dur_min long, peak_do double, sal_step double, wl_step double, precip_24h double, n_samples long")
    lines = {x.field: x.value for x in R.summary_card(d).collect()}
    assert lines["class"] == "hot  (h7)" and lines["code means"] == R.MEANINGS["h"] and lines["peak"] == "-" and lines["salinity step"] == "-0.50"
    assert lines["duration"] == "1.5 h" and lines["flooding"] == "-" and lines["excursions"] == "0 segment(s)" and len(lines) == 12
    assert {x.value for x in R.summary_card(d.drop("subtype")).where("field = 'code means'").collect()} == {"-"}


def test_hystereses_of_several_drivers_equal_each_alone(spark):
    rows = [(s, 1, AT(5 * i), t, float((i * 7 + s) % 5), None if i == 2 else float(i), 4.0) for s in (1, 2) for i, t in enumerate([0.5, 1.0, 3.0, 2.0, 1.0, 0.2])]
    m = spark.createDataFrame(rows, "series_id long, eid long, ts timestamp_ntz, target double, a double, b double, flat double")
    both = {r.series_id: r for r in E.hystereses(m, {"x": "a", "y": "b", "z": "flat"}).collect()}
    for name, c in (("x", "a"), ("y", "b")):
        for r in E.hysteresis(m, c).collect():
            assert r.hysteresis == both[r.series_id][name] and r.hysteresis is not None
    assert all(r.z is None for r in both.values())
    assert E.hystereses(m.withColumn("a", F.lit(None).cast("double")), {"x": "a"}).where("x IS NULL").count() == 2
