from datetime import datetime, timedelta

import pytest

from episodic.sources import readers as R
from episodic.streaming import readings as T


def test_cells_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("when,x,\nunits,mg,\n2024-01-01 00:00,#REF!,\n2024-01-01 00:05,2.5,\n")
    d = R.data_rows(R.read_cells(spark, str(tmp_path / "*.csv"), drop_last=True), "when", "yyyy-MM-dd HH:mm")
    assert [(r["when"], r.x) for r in d.orderBy("when").collect()] == [(datetime(2024, 1, 1), None), (datetime(2024, 1, 1, 0, 5), "2.5")]
    with pytest.raises(Exception):
        R.read_cells(spark, str(tmp_path / "none*.csv"))
    assert R.banner_names([["Temp", None], ["°C", " "], ["Avg", None]]) == ["Temp | degC | Avg", "unnamed_1"]
    assert R.pick(["Air Temp", "Water Temp"], ("temp",), ("air",)) == "Water Temp"
    with pytest.raises(KeyError):
        R.pick(["a"], ("b",))
    assert R.named_companions(["a", None, "", "b"], fixed=(2,)) == {0: "a", 1: "a_1", 3: "b"}


def test_tidy_csv(spark, tmp_path):
    parents = spark.createDataFrame([("p", "hot", "n")], "parent_id string, type string, notes string")
    children = spark.createDataFrame([("p", "oxic", "p#1")], "parent_id string, type string, unit_id string")
    R.write_tidy_csv(parents, children, str(tmp_path / "o"))
    rows = spark.read.csv(str(tmp_path / "o"), header=True).collect()
    assert {(r.type, r.unit_id, r.notes) for r in rows} == {("hot", None, "n"), ("oxic", "p#1", "n")}


def test_stream_equals_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i % 2, t0 + timedelta(minutes=10 * i), float(i), 1.0) for i in range(60)]
    d = spark.createDataFrame(rows + rows[:5], "series_id long, ts timestamp, lvl double, precip double")
    d.write.parquet(str(tmp_path / "in"))
    stream = T.rollup(T.deduplicated(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))), late=None)
    q = stream.writeStream.outputMode("append").format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.series_id, r.bin): (r.lvl, r.precip) for r in spark.table("rolled").collect()}
    last = max(r[1] for r in rows) - timedelta(hours=3)
    for s in (0, 1):
        for h in range(0, 6):
            b = t0 + timedelta(hours=h)
            own = [r for r in rows if r[0] == s and b <= r[1] < b + timedelta(hours=1)]
            if b <= last - timedelta(hours=1):
                assert got[s, b] == (sum(r[2] for r in own) / len(own), float(len(own)))


def test_many_files_by_priority(spark, tmp_path):
    (tmp_path / "b_2020.csv").write_text("when,x\n1,b\n2,b\n2,later\n")
    (tmp_path / "a_2020.csv").write_text("when,x,y\n1,a,#REF!\n,a,9\n3,a,7\n")
    (tmp_path / "c_other.csv").write_text("when,x\n1,c\n4,c\n")
    got = R.read_many(spark, str(tmp_path), "*_2020.csv", ["when"])
    assert {(r["when"], r.x, r.y) for r in got.collect()} == {("1", "a", None), ("2", "b", None), ("3", "a", "7")} and "file" in got.columns
    first = R.read_many(spark, str(tmp_path), "*.csv", ["when"], keep=("when", "x"), first=("other", "b_"))
    assert {(r["when"], r.x) for r in first.collect()} == {("1", "c"), ("2", "b"), ("3", "a"), ("4", "c")} and "y" not in first.columns
    with pytest.raises(FileNotFoundError):
        R.read_many(spark, str(tmp_path), "*.txt", ["when"])


def test_first_per_key_orders_nulls_last(spark):
    d = spark.createDataFrame([(1, None, "n"), (1, 5, "b"), (1, 5, "a"), (None, 1, "z"), (2, None, None)], "k long, o long, v string")
    assert {(r.k, r.o, r.v) for r in R.first_per_key(d, ["k"], ["o"]).collect()} == {(1, 5, "a"), (2, None, None)}
    assert R.first_per_key(d.limit(0), ["k"], ["o"]).count() == 0


def test_banner_and_first_rows_of_files(spark):
    rows = [("s", 0, "Temp", "Temp", None), ("s", 1, "©", "©", " "), ("s", 2, "2024", "1", "2"), ("t", 3, "x", None, None)]
    d = spark.createDataFrame(rows, "file string, row_idx long, a string, b string, c string")
    got = R.under_banner(d.drop("file"), 2)
    assert got.columns == ["row_idx", "Temp | (C)", "Temp | (C)_2", "unnamed_2"] and got.count() == 2
    assert R.under_banner(d.drop("file").limit(0), 2).count() == 0
    assert {(r.file, r.row_idx) for r in R.first_row(d, "a", r"^\d{4}$").collect()} == {("s", 2)}


def test_tidy_labels_are_lenient(spark):
    rows = [("7", "umbrella", None, "2020x", "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2", None), ("7", "hot", "1", "", "2024-01-01 01:00:00", "2024-01-01 02:00:00", "", "1899-12-31 02:20:00"), ("7", None, "2", "2020", "?", "2024-01-01 03:00:00", "0", "2024-01-01 09:00:00")]
    d = spark.createDataFrame(rows, "parent_id string, type string, moment_idx string, year string, start_time string, end_time string, flooding string, m_peak_do_ts string")
    parents, children = R.tidy_labels(d)
    p = parents.collect()[0]
    assert (p.year, p.flooding, p.end_time, p.source) == (None, True, datetime(2024, 1, 2), "expert") and "m_peak_do_ts" not in parents.columns
    got = {c.unit_id: (c.year, c.flooding, c.m_peak_do_ts) for c in children.collect()}
    assert got == {"7#1": (None, None, None), "7#2": (2020, False, datetime(2024, 1, 1, 9))}  # without a whole window nothing is a stray


def test_readings_written_by_series(spark, tmp_path):
    d = spark.createDataFrame([(1, 2.0), (2, 3.0)], "series_id long, lvl double")
    R.write_readings(d, str(tmp_path / "r"))
    assert {(r.series_id, r.lvl) for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {(1, 2.0), (2, 3.0)} and (tmp_path / "r" / "series_id=1").exists()


def test_sequences_need_the_same_units(spark):
    from episodic.operators import models as D

    c = spark.createDataFrame([("a", "train", i, float(i), None) for i in (1, 0)] + [("h", "holdout", 0, 1.0, 1.0)], "unit_id string, split string, step long, x double, y double")
    u = spark.createDataFrame([("a", "train"), ("h", "holdout")], "unit_id string, split string")
    assert [r.seq for r in D.sequences(c, u, ["x", "y"], 2).collect()] == [[[0.0, 1.0], [None, None]]]
    with pytest.raises(ValueError, match="1 units differ"):
        D.sequences(c, u.union(spark.createDataFrame([("b", "train")], u.schema)), ["x"], 2)
    with pytest.raises(ValueError, match="3 steps"):
        D.sequences(c, u, ["x"], 3)


def test_composition_of_clusters(spark):
    from episodic.operators import clustering as C

    d = spark.createDataFrame([(0, "a"), (0, "a"), (0, None), (1, "b")], "cluster long, cls string")
    assert {(r.cluster, r.cls, r.n, round(r.share, 3)) for r in C.composition(d, ["cluster"], "cls").collect()} == {(0, "a", 2, 0.667), (0, None, 1, 0.333), (1, "b", 1, 1.0)}
