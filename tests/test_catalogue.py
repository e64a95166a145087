import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from episodic.operators import labels as L
from episodic.operators import rocket as R
from episodic.plans import catalogue


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalogue.QUERIES) > 90


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plans_have_no_cross_join_over_rows(spark):
    for name in ("asof_samples", "overlap_pairs", "padded_window_members", "label_inheritance"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_rocket_tiny_bank():
    y = R.convolve(np.array([[0.0, 1, 3, 6]]), {"padding": 0, "dilation": 1, "weights": [1, 0, -1], "bias": 0})
    assert y.tolist() == [[-3, -5]]
    assert R.bank(3, 2, 24, 1) == R.bank(3, 2, 24, 1) and all(abs(sum(k["weights"])) < 1e-9 for k in R.bank(5, 2, 24))


def test_channel_scaling(spark):
    d = spark.createDataFrame([(1, [[1.0, 2.0], [5.0, 5.0]]), (2, [[3.0, float("nan")], [5.0, None]])], "id long, s array<array<double>>")
    got = {r.id: r.s for r in R.scale_channels(d, "id", "s").collect()}
    assert np.allclose(got[1][0], [-1.224745, 0], atol=1e-5) and got[2][0][1] == 0 and got[2][1] == [0.0, 0.0]


def test_label_rows(spark):
    rows = [("s", 1, "x", None), ("s", 2, "E1", "p"), ("s", 3, None, "c"), ("s", 4, "LEGEND", None), ("s", 5, "E2", "p")]
    d = spark.createDataFrame(rows, "sheet string, row_idx long, c0 string, kind string")
    kept = L.attach_to_parents(L.until_sentinel(d, "c0", "LEGEND"), F.col("kind") == "p", F.col("c0"))
    assert [(r.row_idx, r.parent_id) for r in kept.orderBy("row_idx").collect()] == [(2, "E1"), (3, "E1")]
