"""Queries against their SQL where many events an hour bring means close together: flat targets, steps near zero."""

import math
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

T0 = datetime(2024, 1, 1)
KINDS = ("error", "view", "click", "signup", "purchase")
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def value(series, kind, hour):
    """Series 0 has a flat target, series 1 a flat rain, series 2 neither; steps of salinity and level lie near zero."""
    if kind == "error":
        return 50.0 if series == 0 else 40.0 + (hour * 7 + series) % 50
    if kind == "purchase":
        return 160.0 if series == 1 else 150.5 + (hour * 5) % 11
    return 20.0 + ((hour * 3) % 5 - 2) * 0.001


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("flat")
    rows = [(s, k, h) for s in range(3) for h in range(60) for k in KINDS]
    events = [(i, T0 + timedelta(hours=h, minutes=5), s, k, value(s, k, h), "{}") for i, (s, k, h) in enumerate(rows)]
    spark.createDataFrame(events, EVENTS).write.parquet(f"{out}/events.parquet")
    spark.createDataFrame([(1,), (2,), (3,), (3,)], "c_custkey long").write.parquet(f"{out}/customer.parquet")
    spark.createDataFrame([(1, "P"), (2, "F"), (2, "O")], "o_custkey long, o_orderstatus string").write.parquet(f"{out}/orders.parquet")
    return out


def both(spark, folder, name):
    c = duckdb.connect()
    for t in ("events", "customer", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    plain = lambda v: "NaN" if isinstance(v, float) and math.isnan(v) else v
    d = entry.queries()[name](spark, str(folder))
    cur = c.execute(entry.oracle_sql()[name])
    at = [[x[0] for x in cur.description].index(n) for n in d.columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    return Counter(tuple(map(plain, r)) for r in d.collect()), want


def test_cusum_leaves_out_a_flat_target(spark, folder):
    got, want = both(spark, folder, "cusum_inflection")
    assert got == want and {r[0] for r in got} == {1, 2}


def test_lag_correlation_of_a_flat_series_is_nan(spark, folder):
    got, want = both(spark, folder, "lag_crosscorr")
    assert got == want and len(got) == 15
    assert {(s, c == "NaN") for s, _, c in got} == {(0, True), (1, True), (2, False)}


def test_lag_correlation_looks_at_every_third_hour_of_two_days(spark, folder):
    got, want = both(spark, folder, "lag_crosscorr")
    assert got == want
    assert Counter((s, k) for s, k, _ in got.elements()) == Counter((s, k) for s in range(3) for k in range(0, 49, 3))
    assert {(s, c == "NaN") for s, _, c in got} == {(0, True), (1, True), (2, False)}
    rain = np.array([value(2, "purchase", h) for h in range(60)])
    target = np.array([max(value(2, "error", h) - 60, 0) for h in range(60)])
    x, y = rain - rain.mean(), target - target.mean()
    corr = {k: (x[: 60 - k] * y[k:]).mean() / (x[: 60 - k].std() * y[k:].std()) for k in range(0, 49, 3)}
    assert all(abs(c - corr[k]) < 2e-5 for s, k, c in got if s == 2)


def test_card_keeps_the_sign_of_a_step_that_rounds_to_zero(spark, folder):
    got, want = both(spark, folder, "summary_card")
    assert got == want
    assert {r[4] for r in got if r[3] == "salinity step"} == {"+0.00", "-0.00"}


def test_customers_without_any_order(spark, folder):
    got, want = both(spark, folder, "id_set_diff")
    assert got == want == Counter([(3,)])
