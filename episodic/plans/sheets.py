"""Queries of sheet-like tables of text cells, made from the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import models as D
from ..operators import routes as R
from ..sources import readers as S
from .registry import OFF_TIES, query, rounded
from .series import CURVE

_stamp = "yyyy-MM-dd HH:mm:ss"

# ---- tidy labels: orders are parents, lines their children; some cells hold what does not fit

_sql_cells = """p AS (SELECT CAST(o_orderkey AS VARCHAR) AS parent_id, o_orderdate AS a, o_orderdate + INTERVAL 2 DAY AS b, o_orderkey AS k, o_orderstatus AS s FROM orders),
c AS (SELECT CAST(l_orderkey AS VARCHAR) AS parent_id, l_linenumber, l_shipdate AS a, l_shipdate + INTERVAL 1 DAY AS b, l_quantity, l_returnflag, l_orderkey AS k FROM lineitem)"""


def label_cells(orders, lineitem):
    """A tidy label file's rows, all text."""
    at = lambda c, d=0: F.date_format(F.col(c) + F.expr(f"INTERVAL '{d}' DAY"), _stamp)
    k = F.col("o_orderkey")
    p = orders.select(
        k.cast("string").alias("parent_id"), F.lit("umbrella").alias("type"), F.when(k % 7 == 0, "n/a").otherwise(F.year("o_orderdate").cast("string")).alias("year"), at("o_orderdate").alias("start_time"), at("o_orderdate", 2).alias("end_time"),
        F.when(k % 3 == 0, "1").when(k % 3 == 1, "0").otherwise("").alias("flooding"), F.when(k % 5 == 0, "").otherwise((k % 4).cast("string")).alias("n_hot_moments"),
    )
    k = F.col("l_orderkey")
    c = lineitem.select(
        k.cast("string").alias("parent_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("type"), F.col("l_linenumber").cast("string").alias("moment_idx"), at("l_shipdate").alias("start_time"), at("l_shipdate", 1).alias("end_time"),
        F.when(k % 4 == 0, "1899-12-31 02:20:00").when(k % 4 == 1, "soon").otherwise(at("l_shipdate")).alias("m_peak_do_ts"), F.when(k % 6 == 0, "#REF!").otherwise(F.col("l_quantity").cast("string")).alias("m_peak_do"),
    )
    return p.unionByName(c, allowMissingColumns=True)


@query("orders", "lineitem", sql=f"""WITH {_sql_cells} SELECT parent_id, CASE WHEN k % 7 <> 0 THEN CAST(year(a) AS BIGINT) END AS year, a AS start_time, b AS end_time, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flooding, CASE WHEN k % 5 <> 0 THEN k % 4 END AS n_hot_moments FROM p""")
def tidy_parents(orders, lineitem):
    """Parents of a tidy label file; what doesn't fit its type is null."""
    return S.tidy_labels(label_cells(orders, lineitem))[0].select("parent_id", "year", "start_time", "end_time", "flooding", "n_hot_moments")


@query("orders", "lineitem", sql=f"""WITH {_sql_cells} SELECT parent_id || '#' || l_linenumber AS unit_id, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS type, CAST(l_linenumber AS BIGINT) AS moment_idx, CASE WHEN k % 4 > 1 THEN a END AS m_peak_do_ts, CASE WHEN k % 6 <> 0 THEN l_quantity END AS m_peak_do, 'expert' AS source FROM c""")
def tidy_children(orders, lineitem):
    """Children of a tidy label file; peaks outside the child's own time are null."""
    return S.tidy_labels(label_cells(orders, lineitem))[1].select("unit_id", "type", "moment_idx", "m_peak_do_ts", "m_peak_do", "source")


# ---- a sheet under a banner of three rows, the readings below it


@query("readings", sql=f"""SELECT CAST(series_id AS VARCHAR) AS "unnamed_0", strftime(ts, '%Y-%m-%d %H:%M:%S') AS "when", round(lvl + {OFF_TIES}, 3) AS lvl, round(temp + {OFF_TIES}, 3) AS temp FROM readings""")
def banner_sheet(readings):
    """Readings as a sheet of text cells, its banner turned into names and columns found by tokens."""
    s = lambda c: F.round(F.col(c) + OFF_TIES, 3).cast("string")
    cells = readings.select((F.xxhash64("series_id", "ts") % (1 << 40) + (1 << 41)).alias("row_idx"), F.col("series_id").cast("string").alias("c0"), F.date_format("ts", _stamp).alias("c1"), s("lvl").alias("c2"), s("temp").alias("c3"))
    banner = [(0, None, "Date", "Level", "Temp ©"), (1, None, "time", "m", "°C"), (2, " ", "", "Avg", "Avg")]
    sheet = readings.sparkSession.createDataFrame(banner, "row_idx long, c0 string, c1 string, c2 string, c3 string").unionByName(cells)
    d = S.under_banner(sheet, 3).drop("row_idx")
    when, lvl, temp = S.pick(d.columns, ("date",)), S.pick(d.columns, ("level", "avg")), S.pick(d.columns, ("temp", "(c)"))
    number = lambda c, name: F.round(F.col(f"`{c}`").try_cast("double"), 3).alias(name)
    return d.select("unnamed_0", F.col(f"`{when}`").alias("when"), number(lvl, "lvl"), number(temp, "temp"))


# ---- rows of several sources, the first by priority


@query("orders", sql="""SELECT o_custkey AS k, arg_min({'s': o_orderstatus, 'd': o_orderdate}, {'f': strpos('OFP', o_orderstatus), 'd': o_orderdate, 'k': o_orderkey}).s AS status, arg_min(o_orderkey, {'f': strpos('OFP', o_orderstatus), 'd': o_orderdate, 'k': o_orderkey}) AS o_orderkey FROM orders GROUP BY 1""")
def first_by_source(orders):
    """A customer's first order, those of status O before those of F before those of P."""
    d = orders.select(F.col("o_custkey").alias("k"), F.instr(F.lit("OFP"), F.col("o_orderstatus")).alias("file"), "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return S.first_per_key(d, ["k"], ["file", "o_orderdate", "o_orderkey"]).select("k", "status", "o_orderkey")


# ---- sequences of training units, checked against their feature table


@query("readings", "iv", sql=f"""WITH {CURVE} SELECT CAST(interval_id AS VARCHAR) AS unit_id, CAST(step AS BIGINT) AS step, round(CASE WHEN n >= 2 THEN CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (x - t0) / (t1 - t0) END END, 4) AS lvl FROM hi""")
def training_sequences(readings, iv):
    """Curves as one array per unit, and back to steps."""
    c = E.curves(readings, iv, ["lvl"], steps=16).select(F.col("interval_id").cast("string").alias("unit_id"), "step", "lvl").withColumn("split", F.lit("train"))
    seen = c.select("unit_id", "split").distinct()
    s = D.sequences(c, R.units("events", readings, iv, iv, 0.1, 2).join(seen.select("unit_id"), "unit_id", "left_semi"), ["lvl"], 16)
    return rounded(s.select("unit_id", F.posexplode(F.get("seq", F.lit(0))).alias("step", "lvl")).withColumn("step", F.col("step").cast("long")), 4)
