"""Queries of the relational base, label cleaning, metrics, weak supervision, statistics and forecasting, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import weak as K
from ..operators import windows as W
from ..operators.quantiles import exact_quantiles
from .registry import query, rounded
from .series import GRID

# ---- scans, casts, predicates, sets


@query("events", sql="SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE TRY_CAST(value AS BIGINT) END AS v, event_type FROM events WHERE value BETWEEN 20 AND 60 AND event_type IN ('view', 'click')")
def scan_cast_filter(events):
    raw = F.when(F.col("event_id") % 7 == 0, "#REF!").otherwise(F.bround("value").cast("string"))
    v = S.null_tokens(raw).try_cast("double").cast("long")
    return events.where(F.col("value").between(20, 60) & F.col("event_type").isin("view", "click")).select("event_id", v.alias("v"), "event_type")


@query("events", sql="SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE event_type END AS cell FROM events")
def null_tokens_to_null(events):
    return events.select("event_id", S.null_tokens(F.when(F.col("event_id") % 5 == 0, "#REF!").when(F.col("event_id") % 5 == 1, "").otherwise(F.col("event_type"))).alias("cell"))


@query("events", sql="SELECT event_id, make_timestamp(((epoch_us(ts) + 150000000) // 300000000) * 300000000) AS ts5 FROM events")
def grid_snap_5m(events):
    return events.select("event_id", S.snap(F.col("ts")).alias("ts5"))


@query("events", sql="SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def keep_first_dedupe(events):
    w = Window.partitionBy("user_id", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return events.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("event_id", "user_id", "ts")


@query("readings", sql="""WITH p AS (SELECT * FROM readings WHERE ts >= TIMESTAMP '2024-01-10'), m AS (SELECT series_id, min(ts) AS t0 FROM p GROUP BY 1)
SELECT series_id, ts, round(lvl, 5) AS lvl, FALSE AS is_backfill FROM p UNION ALL SELECT r.series_id, ts, round(lvl * 2, 5), TRUE FROM readings r JOIN m ON r.series_id = m.series_id WHERE ts < t0""")
def backfill_splice(readings):
    primary = readings.where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'").select("series_id", "ts", "lvl")
    second = readings.select("series_id", "ts", (F.col("lvl") * 2).alias("lvl"))
    first = primary.groupBy("series_id").agg(F.min("ts").alias("t0"))
    older = second.join(first, "series_id").where("ts < t0").drop("t0").withColumn("is_backfill", F.lit(True))
    return rounded(primary.withColumn("is_backfill", F.lit(False)).unionByName(older))


@query("customer", "supplier", sql="SELECT 'customer' AS route, c_custkey AS k, c_acctbal::DOUBLE AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal::DOUBLE, NULL FROM supplier")
def union_promote(customer, supplier):
    a = customer.select(F.lit("customer").alias("route"), F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("double").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return a.unionByName(supplier.select(F.lit("supplier").alias("route"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").cast("double").alias("bal")), allowMissingColumns=True)


@query("customer", "orders", sql="SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def id_set_diff(customer, orders):
    """Customers without any order."""
    return customer.select(F.col("c_custkey").alias("id")).distinct().join(orders.select(F.col("o_custkey").alias("id")), "id", "left_anti")


@query("customer", "orders", sql="""SELECT coalesce(c_custkey, o_custkey) AS id, CASE WHEN o_custkey IS NULL THEN 'missing' ELSE 'extra' END AS what FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') c
FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') o ON c_custkey = o_custkey WHERE c_custkey IS NULL OR o_custkey IS NULL""")
def unit_reconcile(customer, orders):
    a = customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id")).distinct()
    b = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct()
    return a.join(b, "id", "left_anti").withColumn("what", F.lit("missing")).unionByName(b.join(a, "id", "left_anti").withColumn("what", F.lit("extra")))


@query("orders", sql="""SELECT year(o_orderdate)::BIGINT AS water_year, s AS class, count(*) AS n FROM (SELECT o_orderdate, unnest(['total', o_orderstatus]) AS s FROM orders) GROUP BY 1, 2""")
def wide_to_long_tally(orders):
    wide = orders.groupBy(F.year("o_orderdate").cast("long").alias("water_year")).agg(F.count(F.lit(1)).alias("total"), *(F.nullif(F.count_if(F.col("o_orderstatus") == s), F.lit(0)).alias(s) for s in ("F", "O", "P")))
    return wide.unpivot("water_year", ["total", "F", "O", "P"], "class", "n").where("n IS NOT NULL")


@query("documents", sql="SELECT doc_id, CASE WHEN lower(lang || 'x') LIKE 'm%' OR lower(lang) LIKE 'hx%' THEN 'mixed' WHEN lang LIKE 'e%' THEN 'pulse' WHEN lang LIKE 'o%' THEN 'pulse' WHEN lang LIKE 'h%' THEN 'hot' ELSE 'ignore' END AS cls FROM documents")
def suffix_class(documents):
    return documents.select("doc_id", S.suffix_class(F.col("lang")).alias("cls"))


@query("labels", sql="SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE toxic = 1 END AS flag FROM labels")
def flag_tristate(labels):
    cell = F.when(F.col("doc_id") % 3 == 0, "  ").when(F.col("toxic") == 1, " Yes").otherwise("no")
    return labels.select("doc_id", S.tristate(cell).alias("flag"))


@query("iv", sql="SELECT interval_id, CASE WHEN interval_id % 4 = 0 THEN NULL ELSE start_time END AS peak_ts, interval_id % 4 = 0 AS stray FROM iv")
def out_of_window_null(iv):
    d = iv.withColumn("peak_ts", F.when(F.col("interval_id") % 4 == 0, F.col("start_time") - F.expr("INTERVAL '1' HOUR")).otherwise(F.col("start_time")))
    return L.strays(d, "peak_ts").select("interval_id", "peak_ts", "stray")


@query("documents", sql="SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE lang END AS lang FROM documents")
def value_remap(documents):
    return documents.select("doc_id", S.remap(F.col("lang"), {"en": "english", "de": "german"}).alias("lang"))


@query("documents", sql="SELECT doc_id, source FROM documents WHERE lang IN ('en', 'fr') AND source NOT IN ('src0', 'src1')")
def class_list_filter(documents):
    return documents.where(F.col("lang").isin("en", "fr") & ~F.col("source").isin("src0", "src1")).select("doc_id", "source")


# ---- joins, sorts


@query("orders", "customer", sql="SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def left_attach(orders, customer):
    return orders.join(customer.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment")


@query("orders", "customer", sql="SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def inner_attach(orders, customer):
    return orders.join(customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("documents", sql="SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) AS ord FROM documents GROUP BY 1")
def ranked_attach(documents):
    n = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", F.row_number().over(Window.orderBy(F.col("n").desc(), "source")).cast("long").alias("ord"))


@query("lineitem", sql="SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 14")
def topk_features(lineitem):
    return lineitem.orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(14).select("l_orderkey", "l_linenumber")


@query("supplier", sql="SELECT s_suppkey, s_nationkey FROM supplier")
def multi_key_sort(supplier):
    return supplier.orderBy("s_nationkey", F.col("s_suppkey").desc()).select("s_suppkey", "s_nationkey")


@query("scored", sql="""SELECT grp, unit_id, side FROM (SELECT grp, unit_id, score, 'low' AS side, row_number() OVER (PARTITION BY grp ORDER BY score, unit_id) AS rn FROM scored
UNION ALL SELECT grp, unit_id, score, 'high', row_number() OVER (PARTITION BY grp ORDER BY score DESC, unit_id) FROM scored) WHERE rn <= 2""")
def extremes_pick(scored):
    lo, hi = Window.partitionBy("grp").orderBy("score", "unit_id"), Window.partitionBy("grp").orderBy(F.col("score").desc(), "unit_id")
    d = scored.where("score IS NOT NULL").select("grp", "unit_id", F.row_number().over(lo).alias("l"), F.row_number().over(hi).alias("h"))
    return d.where("l <= 2").select("grp", "unit_id", F.lit("low").alias("side")).unionByName(d.where("h <= 2").select("grp", "unit_id", F.lit("high").alias("side")))


@query("readings", sql="SELECT series_id, i AS idx FROM (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM readings) WHERE i % 10 = 0 OR i IN (3, 7) OR i = n - 1")
def curve_thin(readings):
    d = readings.select("series_id", (F.row_number().over(W.series()) - 1).cast("long").alias("idx"), F.count(F.lit(1)).over(Window.partitionBy("series_id")).alias("n"))
    return d.where((F.pmod("idx", F.lit(10)) == 0) | F.col("idx").isin(3, 7) | (F.col("idx") == F.col("n") - 1)).select("series_id", "idx")


# ---- label cleaning over cells made of orders (parents) and their line items (children)

CELLS = """cells AS (SELECT o_custkey % 50 AS sheet, o_orderkey * 10 AS row_idx, 'P' AS kind, o_orderkey AS k, NULL::BIGINT AS cls FROM orders WHERE o_orderstatus <> 'O'
UNION ALL SELECT o_custkey % 50, o_orderkey * 10 + l_linenumber, 'C', l_orderkey, l_linenumber % 3 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def cells(orders, lineitem):
    p = orders.where("o_orderstatus <> 'O'").selectExpr("o_custkey % 50 AS sheet", "o_orderkey * 10 AS row_idx", "'P' AS kind", "o_orderkey AS k", "CAST(NULL AS BIGINT) AS cls")
    c = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_custkey % 50 AS sheet", "o_orderkey * 10 + l_linenumber AS row_idx", "'C' AS kind", "l_orderkey AS k", "CAST(l_linenumber % 3 AS BIGINT) AS cls")
    return p.unionByName(c)


ATTACHED = CELLS + """, att AS (SELECT *, last_value(CASE WHEN kind = 'P' THEN k END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS parent_id FROM cells)"""


@query("orders", "lineitem", sql=f"WITH {ATTACHED} SELECT sheet, row_idx, parent_id FROM att WHERE parent_id IS NOT NULL")
def parent_fill_rows(orders, lineitem):
    return L.attach_to_parents(cells(orders, lineitem), F.col("kind") == "P", F.col("k")).select("sheet", "row_idx", "parent_id")


def _children(orders, lineitem):
    d = L.attach_to_parents(cells(orders, lineitem), F.col("kind") == "P", F.col("k")).where("kind = 'C'")
    filled = {c: (F.when(F.col("cls") == i, F.lit("a")), F.when((F.col("cls") == i), F.lit("b"))) for i, c in enumerate(("hot", "oxic", "mixed"))}
    d = d.withColumns({f"{c}_{s}": e for c, pair in filled.items() for s, e in zip(("s", "e"), pair, strict=True)})
    return d.withColumn("type", L.block_class({c: (f"{c}_s", f"{c}_e") for c in filled}))


TYPED = ATTACHED + ", ch AS (SELECT *, CASE cls WHEN 0 THEN 'hot' WHEN 1 THEN 'oxic' WHEN 2 THEN 'mixed' END AS type FROM att WHERE kind = 'C' AND parent_id IS NOT NULL)"


@query("orders", "lineitem", sql=f"WITH {TYPED} SELECT parent_id, row_idx, type FROM ch")
def block_typing(orders, lineitem):
    return _children(orders, lineitem).select("parent_id", "row_idx", "type")


@query("orders", "lineitem", sql=f"""WITH {TYPED}, t AS (SELECT parent_id, count(*) FILTER (WHERE type = 'hot') AS h, count(*) FILTER (WHERE type = 'oxic') AS o FROM ch GROUP BY 1)
SELECT o_orderkey AS parent_id, o_orderkey % 4 AS n_hot, 1::BIGINT AS n_oxic, coalesce(h, 0) AS actual_hot, coalesce(o, 0) AS actual_oxic FROM orders LEFT JOIN t ON parent_id = o_orderkey WHERE o_orderstatus <> 'O' AND (o_orderkey % 4 <> coalesce(h, 0) OR 1 <> coalesce(o, 0))""")
def count_mismatch(orders, lineitem):
    declared = orders.where("o_orderstatus <> 'O'").selectExpr("o_orderkey AS parent_id", "o_orderkey % 4 AS n_hot", "1L AS n_oxic")
    return L.mismatches(declared, L.tallies(_children(orders, lineitem), ["hot", "oxic"]), ["hot", "oxic"]).select("parent_id", "n_hot", "n_oxic", "actual_hot", "actual_oxic")


WY = "CAST(year({t}) + CAST(month({t}) >= 10 AS INT) AS BIGINT)"


@query("iv", "moments", sql=f"""WITH p AS (SELECT {WY.format(t="iv.start_time")} AS water_year, type AS cls FROM moments JOIN iv ON parent_id = interval_id),
n AS (SELECT water_year, CASE WHEN grouping(cls) = 1 THEN 'total' ELSE cls END AS cls, count(*) AS n_parsed FROM p GROUP BY GROUPING SETS ((water_year, cls), (water_year))),
q AS (SELECT {WY.format(t="start_time")} AS water_year, CASE label WHEN 'pulse' THEN 'oxic' ELSE label END AS cls FROM iv),
e AS (SELECT water_year, CASE WHEN grouping(cls) = 1 THEN 'total' ELSE cls END AS cls, count(*) AS n_declared FROM q GROUP BY GROUPING SETS ((water_year, cls), (water_year)))
SELECT water_year, cls, coalesce(n_parsed, 0) AS n_parsed, coalesce(n_declared, 0) AS n_declared, coalesce(n_parsed, 0) - coalesce(n_declared, 0) AS delta FROM n FULL JOIN e USING (water_year, cls)""")
def tally_reconcile(iv, moments):
    """Parsed children per water year of the parent's start and class, against the tally of the parents' own labels."""
    year = S.water_year(F.col("start_time")).alias("water_year")
    parsed = moments.join(iv.select(F.col("interval_id").alias("parent_id"), year), "parent_id").withColumnRenamed("type", "cls")
    declared = iv.select(year, S.remap(F.col("label"), {"pulse": "oxic"}).alias("cls"))
    a, b = (L.counted_with_total(d, "water_year", "cls").withColumnRenamed("n", n) for d, n in ((parsed, "n_parsed"), (declared, "n_declared")))
    d = a.join(b, ["water_year", "cls"], "full").fillna(0, ["n_parsed", "n_declared"])
    return d.select("water_year", "cls", "n_parsed", "n_declared", (F.col("n_parsed") - F.col("n_declared")).alias("delta"))


@query("iv", sql="SELECT interval_id, start_time + INTERVAL 1 HOUR * (interval_id % 23) AS healed FROM iv")
def heal_time_only(iv):
    clock = F.date_format(F.timestamp_micros(S.micros(F.col("start_time")) + (F.col("interval_id") % 23) * 3_600_000_000), "HH:mm")
    return iv.select("interval_id", S.heal_time(clock, F.col("start_time")).alias("healed"))


@query("moments", sql="SELECT parent_id, list(CAST(floor(epoch(end_time - start_time) / 60) AS BIGINT) ORDER BY moment_idx)[1] AS first_min, count(*) AS n FROM moments GROUP BY 1")
def list_minutes_between(moments):
    g = moments.groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct("moment_idx", "start_time", "end_time"))).alias("m"))
    mins = F.zip_with(F.transform("m", lambda x: x.start_time), F.transform("m", lambda x: x.end_time), S.minutes_between)
    return g.select("parent_id", F.get(mins, F.lit(0)).alias("first_min"), F.size("m").cast("long").alias("n"))


# ---- metrics


@query("scored", sql="SELECT t AS true, p AS pred, count(unit_id) AS n FROM (VALUES (0), (1)) a(t) CROSS JOIN (VALUES (0), (1)) b(p) LEFT JOIN scored ON y = t AND pred = p GROUP BY 1, 2")
def confusion_grid(scored):
    return M.confusion(scored, "y", "pred", [0, 1])


@query("scored", sql="""WITH c AS (SELECT y, pred, count(*)::DOUBLE AS n FROM scored GROUP BY 1, 2), m AS (SELECT c, sum(n) FILTER (WHERE y = c) AS t, sum(n) FILTER (WHERE pred = c) AS p, coalesce(sum(n) FILTER (WHERE y = c AND pred = c), 0) AS tp FROM c, (VALUES (0), (1)) v(c) GROUP BY 1),
a AS (SELECT sum(tp) AS h, sum(t) AS n, sum(t * p) AS tps, sum(t * t) AS tt, sum(p * p) AS pp, avg(2 * tp / (t + p)) AS f1, avg(tp / t) AS b FROM m)
SELECT round(h / n, 5) AS accuracy, round(f1, 5) AS macro_f1, round(b, 5) AS balanced, round((h / n - tps / (n * n)) / (1 - tps / (n * n)), 5) AS kappa, round((h * n - tps) / sqrt((n * n - pp) * (n * n - tt)), 5) AS mcc FROM a""")
def class_metrics(scored):
    return rounded(M.class_metrics(M.confusion(scored, "y", "pred", [0, 1])))


@query("scored", sql="""WITH c AS (SELECT lang, y, pred, count(*)::DOUBLE AS n FROM scored GROUP BY 1, 2, 3), s AS (SELECT lang, sum(n) AS n, sum(n) FILTER (WHERE y = pred) AS h, sum(n) FILTER (WHERE y = 1) AS y1, sum(n) FILTER (WHERE pred = 1) AS p1 FROM c GROUP BY 1)
SELECT lang, round((h / n - (y1 * p1 + (n - y1) * (n - p1)) / (n * n)) / (1 - (y1 * p1 + (n - y1) * (n - p1)) / (n * n)), 5) AS kappa FROM s""")
def cohen_kappa(scored):
    g = scored.groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("y") == F.col("pred")).alias("h"), F.count_if(F.col("y") == 1).alias("y1"), F.count_if(F.col("pred") == 1).alias("p1"))
    e = (F.col("y1") * F.col("p1") + (F.col("n") - F.col("y1")) * (F.col("n") - F.col("p1"))) / (F.col("n") * F.col("n"))
    return rounded(g.select("lang", ((F.col("h") / F.col("n") - e) / (1 - e)).alias("kappa")))


@query("scored", sql="SELECT a.lang, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 5) AS auc FROM scored a JOIN scored b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY 1")
def roc_auc_exact(scored):
    return rounded(M.roc_auc(scored, "y", "score", ["lang"]))


@query("scored", sql="""WITH s AS (SELECT lang, score, count(*) FILTER (WHERE y = 1) AS p, count(*) AS n FROM scored GROUP BY 1, 2), c AS (SELECT lang, p, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM s WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, round(sum(p * tp / k) / sum(p), 5) AS ap FROM c GROUP BY 1""")
def average_precision(scored):
    return rounded(M.average_precision(scored, "y", "score", ["lang"]))


@query("scored", sql="SELECT unit_id, round(-(q * log2(q) + (1 - q) * log2(1 - q)), 5) AS bits FROM (SELECT unit_id, least(greatest(score, 1e-12), 1 - 1e-12) AS q FROM scored)")
def entropy_bits(scored):
    return rounded(scored.select("unit_id", S.entropy_bits(F.col("score")).alias("bits")))


@query("scored", sql="SELECT unit_id, round(count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY y)), 5) AS weight FROM scored")
def balanced_weights(scored):
    n = scored.groupBy("y").agg(F.count(F.lit(1)).alias("c"))
    k = n.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    return rounded(scored.join(F.broadcast(n.crossJoin(k)), "y").select("unit_id", (F.col("n") / (F.col("k") * F.col("c"))).alias("weight")))  # one row a class


@query("scored", sql="SELECT max(c) AS largest, round(max(c) / sum(c), 5) AS base_rate, count(*) AS classes FROM (SELECT y, count(*) AS c FROM scored GROUP BY 1)")
def class_base_rate(scored):
    return rounded(scored.groupBy("y").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("largest"), (F.max("c") / F.sum("c")).alias("base_rate"), F.count(F.lit(1)).alias("classes")))


# ---- weak supervision over readings

VOTERS: K.Voters = {"sal_band": ("sal", 0.3, 0.7, -1, 1, False), "lvl_band": ("lvl", 0.25, 0.75, 1, -1, False), "temp_band": ("temp", 0.33, 0.67, -1, 1, False), "absent": ("nothing", 0.1, 0.9, 1, -1, False)}
NAMES = ["sal_band", "lvl_band", "temp_band"]
FIXED = {"sal_band": 0.5, "lvl_band": 0.3, "temp_band": 0.2}
VOTED = "q AS (SELECT " + ", ".join(f"quantile_cont({v[0]}, {v[1]}) AS {k}_lo, quantile_cont({v[0]}, {v[2]}) AS {k}_hi" for k, v in VOTERS.items() if k in NAMES) + " FROM readings), vt AS (SELECT readings.*, " + ", ".join(
    f"CASE WHEN {v[0]} >= {k}_hi THEN {v[4]} WHEN {v[0]} <= {k}_lo THEN {v[3]} ELSE 0 END AS {k}" for k, v in VOTERS.items() if k in NAMES
) + " FROM readings, q)"


@query("readings", sql=f"WITH {VOTED} SELECT series_id, ts, {', '.join(NAMES)} FROM vt")
def lf_votes(readings):
    return K.votes(readings, VOTERS).select("series_id", "ts", *NAMES)


@query("readings", sql=f"WITH {VOTED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(avg({a} * {b}) FILTER (WHERE {a} <> 0 AND {b} <> 0), 5) AS agree, count(*) FILTER (WHERE {a} <> 0 AND {b} <> 0) AS n FROM vt" for a, b in (("sal_band", "lvl_band"), ("sal_band", "temp_band"), ("lvl_band", "temp_band"))))
def lf_agreement(readings):
    return rounded(K.agreement(K.votes(readings, VOTERS), NAMES))


@query("readings", sql=f"WITH {VOTED}, s AS (SELECT *, 0.5::DOUBLE * sal_band + 0.3::DOUBLE * lvl_band + 0.2::DOUBLE * temp_band AS sc FROM vt) SELECT series_id, ts, round(sc, 5) AS vote_score, round(CASE WHEN round(sc, 9) >= 0 THEN 1 / (1 + exp(-sc)) ELSE 1 - 1 / (1 + exp(-sc)) END, 5) AS vote_prob, CASE WHEN round(sc, 9) >= 0 THEN 'hot' ELSE 'pulse' END AS vote_label FROM s")
def lf_score_fixed_weights(readings):
    d = K.weighted(K.votes(readings, VOTERS), FIXED)
    return rounded(d.select("series_id", "ts", "vote_score", "vote_prob", F.when(F.round("vote_score", 9) >= 0, "hot").otherwise("pulse").alias("vote_label")))


@query("readings", sql=f"WITH {VOTED} " + " UNION ALL ".join(f"SELECT '{k}' AS voter, round(avg(({k} <> 0)::INT), 5) AS coverage, count(*) FILTER (WHERE {k} > 0) AS n_up, count(*) FILTER (WHERE {k} < 0) AS n_down, round(avg(({k} <> 0 AND (" + " OR ".join(f"({j} <> 0 AND {j} <> {k})" for j in NAMES if j != k) + f"))::INT), 5) AS conflict, round({FIXED[k]}::DOUBLE, 5) AS weight FROM vt" for k in NAMES))
def lf_analysis(readings):
    return rounded(K.analysis(K.votes(readings, VOTERS), NAMES, FIXED))


@query("readings")
def weak_labels(readings):
    voted = K.votes(readings, VOTERS)
    return rounded(K.weighted(voted, K.label_model(K.agreement(voted, NAMES), NAMES)).select("series_id", "ts", "vote_score", "vote_prob", "vote_label"))


# ---- statistics


@query("orders", sql=f"SELECT {WY.format(t='o_orderdate')} AS water_year, round(quantile_cont(o_totalprice::DOUBLE, 0.95), 3) AS p95, round(avg(o_totalprice::DOUBLE), 3) AS mean, count(*) AS n FROM orders GROUP BY 1")
def annual_aggregate(orders):
    return rounded(orders.groupBy(S.water_year(F.col("o_orderdate")).alias("water_year")).agg(F.percentile(F.col("o_totalprice").cast("double"), F.lit(0.95)).alias("p95"), F.avg(F.col("o_totalprice").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n")), 3)


@query("orders", sql=f"WITH a AS (SELECT {WY.format(t='o_orderdate')} AS wy, avg((o_orderstatus = 'F')::INT) AS share FROM orders GROUP BY 1) SELECT round(regr_slope(share, wy), 5) + 0.0 AS slope, round(regr_r2(share, wy), 5) AS r2, round(regr_slope(share, wy) * (max(wy) - min(wy)), 5) + 0.0 AS change FROM a")
def annual_trend(orders):
    a = orders.groupBy(S.water_year(F.col("o_orderdate")).alias("wy")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("share"))
    return rounded(a.agg(F.regr_slope("share", "wy").alias("slope"), F.regr_r2("share", "wy").alias("r2"), (F.regr_slope("share", "wy") * (F.max("wy") - F.min("wy"))).alias("change")))


@query("orders", sql="SELECT year(o_orderdate)::BIGINT AS year, round(avg((o_orderstatus = 'F')::INT), 5) AS share, count(*) AS n FROM orders GROUP BY 1")
def yearly_share(orders):
    return rounded(orders.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("share"), F.count(F.lit(1)).alias("n")))


@query("orders", sql="SELECT CAST(floor((month(o_orderdate) % 12) / 3) AS BIGINT) AS season, o_orderstatus AS cls, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY floor((month(o_orderdate) % 12) / 3)), 5) AS share FROM orders GROUP BY floor((month(o_orderdate) % 12) / 3), 2")
def season_counts(orders):
    d = orders.groupBy(S.season(F.col("o_orderdate")).alias("season"), F.col("o_orderstatus").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("season"))))


PERIODS = (24.0, 12.0, 168.0)


@query("readings", sql="""WITH d AS (SELECT series_id, epoch(ts) / 3600 AS h, lvl - avg(lvl) OVER (PARTITION BY series_id) AS x FROM readings WHERE lvl IS NOT NULL)
SELECT series_id, p AS period_h, round((pow(sum(x * cos(2 * pi() * h / p)), 2) + pow(sum(x * sin(2 * pi() * h / p)), 2)) / pow(count(*), 2), 5) AS power FROM d, (VALUES (24.0::DOUBLE), (12.0::DOUBLE), (168.0::DOUBLE)) v(p) GROUP BY 1, 2""")
def named_period_power(readings):
    d = readings.where("lvl IS NOT NULL").select("series_id", (S.micros(F.col("ts")) / 3.6e9).alias("h"), (F.col("lvl") - F.avg("lvl").over(Window.partitionBy("series_id"))).alias("x"))
    d = d.withColumn("period_h", F.explode(F.array(*(F.lit(p) for p in PERIODS))))
    a = 2 * F.pi() * F.col("h") / F.col("period_h")
    return rounded(d.groupBy("series_id", "period_h").agg(((F.pow(F.sum(F.col("x") * F.cos(a)), F.lit(2)) + F.pow(F.sum(F.col("x") * F.sin(a)), F.lit(2))) / F.pow(F.count(F.lit(1)), F.lit(2))).alias("power")))


@query("readings", sql="""WITH z AS (SELECT series_id, ts, lvl, (target - avg(target) OVER (PARTITION BY series_id)) / stddev_pop(target) OVER (PARTITION BY series_id) AS z FROM readings WHERE lvl IS NOT NULL AND target IS NOT NULL QUALIFY count(*) OVER (PARTITION BY series_id) >= 10 AND stddev_pop(target) OVER (PARTITION BY series_id) > 0),
c AS (SELECT *, sum(z) OVER (PARTITION BY series_id ORDER BY lvl, ts ROWS UNBOUNDED PRECEDING) AS cs FROM z)
SELECT series_id, CASE WHEN abs(min(cs)) >= abs(max(cs)) THEN 'bowl' ELSE 'dome' END AS form, round(CASE WHEN abs(min(cs)) >= abs(max(cs)) THEN arg_min(lvl, cs) ELSE arg_max(lvl, cs) END, 5) AS turning FROM c GROUP BY 1""")
def cusum_inflection(readings):
    w = Window.partitionBy("series_id")
    d = readings.where("lvl IS NOT NULL AND target IS NOT NULL").withColumns({"mean": F.avg("target").over(w), "sd": F.stddev_pop("target").over(w), "rows": F.count(F.lit(1)).over(w)})
    z = d.where("rows >= 10 AND sd > 0").withColumn("z", (F.col("target") - F.col("mean")) / F.col("sd"))  # a target that never changes has no turning
    c = z.withColumn("cs", F.sum("z").over(w.orderBy("lvl", "ts").rowsBetween(Window.unboundedPreceding, 0)))
    bowl = F.abs(F.min("cs")) >= F.abs(F.max("cs"))
    return rounded(c.groupBy("series_id").agg(F.when(bowl, "bowl").otherwise("dome").alias("form"), F.when(bowl, F.min_by("lvl", "cs")).otherwise(F.max_by("lvl", "cs")).alias("turning")))


@query("scored", sql="SELECT lang AS cluster, grp AS cls, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 5) AS share FROM scored GROUP BY 1, 2")
def cluster_composition(scored):
    d = scored.groupBy(F.col("lang").alias("cluster"), F.col("grp").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(d.select("cluster", "cls", (F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))).alias("share")))


@query("readings", sql="SELECT series_id, ts, round(coalesce(lvl, m), 5) AS lvl FROM readings, (SELECT median(lvl) AS m FROM readings)")
def impute_median(readings):
    return rounded(readings.select("series_id", "ts", F.coalesce("lvl", F.lit(exact_quantiles(readings, ["lvl"], [0.5])["lvl"][0])).alias("lvl")))


@query("readings", sql="SELECT series_id, ts, round((lvl - m) / s, 5) + 0.0 AS lvl FROM readings, (SELECT avg(lvl) AS m, stddev_pop(lvl) AS s FROM readings)")
def scale_population(readings):
    return rounded(readings.crossJoin(F.broadcast(readings.agg(F.avg("lvl").alias("m"), F.stddev_pop("lvl").alias("s")))).select("series_id", "ts", ((F.col("lvl") - F.col("m")) / F.col("s")).alias("lvl")))  # one row


@query("readings", sql="SELECT series_id, ts, round(ln(1 + coalesce(precip, m)), 5) AS precip FROM readings, (SELECT median(precip) AS m FROM readings)")
def log_mix(readings):
    return rounded(readings.select("series_id", "ts", F.log1p(F.coalesce("precip", F.lit(exact_quantiles(readings, ["precip"], [0.5])["precip"][0]))).alias("precip")))


# ---- folds


@query("scored", sql="SELECT unit_id, grp AS fold FROM scored")
def logo_folds(scored):
    return scored.select("unit_id", F.col("grp").alias("fold"))


@query("scored", sql="""WITH g AS (SELECT grp, mode(lang ORDER BY lang) AS m FROM scored GROUP BY 1), c AS (SELECT grp, lang, count(*) AS n FROM scored GROUP BY 1, 2), d AS (SELECT grp, lang FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, lang) AS rn FROM c) WHERE rn = 1),
f AS (SELECT grp, (row_number() OVER (PARTITION BY lang ORDER BY md5('7' || grp), grp) - 1) % 5 AS fold FROM d) SELECT unit_id, fold FROM scored JOIN f USING (grp)""")
def group_folds(scored):
    return with_group_folds(scored, "grp", "lang", 5, 7).select("unit_id", "fold")


def with_group_folds(df, group: str, cls: str, k: int, seed: int):
    """df with fold: whole groups, ranked in a seeded order within their most frequent class, dealt in turn to k folds."""
    n = df.groupBy(group, cls).agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), cls))).where("rn = 1")
    order = Window.partitionBy(cls).orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(group))), group)
    return df.join(top.select(group, F.pmod(F.row_number().over(order) - 1, F.lit(k)).cast("long").alias("fold")), group)


@query("iv", sql="SELECT interval_id, row_number() OVER (ORDER BY start_time, interval_id) <= floor(0.7 * count(*) OVER ()) AS is_train FROM iv")
def temporal_cut(iv):
    n = iv.agg(F.floor(F.count(F.lit(1)) * F.lit(0.7).cast("decimal(2,1)")).alias("k"))
    d = W.prefix_sum(iv.select("interval_id", S.micros(F.col("start_time")).alias("t"), F.lit(1).alias("one")), ["t", "interval_id"], "one", slices=16)
    return d.crossJoin(F.broadcast(n)).select("interval_id", (F.col("running") <= F.col("k")).alias("is_train"))  # one row


@query("iv", sql="""WITH c AS (SELECT label, row_number() OVER (ORDER BY start_time, interval_id) <= floor(0.7 * count(*) OVER ()) AS is_train FROM iv)
SELECT is_train, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY is_train), 5) AS share FROM c GROUP BY 1, 2""")
def temporal_class_counts(iv):
    """Classes before and after the cut in time."""
    n = temporal_cut(iv).join(iv.select("interval_id", "label"), "interval_id").groupBy("is_train", "label").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("is_train"))))  # a row a class


# ---- forecasting


@query("readings", sql=f"""WITH {GRID}, f AS (SELECT series_id, ts, coalesce(last_value(lvl IGNORE NULLS) OVER w, 50.0) AS v, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM gc WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT o.series_id, o.ts AS origin, round(sum(h.v) FILTER (WHERE h.i < o.i), 5) AS history_sum, round(max(h.v) FILTER (WHERE h.i >= o.i), 5) AS future_max FROM f o JOIN f h ON o.series_id = h.series_id AND h.i BETWEEN o.i - 48 AND o.i + 11
WHERE o.i >= 48 AND o.i + 12 <= o.n AND (o.i - 48) % 24 = 0 GROUP BY 1, 2""")
def windows_history(readings):
    h = W.histories(_filled(readings), "lvl", 48, 12, 24)
    return rounded(h.select("series_id", "origin", F.aggregate("history", F.lit(0.0), lambda a, x: a + x).alias("history_sum"), F.array_max("future").alias("future_max")))


def _filled(readings):
    return W.forward_fill(W.complete_grid(readings), {"lvl": 50.0})


FC = GRID + """, f AS (SELECT series_id, ts, coalesce(last_value(lvl IGNORE NULLS) OVER w, 50.0) AS v, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM gc WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
oh AS (SELECT o.series_id, o.ts AS origin, h.i - o.i AS k, h.v AS y, o.i AS oi FROM f o JOIN f h ON o.series_id = h.series_id AND h.i BETWEEN o.i AND o.i + 11 WHERE o.i >= 48 AND o.i + 12 <= o.n AND (o.i - 48) % 24 = 0)"""


@query("readings", sql=f"WITH {FC} SELECT oh.series_id, origin, round(sqrt(avg(pow(y - p.v, 2))), 5) AS rmse, round(avg(abs(y - p.v)), 5) AS mae FROM oh JOIN f p ON p.series_id = oh.series_id AND p.i = oi - 1 GROUP BY 1, 2")
def persistence_score(readings):
    h = W.histories(_filled(readings), "lvl", 48, 12, 24)
    return forecast_score(h.withColumn("forecast", F.array_repeat(F.element_at("history", -1), 12)))


@query("readings", sql=f"WITH {FC} SELECT oh.series_id, origin, round(sqrt(avg(pow(y - p.v, 2))), 5) AS rmse, round(avg(abs(y - p.v)), 5) AS mae FROM oh JOIN f p ON p.series_id = oh.series_id AND p.i = oi - 24 + k % 24 GROUP BY 1, 2")
def seasonal_naive_score(readings):
    h = W.histories(_filled(readings), "lvl", 48, 12, 24)
    return forecast_score(h.withColumn("forecast", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.get("history", 24 + k % 24))))


def forecast_score(h):
    """(series_id, origin, rmse, mae) of rows with the arrays future and forecast."""
    e = F.zip_with("future", "forecast", lambda y, p: y - p)
    n = F.size("future")
    sq = F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x) / n
    ab = F.aggregate(e, F.lit(0.0), lambda a, x: a + F.abs(x)) / n
    return rounded(h.select("series_id", "origin", F.sqrt(sq).alias("rmse"), ab.alias("mae")))


@query("readings", sql=f"WITH {FC} SELECT series_id, round(avg(abs(d)), 5) AS scale FROM (SELECT series_id, v - lag(v, 24) OVER (PARTITION BY series_id ORDER BY i) AS d FROM f) GROUP BY 1")
def mase_scale(readings):
    return rounded(_filled(readings).select("series_id", F.abs(F.col("lvl") - F.lag("lvl", 24).over(W.series())).alias("d")).groupBy("series_id").agg(F.avg("d").alias("scale")))


@query("orders", sql=f"SELECT {WY.format(t='o_orderdate')} AS test_year, count(*) AS n_test, sum(count(*)) OVER (ORDER BY {WY.format(t='o_orderdate')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS n_train FROM orders GROUP BY 1")
def fold_by_water_year(orders):
    n = orders.groupBy(S.water_year(F.col("o_orderdate")).alias("test_year")).agg(F.count(F.lit(1)).alias("n_test"))
    return n.withColumn("n_train", F.sum("n_test").over(Window.orderBy("test_year").rowsBetween(Window.unboundedPreceding, -1)))


@query("readings", sql=f"""WITH {FC} SELECT series_id, ts, round(lag(v) OVER w - lag(v, 7) OVER w, 5) + 0.0 AS rise_6h, round(lag(v) OVER w - lag(v, 25) OVER w, 5) + 0.0 AS rise_24h, lag(v) OVER w <= 60 AND max(v) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) > 60 AS onset FROM f WINDOW w AS (PARTITION BY series_id ORDER BY ts)""")
def onset_features(readings):
    """Features end before the hours in which an onset is looked for."""
    w, v = W.series(), F.col("lvl")
    ago = lambda h: F.lag(v, h).over(w)
    return rounded(_filled(readings).select("series_id", "ts", (ago(1) - ago(7)).alias("rise_6h"), (ago(1) - ago(25)).alias("rise_24h"), ((F.lag(v).over(w) <= 60) & (F.max(v).over(w.rowsBetween(0, 5)) > 60)).alias("onset")))


# ---- scalar functions


@query("documents", sql="SELECT doc_id, lower(trim(source)) || '#' || doc_id AS k, starts_with(source, 'src1') AS s1, contains(source, '9') AS nine, regexp_extract(source, '([0-9]+)', 1) AS num FROM documents")
def scalar_string(documents):
    s = F.col("source")
    return documents.select("doc_id", F.concat(F.lower(F.trim(s)), F.lit("#"), F.col("doc_id").cast("string")).alias("k"), s.startswith("src1").alias("s1"), s.contains("9").alias("nine"), F.regexp_extract(s, "([0-9]+)", 1).alias("num"))


@query("events", sql=f"SELECT event_id, {WY.format(t='ts')} AS wy, CAST(floor((month(ts) % 12) / 3) AS BIGINT) AS season, round(year(ts) + (dayofyear(ts) - 1) / 365.25::DOUBLE, 5) AS frac FROM events")
def scalar_date(events):
    t = F.col("ts")
    return rounded(events.select("event_id", S.water_year(t).alias("wy"), S.season(t).alias("season"), S.year_fraction(t).alias("frac")))


@query("iv", sql="SELECT interval_id, CAST(floor(epoch(end_time - start_time) / 60) AS BIGINT) AS mins, epoch(end_time - start_time)::DOUBLE AS secs, end_time + INTERVAL 36 HOUR AS later FROM iv")
def scalar_duration(iv):
    a, b = F.col("start_time"), F.col("end_time")
    return iv.select("interval_id", S.minutes_between(a, b).alias("mins"), S.seconds_between(a, b).alias("secs"), (b + F.expr("INTERVAL '36' HOUR")).alias("later"))


@query("events", sql="SELECT event_id, round(ln(1 + value), 5) AS l1, round(log10(value + 1), 5) AS l10, round(sqrt(value), 5) AS rt, round(least(greatest(value, 10), 90), 5) AS clipped, round(1 / (1 + exp(-value / 50)), 5) AS sig FROM events")
def scalar_math(events):
    v = F.col("value")
    return rounded(events.select("event_id", F.log1p(v).alias("l1"), F.log10(v + 1).alias("l10"), F.sqrt(v).alias("rt"), F.least(F.greatest(v, F.lit(10.0)), F.lit(90.0)).alias("clipped"), S.sigmoid(v / 50).alias("sig")))


@query("events", sql="SELECT event_id, round(CASE WHEN value <= 0 THEN 1 WHEN value >= 100 THEN 5 WHEN value < 50 THEN 1 + value / 50 * 8 ELSE 9 - (value - 50) / 50 * 4 END, 5) AS y FROM events")
def interp_points(events):
    pts = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    return rounded(events.select("event_id", S.interpolate(F.col("value"), pts(0, 50, 100), pts(1, 9, 5)).alias("y")))


@query("iv", sql="SELECT interval_id, CAST(k AS BIGINT) AS step, round(10 + (interval_id % 7) * k / 4.0::DOUBLE, 5) AS x FROM iv, range(5) AS r(k)")
def linspace_grid(iv):
    return rounded(iv.select("interval_id", F.posexplode(S.linspace(F.lit(10.0), F.lit(10.0) + F.col("interval_id") % 7, 5)).alias("step", "x")).withColumn("step", F.col("step").cast("long")))


@query("scored", sql="SELECT lang, printf('%.3f ± %.3f', avg(score), stddev_pop(score)) AS stat FROM scored GROUP BY 1")
def fmt_mean_std(scored):
    return scored.groupBy("lang").agg(S.mean_std_text(F.avg("score"), F.stddev_pop("score")).alias("stat"))


@query("scored", sql="SELECT unit_id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.5 END, 5) AS v FROM scored WINDOW w AS (PARTITION BY grp)")
def minmax_norm(scored):
    w = Window.partitionBy("grp")
    return rounded(scored.select("unit_id", S.min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w)).alias("v")))


@query("scored", sql="SELECT unit_id, round(exp(score) / (exp(score) + exp(pred) + 1), 5) AS p FROM scored")
def softmax_vec(scored):
    return rounded(scored.select("unit_id", F.get(S.softmax(F.array(F.col("score"), F.col("pred").cast("double"), F.lit(0.0))), F.lit(0)).alias("p")))


@query("scored", sql="SELECT lang AS model, printf('%.3f ± %.3f', avg(score) FILTER (WHERE y = 0), stddev_pop(score) FILTER (WHERE y = 0)) AS neg, printf('%.3f ± %.3f', avg(score) FILTER (WHERE y = 1), stddev_pop(score) FILTER (WHERE y = 1)) AS pos FROM scored GROUP BY 1")
def result_pivot(scored):
    d = scored.groupBy(F.col("lang").alias("model"), F.when(F.col("y") == 1, "pos").otherwise("neg").alias("metric")).agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    return d.groupBy("model").pivot("metric", ["neg", "pos"]).agg(F.first(S.mean_std_text(F.col("m"), F.col("s"))))
