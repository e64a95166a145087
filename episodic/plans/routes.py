"""Queries of the routes' feature tables, what is shown of them, and further label rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import events as E
from ..operators import labels as L
from ..operators import routes as R
from ..operators import weak as K
from .registry import OFF_TIES, QUERIES, SQL, query, rounded
from .series import DETECT, GAP, MEMBERS, PAIRS, PEAK
from .tables import CELLS, cells
from .views import VIEWS

# ---- hysteresis


def hysteresis_sql(driver: str) -> str:
    keys = "series_id, eid"
    return f"""WITH {MEMBERS}, h0 AS (SELECT {keys}, ts, target, {driver} AS drv FROM mem WHERE target IS NOT NULL AND {driver} IS NOT NULL),
h1 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS i, min(drv) OVER w AS lo, max(drv) OVER w AS hi, max(target) OVER w AS top, count(*) OVER w AS n FROM h0 WINDOW w AS (PARTITION BY {keys})),
h2 AS (SELECT *, min(CASE WHEN target = top THEN i END) OVER (PARTITION BY {keys}) AS ap FROM h1),
h3 AS (SELECT {keys}, i, ap, (drv - lo) / (hi - lo) AS x, target / top AS y FROM h2 WHERE hi - lo >= 1e-9 AND ap >= 1 AND ap < n - 1),
lim AS (SELECT {keys}, 'r' AS limb, x, y FROM h3 WHERE i <= ap UNION ALL SELECT {keys}, 'f', x, y FROM h3 WHERE i >= ap),
gp AS (SELECT DISTINCT {keys}, limb, 0.05::DOUBLE + 0.1::DOUBLE * k AS g FROM lim, range(0, 10) AS q(k)),
hlo AS (SELECT gp.*, p.x AS x0, p.y AS y0 FROM gp ASOF LEFT JOIN lim p ON gp.series_id = p.series_id AND gp.eid = p.eid AND gp.limb = p.limb AND gp.g >= p.x),
hup AS (SELECT hlo.*, p.x AS x1, p.y AS y1 FROM hlo ASOF LEFT JOIN lim p ON hlo.series_id = p.series_id AND hlo.eid = p.eid AND hlo.limb = p.limb AND hlo.g < p.x),
hv AS (SELECT {keys}, limb, g, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (g - x0) / (x1 - x0) END AS v FROM hup),
hd AS (SELECT a.series_id, a.eid, avg(a.v - b.v) AS h FROM hv a JOIN hv b ON a.series_id = b.series_id AND a.eid = b.eid AND a.g = b.g AND a.limb = 'r' AND b.limb = 'f' GROUP BY 1, 2)
SELECT m.series_id, m.eid, round(h, 5) + 0.0 AS hysteresis FROM (SELECT DISTINCT {keys} FROM mem) m LEFT JOIN hd ON m.series_id = hd.series_id AND m.eid = hd.eid"""


@query("readings", sql=hysteresis_sql("lvl"))
def hysteresis_index(readings):
    return rounded(E.hysteresis(E.member_rows(E.excursions(readings, PEAK, GAP), readings), "lvl"))


@query("readings", sql=hysteresis_sql("sal"))
def hysteresis_salinity(readings):
    return rounded(E.hysteresis(E.member_rows(E.excursions(readings, PEAK, GAP), readings), "sal"))


# ---- feature tables of the three routes

PARTS = ("event_shape_features", "centroid_plateau", "max_step", "driver_steps", "driver_context", "hysteresis_index", "hysteresis_salinity")
#: What a part's columns are called in the table.
NAMED = {"hysteresis_index": "hysteresis AS hyst_wl", "hysteresis_salinity": "hysteresis AS hyst_sal"}
SHOWN = R.NUMERIC
#: The units of a route in place of detected excursions.
UNITS = {
    "auto": DETECT,
    "events": f"iv AS ({VIEWS['iv'].format(ntz='TIMESTAMP')}), ev AS (SELECT series_id, interval_id AS eid, start_time, end_time FROM iv)",
    "moments": f"iv AS ({VIEWS['iv'].format(ntz='TIMESTAMP')}), moments AS ({VIEWS['moments'].format(ntz='TIMESTAMP')}), ev AS (SELECT series_id, parent_id * 100 + moment_idx AS eid, start_time, end_time FROM moments)",
}


def route_sql(route: str) -> str:
    """The queries that make up the table, each over the route's units, joined."""
    joined = ""
    for i, part in enumerate(PARTS):
        text = SQL[part].replace(DETECT, UNITS[route])
        text = f"SELECT series_id, eid, {NAMED[part]} FROM ({text})" if part in NAMED else text
        joined += f"({text}) AS p{i}" if not i else f" JOIN ({text}) AS p{i} USING (series_id, eid)"
    return f"SELECT series_id, eid, {', '.join(SHOWN)} FROM {joined}"


def feature_rows(route, readings, iv, moments):
    return R.feature_table(R.units(route, readings, iv, moments, PEAK, GAP), readings)


for _route in R.ROUTES:

    def _table(readings, iv, moments, route=_route):
        return rounded(feature_rows(route, readings, iv, moments).select("series_id", "eid", *SHOWN))

    _table.__name__ = f"feature_table_{_route}"
    query("readings", "iv", "moments")(_table)
    SQL[_table.__name__] = route_sql(_route)


#: Subtype codes of labelled intervals, in turn; the last has no meaning listed under any letter.
CODES = [*R.MEANINGS, "o9", "z1"]
#: Readings before this time count as spliced in.
SPLICED = "2024-01-09 00:00:00"
_code = "(['" + "', '".join(CODES) + f"'])[CAST(interval_id % {len(CODES)} AS INT) + 1]"


def coded(iv):
    """Labelled intervals with a subtype, and flooding, which is unknown for some."""
    return iv.withColumns({"subtype": F.element_at(F.array(*(F.lit(c) for c in CODES)), (F.col("interval_id") % len(CODES)).cast("int") + 1), "flooding": F.when(F.col("interval_id") % 5 != 0, F.col("interval_id") % 2 == 0)})


@query("readings", "iv", "moments")
def feature_table_full(readings, iv, moments):
    """All three routes with all features and what is known of the units."""
    flagged = readings.withColumn("is_backfill", F.col("ts") < F.lit(SPLICED).cast("timestamp_ntz"))
    parts = [feature_rows(r, flagged, coded(iv), moments).withColumn("route", F.lit(r)) for r in R.ROUTES]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _full_sql() -> str:
    """Each route's features beside its units' metadata."""
    views = f"readings AS ({VIEWS['readings'].format(ntz='TIMESTAMP')}), iv AS ({VIEWS['iv'].format(ntz='TIMESTAMP')}), moments AS ({VIEWS['moments'].format(ntz='TIMESTAMP')})"
    meta = {
        "auto": "SELECT ev.series_id, ev.eid, 'auto#' || ev.eid AS unit_id, be.interval_id AS event_id, ev.start_time, ev.end_time, be.label FROM ev LEFT JOIN be ON ev.series_id = be.series_id AND ev.eid = be.eid",
        "events": "SELECT series_id, interval_id, CAST(interval_id AS VARCHAR), interval_id, start_time, end_time, label FROM iv",
        "moments": "SELECT series_id, parent_id * 100 + moment_idx, parent_id || '#' || moment_idx, parent_id, start_time, end_time, type FROM moments",
    }
    route = lambda r: f"""SELECT m.*, '{r}' AS route, {", ".join(SHOWN)} FROM ({meta[r]}) m (series_id, eid, unit_id, event_id, start_time, end_time, label) JOIN ({SQL[f"feature_table_{r}"]}) f ON m.series_id = f.series_id AND m.eid = f.eid"""
    rows = " UNION ALL ".join(route(r) for r in R.ROUTES)
    # a unit's first reading is the first one at or after its start
    return f"""WITH {views}, {PAIRS}, u AS ({rows}), b AS (SELECT u.*, r.ts AS first_ts FROM u ASOF LEFT JOIN (SELECT series_id, ts FROM readings) r ON u.series_id = r.series_id AND u.start_time <= r.ts)
SELECT b.* EXCLUDE (first_ts), {_code.replace("interval_id", "event_id")} AS subtype, CASE WHEN event_id IS NULL THEN 'inferred' ELSE 'expert' END AS label_source, CASE WHEN event_id IS NULL THEN 'holdout' ELSE 'train' END AS split,
first_ts < TIMESTAMP '{SPLICED}' AS is_backfill FROM b"""


SQL["feature_table_full"] = _full_sql()
EVENTS = f"({SQL['feature_table_events']})"


def _signed_round(x, digits: int):
    """x rounded half up, with its sign where it comes to zero (-0.0 is shown as -0.00)."""
    return F.round(F.abs(x), digits) * F.when(x < 0, -1.0).otherwise(1.0)


@query("readings", "iv", "moments")
def summary_card(readings, iv, moments):
    of = coded(iv)
    f = rounded(feature_rows("events", readings, of, moments))
    f = f.join(of.select(F.col("interval_id").alias("event_id"), "flooding"), "event_id", "left").join(R.segments(R.units("auto", readings, of, moments, PEAK, GAP)), "event_id", "left")
    shown = f.withColumns({c: _signed_round(F.col(c) + OFF_TIES, n) for c, n in (("peak_do", 2), ("sal_step", 2), ("wl_step", 2), ("precip_24h", 1))})
    return R.summary_card(shown)


def _card_sql() -> str:
    views = f"readings AS ({VIEWS['readings'].format(ntz='TIMESTAMP')}), iv AS ({VIEWS['iv'].format(ntz='TIMESTAMP')})"
    means = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.MEANINGS.items()) + " ELSE coalesce(CASE left(code, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.MEANINGS.items() if len(k) == 1) + " END, '-') END"
    number = lambda c, form, n, unit="": f"coalesce(format('{form}', round({c} + {OFF_TIES}, {n})) || '{unit}', '-')"
    lines = {
        "unit": "CAST(eid AS VARCHAR)", "class": "label || '  (' || code || ')'", "code means": means, "window": "strftime(start_time, '%Y-%m-%d %H:%M') || ' to ' || strftime(end_time, '%Y-%m-%d %H:%M')", "duration": "format('{:.1f}', dur_min / 60) || ' h'",
        "peak": number("peak_do", "{:.2f}", 2, " mg/L"), "salinity step": number("sal_step", "{:+.2f}", 2), "water-level step": number("wl_step", "{:+.2f}", 2), "precipitation before (24 h)": number("precip_24h", "{:.1f}", 1, " mm"),
        "flooding": "CASE WHEN eid % 5 = 0 THEN '-' WHEN eid % 2 = 0 THEN 'true' ELSE 'false' END", "excursions": "coalesce(n_seg, 0) || ' segment(s)'", "readings": "CAST(n_samples AS VARCHAR)",
    }
    names = ", ".join(f"'{k}'" for k in lines)
    return f"""WITH {views}, {PAIRS}, s AS (SELECT interval_id, count(*) AS n_seg FROM be GROUP BY 1),
f AS (SELECT e.*, iv.label, iv.start_time, iv.end_time, {_code} AS code, n_seg FROM {EVENTS} e JOIN iv ON e.series_id = iv.series_id AND e.eid = iv.interval_id LEFT JOIN s USING (interval_id))
SELECT series_id, eid, CAST(o AS BIGINT) AS ord, k AS field, v AS value FROM (SELECT series_id, eid, unnest(range({len(lines)})) AS o, unnest([{names}]) AS k, unnest([{", ".join(lines.values())}]) AS v FROM f)"""


SQL["summary_card"] = _card_sql()

# ---- seven voters over the labelled events

BAND_VOTERS: K.Voters = {
    "peak_pos": ("peak_frac", 0.33, 0.66, 1, -1, False), "centroid": ("centroid_frac", 0.33, 0.66, 1, -1, False), "onset": ("max_rise_norm", 0.33, 0.66, -1, 1, False), "wl_step_size": ("wl_step", 0.5, 0.75, 0, 1, True),
    "sal_step_up": ("sal_step", 0.5, 0.75, 0, 1, False), "sal_hyst": ("hyst_sal", 0.5, 0.75, 0, 1, True), "rain": ("precip_24h", 0.5, 0.75, 0, -1, False),
}
IN_SQL = [k for k, v in BAND_VOTERS.items() if v[0] in SHOWN]


def voted_events(readings, iv, moments):
    return K.votes(feature_rows("events", readings, iv, moments), BAND_VOTERS)


@query("readings", "iv", "moments")
def event_votes(readings, iv, moments):
    """The votes of all seven voters. Rounded features vote alike."""
    shown = rounded(feature_rows("events", readings, iv, moments).select("series_id", "eid", *SHOWN))
    return K.votes(shown, BAND_VOTERS).select("series_id", "eid", *IN_SQL)


_size = {k: f"abs({v[0]})" if v[5] else v[0] for k, v in BAND_VOTERS.items()}
SQL["event_votes"] = f"""WITH f AS (SELECT * FROM {EVENTS}), q AS (SELECT {", ".join(f"quantile_cont({_size[k]}, {BAND_VOTERS[k][1]}) AS {k}_lo, quantile_cont({_size[k]}, {BAND_VOTERS[k][2]}) AS {k}_hi" for k in IN_SQL)} FROM f)
SELECT series_id, eid, {", ".join(f"CASE WHEN {_size[k]} >= {k}_hi THEN {BAND_VOTERS[k][4]} WHEN {_size[k]} <= {k}_lo THEN {BAND_VOTERS[k][3]} ELSE 0 END AS {k}" for k in IN_SQL)} FROM f, q"""


@query("readings", "iv", "moments")
def event_weak_labels(readings, iv, moments):
    names = list(BAND_VOTERS)
    voted = voted_events(readings, iv, moments)
    return rounded(K.weighted(voted, K.label_model(K.agreement(voted, names), names)).select("series_id", "eid", *names, "vote_score", "vote_prob", "vote_label"))


@query("readings", "iv", "moments")
def event_voter_analysis(readings, iv, moments):
    names = list(BAND_VOTERS)
    voted = voted_events(readings, iv, moments)
    return rounded(K.analysis(voted, names, K.label_model(K.agreement(voted, names), names)))


# ---- shown of features


@query("readings", "iv", "moments")
def feature_strip(readings, iv, moments):
    """Long rows of feature and label, nulls left out."""
    f = rounded(feature_rows("events", readings, iv, moments).select("series_id", "eid", "label", "peak_do", "peak_frac", "wl_step"))
    return f.withColumn("cls", S.remap(F.col("label"), {"pulse": "oxic"})).unpivot(["series_id", "eid", "cls"], ["peak_do", "peak_frac", "wl_step"], "feature", "value").where("value IS NOT NULL")


SQL["feature_strip"] = f"""WITH f AS (SELECT e.*, CASE iv.label WHEN 'pulse' THEN 'oxic' ELSE iv.label END AS cls FROM {EVENTS} e JOIN ({VIEWS['iv'].format(ntz='TIMESTAMP')}) iv ON e.series_id = iv.series_id AND e.eid = iv.interval_id)
SELECT series_id, eid, cls, feature, value FROM (UNPIVOT (SELECT series_id, eid, cls, peak_do, peak_frac, wl_step FROM f) ON peak_do, peak_frac, wl_step INTO NAME feature VALUE value)"""


@query("readings", "iv")
def example_curves(readings, iv):
    """Curves of the two shortest and the two longest intervals over their share of steps."""
    length = S.seconds_between(F.col("start_time"), F.col("end_time"))
    low = iv.withColumn("s", length).orderBy("s", "interval_id").limit(2)
    high = iv.withColumn("s", length).orderBy(F.col("s").desc(), F.col("interval_id").desc()).limit(2)
    c = E.curves(readings, low.unionByName(high).drop("s"), ["lvl"], steps=16).where("valid")
    top = F.greatest(F.max("step").over(Window.partitionBy("series_id", "interval_id")), F.lit(1))
    return rounded(c.select("series_id", "interval_id", (F.col("step") / top).alias("t_norm"), F.round("lvl", 4).alias("lvl")))


def _example_sql() -> str:
    from .series import CURVE

    picked = "iv AS (SELECT * FROM (SELECT * FROM iv0 ORDER BY epoch(end_time - start_time), interval_id LIMIT 2) UNION ALL SELECT * FROM (SELECT * FROM iv0 ORDER BY epoch(end_time - start_time) DESC, interval_id DESC LIMIT 2))"
    return f"""WITH readings AS ({VIEWS["readings"].format(ntz="TIMESTAMP")}), iv0 AS ({VIEWS["iv"].format(ntz="TIMESTAMP")}), {picked}, {CURVE}
SELECT series_id, interval_id, round(step / greatest(max(step) OVER (PARTITION BY series_id, interval_id), 1), 5) AS t_norm,
round(CASE WHEN n >= 2 THEN CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (x - t0) / (t1 - t0) END END, 4) AS lvl FROM hi WHERE x BETWEEN f AND l"""


SQL["example_curves"] = _example_sql()


@query("readings", "iv")
def curves_asymmetric(readings, iv):
    """How many steps of a curve with 6 hours before and a quarter of the length (6 hours at most) after it are inside the readings."""
    c = E.curves(readings, R.padded(iv, 6.0), ["lvl"], steps=16, pad_frac=0.0)
    return c.groupBy("series_id", "interval_id").agg(F.count_if("valid").alias("n_valid"), F.count(F.lit(1)).alias("n"))


SQL["curves_asymmetric"] = f"""WITH readings AS ({VIEWS["readings"].format(ntz="TIMESTAMP")}), iv AS ({VIEWS["iv"].format(ntz="TIMESTAMP")}),
w AS (SELECT series_id, interval_id, epoch(start_time) - 21600 AS a, epoch(end_time) + least(0.25::DOUBLE * epoch(end_time - start_time), 21600) AS b FROM iv),
m AS (SELECT w.series_id, interval_id, a, b, min(epoch(ts)) AS f, max(epoch(ts)) AS l FROM w JOIN readings r ON w.series_id = r.series_id AND epoch(ts) BETWEEN a AND b GROUP BY 1, 2, 3, 4)
SELECT series_id, interval_id, count(*) FILTER (WHERE a + (b - a) * k / 15 BETWEEN f - 1e-6 AND l + 1e-6) AS n_valid, count(*) AS n FROM m, range(0, 16) AS q(k) GROUP BY 1, 2"""

# ---- relational rest


@query("orders", sql="SELECT o_orderkey AS id, o_custkey AS owner, o_orderstatus AS state FROM orders")
def rename_and_drop(orders):
    """Renamed by a mapping; columns that start with o_ afterwards, and the last one, go."""
    d = orders.withColumnsRenamed({"o_orderkey": "id", "o_custkey": "owner", "o_orderstatus": "state"})
    d = d.drop(d.columns[-1])
    return d.drop(*(c for c in d.columns if c.startswith("o_")))


@query("orders", sql="""SELECT CASE WHEN month(o_orderdate) >= 10 OR month(o_orderdate) <= 3 THEN 'cool' ELSE 'warm' END AS half, count(*) AS n, round(count(*) FILTER (WHERE o_orderstatus = 'F') / greatest(count(*), 1), 5) AS share FROM orders GROUP BY 1""")
def half_year_share(orders):
    m = F.month("o_orderdate")
    d = orders.groupBy(F.when((m >= 10) | (m <= 3), "cool").otherwise("warm").alias("half")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return rounded(d.select("half", "n", (F.col("f") / F.greatest(F.col("n"), F.lit(1))).alias("share")))


@query("orders", sql="""WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) + CAST(month(o_orderdate) >= 10 AS INT) AS BIGINT) AS water_year FROM orders), d AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders)
SELECT water_year, CAST(greatest(a, make_date(water_year - 1, 10, 1)) AS VARCHAR) AS lo, CAST(least(b, make_date(water_year, 9, 30)) AS VARCHAR) AS hi FROM y, d""")
def water_year_bounds(orders):
    """Water years, their bounds clipped to the days there are."""
    d = orders.select(F.col("o_orderdate").cast("date").alias("day")).withColumn("water_year", S.water_year(F.col("day")))
    ends = d.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    y = F.col("water_year").cast("int")
    return d.select("water_year").distinct().crossJoin(F.broadcast(ends)).select("water_year", F.greatest("a", F.make_date(y - 1, F.lit(10), F.lit(1))).cast("string").alias("lo"), F.least("b", F.make_date(y, F.lit(9), F.lit(30))).cast("string").alias("hi"))  # ends is one row


# ---- label rules over cells

IGNORED = "SELECT sheet, row_idx FROM cells WHERE k IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')"


@query("orders", "lineitem", sql=f"WITH {CELLS} SELECT sheet, row_idx, kind FROM cells ANTI JOIN ({IGNORED}) g USING (sheet, row_idx)")
def ignored_rows(orders, lineitem):
    c = cells(orders, lineitem)
    listed = c.join(orders.where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("k")), "k", "left_semi").select("sheet", "row_idx")
    return L.without(c, listed).select("sheet", "row_idx", "kind")


#: A parent row's own block: its class by priority, none for the two lowest.
OWN = "CASE WHEN kind = 'P' THEN CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 END ELSE cls END"
BLOCKS = f"""{CELLS}, own AS (SELECT cells.*, {OWN} AS c, CASE WHEN kind = 'P' AND o_orderpriority <> '1-URGENT' THEN CAST(left(o_orderpriority, 1) AS BIGINT) END AS n_own, CASE WHEN kind = 'C' THEN cls + 1 END AS n_row FROM cells JOIN orders ON k = o_orderkey),
att AS (SELECT *, last_value(CASE WHEN kind = 'P' THEN k END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS parent_id FROM own)"""


def block_cells(orders, lineitem):
    o = orders.select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    d = cells(orders, lineitem).join(o, "k")
    own = F.when(F.col("kind") == "P", F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).when(F.col("o_orderpriority").startswith("3"), 2)).otherwise(F.col("cls"))
    d = d.withColumns({"c": own, "n_own": F.when((F.col("kind") == "P") & (F.col("o_orderpriority") != "1-URGENT"), F.substring("o_orderpriority", 1, 1)).cast("long"), "n_row": F.when(F.col("kind") == "C", F.col("cls") + 1).cast("long")})
    return L.attach_to_parents(d, F.col("kind") == "P", F.col("k"))


@query("orders", "lineitem", sql=f"WITH {BLOCKS} SELECT parent_id, row_idx, kind = 'P' AS on_parent_row, CASE c WHEN 0 THEN 'hot' WHEN 1 THEN 'oxic' ELSE 'mixed' END AS type FROM att WHERE parent_id IS NOT NULL AND c IS NOT NULL")
def parent_own_child(orders, lineitem):
    """A parent row with a filled block of its own is a child as well."""
    d = block_cells(orders, lineitem)
    filled = {name: (F.when(F.col("c") == i, F.lit("a")), F.when(F.col("c") == i, F.lit("b"))) for i, name in enumerate(("hot", "oxic", "mixed"))}
    d = d.withColumns({f"{n}_{s}": e for n, pair in filled.items() for s, e in zip("se", pair, strict=True)})
    return L.children(d, {n: (f"{n}_s", f"{n}_e") for n in filled}).select("parent_id", "row_idx", F.col("is_parent").alias("on_parent_row"), "type")


@query("orders", "lineitem", sql=f"""WITH {BLOCKS} SELECT parent_id, coalesce(max(n_own), arg_min(n_row, row_idx) FILTER (WHERE kind = 'C' AND n_row IS NOT NULL)) AS n_hot FROM att WHERE parent_id IS NOT NULL GROUP BY 1""")
def adopted_counts(orders, lineitem):
    """A count that is missing on the parent row is taken from the first child row with one."""
    return L.adopted(block_cells(orders, lineitem), "n_own", "n_row").withColumnRenamed("n_own", "n_hot")


@query("orders", "lineitem", sql="""SELECT 'parent' AS what, CAST(o_orderkey AS VARCHAR) AS id FROM orders UNION ALL SELECT 'child', l_orderkey || '#' || l_linenumber FROM lineitem""")
def split_parents_children(orders, lineitem):
    """A flat file of parents ('umbrella') and children (other types, or none) parted again."""
    p = orders.select(F.col("o_orderkey").alias("parent_id"), F.lit(None).cast("long").alias("moment_idx"), F.lit("umbrella").alias("type"))
    c = lineitem.select(F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").cast("long").alias("moment_idx"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("type"))
    parents, children = L.parted(p.unionByName(c))
    return parents.select(F.lit("parent").alias("what"), F.col("parent_id").cast("string").alias("id")).unionByName(children.select(F.lit("child").alias("what"), F.col("unit_id").alias("id")))


@query("orders", sql="""WITH t AS (SELECT year(o_orderdate)::BIGINT AS y, o_orderstatus AS s FROM orders) SELECT y AS water_year, 'total' AS cls, count(*) AS n_expert FROM t GROUP BY 1
UNION ALL SELECT y, CASE s WHEN 'F' THEN 'hot' ELSE 'oxic' END, count(*) FROM t WHERE s IN ('F', 'O') GROUP BY 1, 2""")
def tally_sheet(orders):
    """A summary sheet of text cells, with a header row and blanks, as long numbers."""
    y = F.year("o_orderdate").cast("string")
    n = lambda s: F.nullif(F.count_if(F.col("o_orderstatus") == s), F.lit(0)).cast("string")
    sheet = orders.groupBy(y.alias("c0")).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(".0")).alias("c1"), F.coalesce(n("F"), F.lit(" ")).alias("c2"), n("O").alias("c3"))
    head = orders.sparkSession.range(1).select(F.lit("Water Year").alias("c0"), F.lit("Total").alias("c1"), F.lit("Hot").alias("c2"), F.lit("Oxic").alias("c3"))
    return L.tally_from_sheet(head.unionByName(sheet), ["total", "hot", "oxic"])


assert set(SQL) <= set(QUERIES)
