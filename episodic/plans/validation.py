"""Queries of held-out validation: leave-one-group-out, repeated folds, tidy results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import heldout as H
from ..operators import rocket as R
from ..operators import windows as W
from .registry import query, rounded
from .tables import with_group_folds

MODELS = {"bayes": H.bayes(), "ridge": H.ridge(), "lda": H.lda(), "pca_lda": H.components(0.95, H.lda())}


def labelled(scored):
    return scored.where("y IS NOT NULL AND pred IS NOT NULL AND score IS NOT NULL").select("unit_id", "grp", F.col("y").cast("long").alias("y"), F.array("score", F.col("pred").cast("double")).alias("x"))


# naive Bayes of held-out units in SQL: moments of the training rows are totals less the fold's own
BAYES = """u AS (SELECT unit_id, grp, CAST(y AS BIGINT) AS y, score AS a, CAST(pred AS DOUBLE) AS b FROM scored WHERE y IS NOT NULL AND pred IS NOT NULL AND score IS NOT NULL),
{folds},
own AS (SELECT run, fold, y, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS qa, sum(b * b) AS qb FROM f GROUP BY 1, 2, 3),
tot AS (SELECT run, y, sum(n) AS n, sum(sa) AS sa, sum(sb) AS sb, sum(qa) AS qa, sum(qb) AS qb FROM own GROUP BY 1, 2),
rest AS (SELECT p.run, p.fold, t.y, t.n - coalesce(o.n, 0) AS n, t.sa - coalesce(o.sa, 0) AS sa, t.sb - coalesce(o.sb, 0) AS sb, t.qa - coalesce(o.qa, 0) AS qa, t.qb - coalesce(o.qb, 0) AS qb
  FROM (SELECT DISTINCT run, fold FROM own) p JOIN tot t USING (run) LEFT JOIN own o ON o.run = p.run AND o.fold = p.fold AND o.y = t.y),
eps AS (SELECT run, fold, 1e-9 * greatest(sum(qa) / sum(n) - pow(sum(sa) / sum(n), 2), sum(qb) / sum(n) - pow(sum(sb) / sum(n), 2)) AS e FROM rest GROUP BY 1, 2),
par AS (SELECT run, fold, y, sa / n AS ma, sb / n AS mb, qa / n - pow(sa / n, 2) + e AS va, qb / n - pow(sb / n, 2) + e AS vb FROM rest JOIN eps USING (run, fold) WHERE n > 0),
dens AS (SELECT f.run, f.fold, f.unit_id, f.y, p.y AS c, -0.5 * (ln(2 * pi() * va) + pow(a - ma, 2) / va + ln(2 * pi() * vb) + pow(b - mb, 2) / vb) AS s FROM f JOIN par p USING (run, fold)),
best AS (SELECT run, fold, unit_id, y, arg_max(c, s) AS predicted, 1 / sum(exp(s - top)) AS p FROM (SELECT *, max(s) OVER (PARTITION BY run, unit_id) AS top FROM dens) GROUP BY 1, 2, 3, 4)"""
BY_GROUP = BAYES.format(folds="f AS (SELECT 0 AS run, grp AS fold, * FROM u)")
#: Groups in a seeded order inside their most frequent class, dealt in turn, as in with_group_folds.
DEALT = """top AS (SELECT grp, y FROM (SELECT grp, y, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, y) AS rn FROM u GROUP BY grp, y) WHERE rn = 1),
deal AS (SELECT run, grp, (row_number() OVER (PARTITION BY run, y ORDER BY md5(CAST(run AS VARCHAR) || grp), grp) - 1) % 5 AS fold FROM top, generate_series(0, 4) AS r(run)),
f AS (SELECT run, fold, u.* FROM u JOIN deal USING (grp))"""
REPEATED = BAYES.format(folds=DEALT)


def by_group(scored, models=MODELS):
    d = labelled(scored)
    fits = H.fitted(d, "x", "y", "grp", models)
    return fits, H.predictions(d, "x", "grp", fits)


@query("scored", sql=f"WITH {BY_GROUP} SELECT unit_id, fold AS grp, y, predicted, round(p, 5) AS confidence FROM best")
def logo_predictions(scored):
    """Each unit by a model of all other groups."""
    _, p = by_group(scored, {"bayes": H.bayes()})
    return rounded(p.select("unit_id", "grp", "y", "predicted", F.array_max("probability").alias("confidence")))


@query("scored")
def cv_logo(scored):
    """Pooled scores of all models over leave-one-group-out predictions."""
    _, p = by_group(scored)
    return rounded(H.results(H.scores(p, "y", ["model"]), "logo"))


@query("scored", sql=f"WITH {BY_GROUP} SELECT 'logo' AS \"table\", 'bayes' AS model, t.c AS \"true\", q.c AS pred, count(best.y) AS \"count\" FROM (VALUES (0), (1)) AS t(c) CROSS JOIN (VALUES (0), (1)) AS q(c) LEFT JOIN best ON best.y = t.c AND best.predicted = q.c GROUP BY 1, 2, 3, 4")
def logo_confusion(scored):
    _, p = by_group(scored, {"bayes": H.bayes()})
    return H.confusion_frame(p, "y", "logo")


def by_repeats(scored, models):
    d = H.repeated(labelled(scored), "grp", "y", 5, 5, with_group_folds)
    return H.predictions(d, "x", "fold", H.fitted(d, "x", "y", "fold", models, "run"), "run")


#: Macro-F1 and balanced accuracy of each fold of each repeat.
FOLD_SCORES = """c AS (SELECT run, fold, count(*) FILTER (WHERE y = 1 AND predicted = 1)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND predicted = 0)::DOUBLE AS tn, count(*) FILTER (WHERE y = 0 AND predicted = 1)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND predicted = 0)::DOUBLE AS fn FROM best GROUP BY 1, 2),
m AS (SELECT CASE WHEN tp + fn + fp = 0 THEN 2 * tn / (2 * tn + fp + fn) WHEN tn + fp + fn = 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 END AS f1,
  CASE WHEN tp + fn = 0 THEN tn / (tn + fp) WHEN tn + fp = 0 THEN tp / (tp + fn) ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END AS bal FROM c)"""


@query("scored", sql=f"""WITH {REPEATED},
{FOLD_SCORES}
SELECT 'macro_f1' AS metric, round(avg(f1), 5) AS mean, round(stddev_pop(f1), 5) AS std FROM m UNION ALL SELECT 'balanced', round(avg(bal), 5), round(stddev_pop(bal), 5) FROM m""")
def repeated_group_cv(scored):
    """Five repeats of five group folds: mean and deviation over all 25."""
    r = H.results(H.scores(by_repeats(scored, {"bayes": H.bayes()}), "y", ["model", "run", "fold"]), "repeated")
    return rounded(r.where(F.col("metric").isin("macro_f1", "balanced")).select("metric", "mean", "std"))


def _route_sql(group: str) -> str:
    folds = REPEATED if group == "grp" else REPEATED.replace("SELECT unit_id, grp, CAST", f"SELECT unit_id, {group} AS grp, CAST")
    return f"SELECT * FROM (WITH {folds},\n{FOLD_SCORES} SELECT avg(f1) AS f, stddev_pop(f1) AS fs, avg(bal) AS b, stddev_pop(bal) AS bs FROM m)"


@query("scored", sql=f"""WITH r AS ({_route_sql("grp")}), q AS ({_route_sql("lang")}) SELECT 1 AS rank, 'bayes' AS model, printf('%.3f ± %.3f', r.f, r.fs) AS "source · macro_f1", printf('%.3f ± %.3f', r.b, r.bs) AS "source · balanced",
printf('%.3f ± %.3f', q.f, q.fs) AS "language · macro_f1", printf('%.3f ± %.3f', q.b, q.bs) AS "language · balanced" FROM r, q""")
def route_comparison(scored):
    """Repeated folds of whole sources beside repeated folds of whole languages."""
    kept = {"source": scored, "language": scored.withColumn("grp", F.col("lang"))}
    frames = {k: H.results(H.scores(by_repeats(d, {"bayes": H.bayes()}), "y", ["model", "run", "fold"]), "repeated") for k, d in kept.items()}
    return H.compare_routes(frames, "repeated", ["macro_f1", "balanced"])


@query("scored", sql=f"""WITH {REPEATED},
{FOLD_SCORES}, v AS (SELECT 'macro_f1' AS metric, avg(f1) AS a, stddev_pop(f1) AS s FROM m UNION ALL SELECT 'balanced', avg(bal), stddev_pop(bal) FROM m)
SELECT metric, round(a, 5) AS mean, round(a - s, 5) AS lo, round(a + s, 5) AS hi, 0.5::DOUBLE AS chance FROM v""")
def chance_reference(scored):
    """Scores of repeated folds between a deviation below and above, and what guessing reaches."""
    r = H.results(H.scores(by_repeats(scored, {"bayes": H.bayes()}), "y", ["model", "run", "fold"]), "repeated")
    return rounded(H.with_chance(r.where(F.col("metric").isin("macro_f1", "balanced")), 2).select("metric", "mean", "lo", "hi", "chance"))


@query("scored", sql=f"""WITH {REPEATED}, n AS (SELECT y AS t, predicted AS p, count(*) AS c FROM best GROUP BY 1, 2), k AS (SELECT t.c AS t, q.c AS p FROM (VALUES (0), (1)) AS t(c) CROSS JOIN (VALUES (0), (1)) AS q(c))
SELECT k.t AS "true", k.p AS pred, round(coalesce(n.c, 0) / 5.0::DOUBLE, 5) AS per_pass, round(coalesce(n.c, 0) / sum(n.c) OVER (PARTITION BY k.t), 5) AS share FROM k LEFT JOIN n ON n.t = k.t AND n.p = k.p""")
def confusion_per_pass(scored):
    """Cells of the confusion of an average repeat."""
    cells = H.confusion_frame(by_repeats(scored, {"bayes": H.bayes()}), "y", "repeated")
    return rounded(H.per_pass(cells, 5).select("true", "pred", "per_pass", "share"))


# held-out naive Bayes of three classes from two features, and each class's area against the rest
THREE = """u AS (SELECT o_orderkey AS id, o_orderpriority AS fold, o_orderstatus AS y, CAST(o_totalprice AS DOUBLE) / 100000 AS a, date_diff('day', DATE '1995-06-01', CAST(o_orderdate AS DATE)) / 1000.0::DOUBLE AS b FROM orders),
own AS (SELECT fold, y, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS qa, sum(b * b) AS qb FROM u GROUP BY 1, 2),
rest AS (SELECT p.fold, o.y, sum(n) AS n, sum(sa) AS sa, sum(sb) AS sb, sum(qa) AS qa, sum(qb) AS qb FROM (SELECT DISTINCT fold FROM u) p JOIN own o ON o.fold <> p.fold GROUP BY 1, 2),
eps AS (SELECT fold, 1e-9 * greatest(sum(qa) / sum(n) - pow(sum(sa) / sum(n), 2), sum(qb) / sum(n) - pow(sum(sb) / sum(n), 2)) AS e FROM rest GROUP BY 1),
par AS (SELECT fold, y, sa / n AS ma, sb / n AS mb, qa / n - pow(sa / n, 2) + e AS va, qb / n - pow(sb / n, 2) + e AS vb FROM rest JOIN eps USING (fold)),
s AS (SELECT u.id, u.y, p.y AS c, -0.5::DOUBLE * (ln(2 * pi() * va) + pow(a - ma, 2) / va + ln(2 * pi() * vb) + pow(b - mb, 2) / vb) AS s FROM u JOIN par p USING (fold)),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM s), p AS (SELECT c, (y = c)::INT AS hit, round(e / sum(e) OVER (PARTITION BY id), 9) AS p FROM e),
v AS (SELECT c, p, sum(hit) AS pos, sum(1 - hit) AS neg FROM p GROUP BY 1, 2), k AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY c ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM v),
a AS (SELECT c, sum(pos * (under + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auc FROM k GROUP BY 1)"""


@query("orders", sql=f"WITH {THREE} SELECT c AS class, round(auc, 4) AS auc FROM a UNION ALL SELECT 'macro', round(avg(auc), 4) FROM a")
def roc_auc_macro(orders):
    """Area under the curve of each order status against the others, and their mean, each priority held out in turn."""
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-06-01").cast("date")) / 1000.0
    d = orders.select("o_orderpriority", "o_orderstatus", F.array(F.col("o_totalprice").cast("double") / 100000, day).alias("x"))
    p = H.predictions(d, "x", "o_orderpriority", H.fitted(d, "x", "o_orderstatus", "o_orderpriority", {"bayes": H.bayes()}))
    p = p.withColumn("probability", F.transform("probability", lambda v: F.round(v, 9))).select("o_orderstatus", "classes", "probability")
    one = H.against_rest(p, "o_orderstatus", [])
    each = H.roc_auc(one, "y", "p", ["cls"])
    return rounded(each.select(F.col("cls").alias("class"), "auc").unionByName(each.agg(F.lit("macro").alias("class"), F.avg("auc").alias("auc"))), 4)


@query("scored")
def repeated_results(scored):
    """All models and scores, tidy."""
    return rounded(H.results(H.scores(by_repeats(scored, MODELS), "y", ["model", "run", "fold"]), "repeated"))


@query("scored", sql=f"""WITH {BY_GROUP}, h AS (SELECT fold, -(p * log2(p) + (1 - p) * log2(1 - p)) AS h FROM (SELECT fold, least(greatest(p, 1e-9), 1 - 1e-9) AS p FROM best)),
x AS (SELECT f.fold, median(h.h) AS middle FROM (SELECT DISTINCT fold FROM h) f JOIN h ON h.fold <> f.fold GROUP BY 1)
SELECT fold AS grp, count(*) AS n, round(median(h), 5) AS median_bits, round(middle, 5) AS others_bits, round(avg(CASE WHEN h > middle THEN 1.0 ELSE 0.0 END), 5) AS above FROM h JOIN x USING (fold) GROUP BY fold, middle""")
def boundary_panel(scored):
    """How close to the boundary are a group's units: entropy of their held-out probabilities against the median of all other groups' units."""
    _, p = by_group(scored, {"bayes": H.bayes()})
    return rounded(H.boundary(p, "grp"))


KERNELS = 10_000
HEADS = {"pca_lda": H.components(0.95, H.lda()), "pca_ridge": H.components(0.95, H.ridge())}


def labelled_days(readings):
    """One row per series and day: level, salinity and temperature of 24 hours; y: is the target above 0 in most of them; folds of whole weeks."""
    d = W.forward_fill(W.complete_grid(readings), {"lvl": 50.0, "sal": 50.0, "temp": 50.0, "target": 0.0})
    g = d.groupBy("series_id", F.date_trunc("day", "ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "lvl", "sal", "temp"))).alias("v"), F.count_if(F.col("target") > 0).alias("on")).where(F.size("v") == 24)
    field = lambda c: F.transform("v", lambda x: x[c])
    seq = F.array(field("lvl"), field("sal"), field("temp"))
    return g.select("series_id", "day", (F.col("on") >= 6).cast("long").alias("y"), F.pmod(F.weekofyear("day"), F.lit(5)).cast("long").alias("fold"), seq.alias("seq"))


@query("readings")
def rocket_heads(readings):
    """Scores of linear heads on 95 % components of 10,000 kernels' columns, weeks held out."""
    rows = R.projected(labelled_days(readings), R.bank(KERNELS, 3, 24), "seq", "fold").persist()  # read for fits, predictions and scores
    return rounded(H.results(H.scores(R.heads(rows, "y", "fold", HEADS), "y", ["model"]), "rocket"), 4)


@query("readings")
def rocket_attribution(readings):
    """Importance of channels, and of dilations by pool, in a ridge head on all days."""
    kernels = R.bank(1_000, 3, 24)
    days = labelled_days(readings)
    found = R.importance(days, kernels, "seq", *R.head_weights(days, kernels, "seq", "y"))
    told = R.described(readings.sparkSession, kernels)
    one = R.by_tag(found, told, ["channel"]).select(F.lit("channel").alias("tag"), F.col("channel").cast("string").alias("value"), F.lit("all").alias("pool"), "importance")
    two = R.by_tag(found, told, ["dilation", "pool"]).select(F.lit("dilation").alias("tag"), F.col("dilation").cast("string").alias("value"), "pool", "importance")
    return rounded(one.unionByName(two), 4)
