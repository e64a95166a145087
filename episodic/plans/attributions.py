"""Queries of attribution: exact for a fitted linear model, sampled for any other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators import heldout as H
from ..operators.quantiles import exact_quantiles
from ..operators.routes import NUMERIC
from .registry import query, rounded
from .routes import feature_rows
from .validation import labelled

NAMES = ["score", "pred"]
SHRINK, AGAINST = 1e-3, 64

# linear discriminants of two features: the shrunk covariance inside classes, inverted by hand
LINEAR = f"""u AS (SELECT unit_id, CAST(y AS BIGINT) AS y, score AS a, CAST(pred AS DOUBLE) AS b FROM scored WHERE y IS NOT NULL AND pred IS NOT NULL AND score IS NOT NULL),
c AS (SELECT y, count(*) AS n, avg(a) AS ma, avg(b) AS mb, sum(a * a) AS qaa, sum(a * b) AS qab, sum(b * b) AS qbb FROM u GROUP BY 1),
s0 AS (SELECT sum(qaa - n * ma * ma) / sum(n) AS aa, sum(qab - n * ma * mb) / sum(n) AS ab, sum(qbb - n * mb * mb) / sum(n) AS bb,
  sum(CASE y WHEN 1 THEN ma ELSE -ma END) AS da, sum(CASE y WHEN 1 THEN mb ELSE -mb END) AS db FROM c),
s AS (SELECT {1 - SHRINK}::DOUBLE * aa + {SHRINK}::DOUBLE * greatest((aa + bb) / 2, 1e-12) AS aa, {1 - SHRINK}::DOUBLE * ab AS ab, {1 - SHRINK}::DOUBLE * bb + {SHRINK}::DOUBLE * greatest((aa + bb) / 2, 1e-12) AS bb, da, db FROM s0),
w AS (SELECT (bb * da - ab * db) / (aa * bb - ab * ab) AS wa, (aa * db - ab * da) / (aa * bb - ab * ab) AS wb FROM s),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM u),
t AS (SELECT unit_id, a, b, wa * (a - ma) AS pa, wb * (b - mb) AS pb, abs(wa) * sa AS ga, abs(wb) * sb AS gb FROM u, w, m)"""


def discriminant(scored):
    d = labelled(scored)
    return d, A.fitted_to_all(d, "x", "y", H.lda(SHRINK))


@query("scored", sql=f"WITH {LINEAR} SELECT unit_id, round(pa, 5) + 0.0 AS a_score, round(pb, 5) + 0.0 AS a_pred FROM t")
def linear_shap(scored):
    """What score and pred add to each unit's log odds of the better class, in linear discriminants fitted to all units."""
    d, model = discriminant(scored)
    a = A.linear(d, "x", model, 1)
    return rounded(a.select("unit_id", F.get("attribution", F.lit(0)).alias("a_score"), F.get("attribution", F.lit(1)).alias("a_pred")))


@query("scored", sql=f"""WITH {LINEAR}, r AS (SELECT 'score' AS feature, avg(abs(pa)) AS a, max(ga) AS g FROM t UNION ALL SELECT 'pred', avg(abs(pb)), max(gb) FROM t)
SELECT row_number() OVER (ORDER BY a DESC, feature) AS rank, feature, round(a, 5) AS mean_abs, round(g, 5) AS gain FROM r""")
def attribution_rank(scored):
    """Features by mean absolute attribution, beside the model's own weight per deviation."""
    d, model = discriminant(scored)
    r = A.ranking(A.linear(d, "x", model, 1), NAMES, abs(A.linear_weights(model, 1)) * model.sd)
    return rounded(r.select("rank", "feature", "mean_abs", "gain"))


@query("scored", sql=f"""WITH {LINEAR}, l AS (SELECT unit_id, 'score' AS feature, pa AS p, a AS raw FROM t UNION ALL SELECT unit_id, 'pred', pb, b FROM t)
SELECT unit_id, feature, round(p, 5) + 0.0 AS attribution, round((raw - min(raw) OVER f) / (max(raw) OVER f - min(raw) OVER f), 5) AS scaled, round(raw, 5) AS raw FROM l WINDOW f AS (PARTITION BY feature)""")
def beeswarm_long(scored):
    d, model = discriminant(scored)
    return rounded(A.long_frame(A.linear(d, "x", model, 1), ["unit_id"], "x", NAMES))


# naive Bayes on all units, and the units that serve as background
BAYES = f"""u AS (SELECT unit_id, CAST(y AS BIGINT) AS y, score AS a, CAST(pred AS DOUBLE) AS b FROM scored WHERE y IS NOT NULL AND pred IS NOT NULL AND score IS NOT NULL),
e AS (SELECT 1e-9 * greatest(var_pop(a), var_pop(b)) AS e FROM u),
c AS (SELECT y, avg(a) AS ma, avg(b) AS mb, var_pop(a) + any_value(e) AS va, var_pop(b) + any_value(e) AS vb FROM u, e GROUP BY 1),
p AS (SELECT k.ma AS ma, k.mb AS mb, k.va AS va, k.vb AS vb, o.ma AS oa, o.mb AS ob, o.va AS wa, o.vb AS wb FROM c k, c o WHERE k.y = 1 AND o.y = 0),
g AS (SELECT a, b FROM u ORDER BY md5(CAST(unit_id AS VARCHAR)), unit_id LIMIT {AGAINST})"""


def _odds(a: str = "", b: str = "") -> str:
    """The log odds' part of each feature that is named, in SQL."""
    part = lambda x, m, v, o, w: f"0.5::DOUBLE * (ln({w} / {v}) + pow({x} - {o}, 2) / {w} - pow({x} - {m}, 2) / {v})"
    return " + ".join(([part(a, "ma", "va", "oa", "wa")] if a else []) + ([part(b, "mb", "vb", "ob", "wb")] if b else []))


def _p(a: str, b: str) -> str:
    return f"1 / (1 + exp(-({_odds(a, b)})))"


def bayes(scored):
    d = labelled(scored)
    return d, A.fitted_to_all(d, "x", "y", H.bayes()), A.background(d, "unit_id", "x", AGAINST)


@query("scored", sql=f"""WITH {BAYES}, f AS (SELECT avg({_odds(a="a")}) AS fa, avg({_odds(b="b")}) AS fb FROM g, p), t AS (SELECT unit_id, {_odds(a="a")} - fa AS pa, {_odds(b="b")} - fb AS pb FROM u, p, f)
SELECT unit_id, 'score' AS feature, round(pa, 5) + 0.0 AS attribution FROM t UNION ALL SELECT unit_id, 'pred', round(pb, 5) + 0.0 FROM t""")
def shapley_log_odds(scored):
    """Sampled attributions of naive Bayes's log odds; a sum over features, so that every sample must give the features' own parts."""
    d, model, against = bayes(scored)
    a = A.sampled(d, "unit_id", "x", A.log_odds(model, 1), against, pairs=4)
    return rounded(A.long_frame(a, ["unit_id"], "x", NAMES).select("unit_id", "feature", "attribution"))


@query("scored", sql=f"""WITH {BAYES}, h AS (SELECT u.unit_id, {_p("u.a", "u.b")} AS pab, {_p("u.a", "g.b")} AS pa, {_p("g.a", "u.b")} AS pb, {_p("g.a", "g.b")} AS p0 FROM u, g, p),
t AS (SELECT unit_id, avg(pa - p0 + pab - pb) / 2 AS fa, avg(pb - p0 + pab - pa) / 2 AS fb FROM h GROUP BY 1)
SELECT 'score' AS feature, round(avg(abs(fa)), 5) AS mean_abs FROM t UNION ALL SELECT 'pred', round(avg(abs(fb)), 5) FROM t""")
def sampling_shapley(scored):
    """Mean absolute attributions of naive Bayes's probability against 64 units; an order of two features and its reverse are all there are."""
    d, model, against = bayes(scored)
    a = A.sampled(d, "unit_id", "x", A.probability(model, 1), against, pairs=2)
    return rounded(A.ranking(a, NAMES, model.sd).select("feature", "mean_abs"))


@query("readings", "iv", "moments")
def event_attribution(readings, iv, moments):
    """All 24 features of labelled events by their sampled attributions to the probability of the class hot, with the sampling error."""
    f = feature_rows("events", readings, iv, moments).where("label IS NOT NULL").persist()  # read for medians, model, background and attributions
    middles = {c: m for c, (m,) in exact_quantiles(f, NUMERIC, [0.5]).items()}
    used = [c for c in NUMERIC if middles[c] is not None]
    d = f.select(F.concat_ws(":", "series_id", "eid").alias("unit"), "label", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(middles[c])) for c in used)).alias("x"))
    model = A.fitted_to_all(d, "x", "label", H.components(0.95, H.lda(SHRINK)))
    a = A.sampled(d, "unit", "x", A.probability(model, "hot"), A.background(d, "unit", "x", 32), pairs=8)
    return rounded(A.ranking(a, used, abs(A.linear_weights(model, "hot")) * model.sd, error="error"))
