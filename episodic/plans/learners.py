"""Queries of learners, attribution, clustering and sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import information as I
from ..operators import models as D
from ..operators import rocket as R
from ..operators import windows as W
from .registry import query, rounded
from .tables import with_group_folds


def units(scored):
    d = scored.where("y IS NOT NULL").select("unit_id", "grp", F.col("score"), F.col("pred").cast("double").alias("pred"), F.col("toxic").cast("double").alias("toxic"), F.when(F.col("y") == 1, "good").otherwise("bad").alias("cls"))
    return with_group_folds(D.matrix(d, ["score", "pred", "toxic"], "cls"), "grp", "cls", 3, 7)


_inputs = {"score": "score", "pred": "CAST(pred AS DOUBLE)", "toxic": "CAST(toxic AS DOUBLE)"}


@query("scored", sql=f"""WITH d AS (SELECT unit_id, grp, CASE y WHEN 1 THEN 'good' ELSE 'bad' END AS cls, {", ".join(f"{v} AS {k}" for k, v in _inputs.items())} FROM scored WHERE y IS NOT NULL),
c AS (SELECT grp, cls, count(*) AS n FROM d GROUP BY 1, 2), t AS (SELECT grp, cls FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, cls) AS rn FROM c) WHERE rn = 1),
f AS (SELECT grp, (row_number() OVER (PARTITION BY cls ORDER BY md5('7' || grp), grp) - 1) % 3 AS fold FROM t), m AS (SELECT {", ".join(f"avg({k}) AS {k}_m, stddev_samp({k}) AS {k}_s" for k in _inputs)} FROM d)
SELECT unit_id, CAST(cls = 'good' AS DOUBLE) AS label, CAST(fold AS BIGINT) AS fold, {", ".join(f"round(({k} - {k}_m) / {k}_s, 5) + 0.0 AS {k}" for k in _inputs)} FROM d JOIN f USING (grp), m""")
def feature_matrix(scored):
    """The training matrix: scaled features, label and fold of each unit."""
    x = D.vector_to_array("features")
    d = units(scored).select("unit_id", "label", "fold", *(F.get(x, F.lit(i)).alias(k) for i, k in enumerate(_inputs)))
    return rounded(d.withColumns({k: F.coalesce(F.col(k), F.lit(0.0)) for k in _inputs}))


@query("scored")
def cv_logistic(scored):
    return rounded(D.fold_metrics(D.out_of_fold(units(scored), D.logistic(1.0))))


@query("scored")
def cv_boosted(scored):
    return rounded(D.fold_metrics(D.out_of_fold(units(scored), D.boosted(5))))


@query("scored", sql="""WITH a AS (SELECT unit_id, row_number() OVER (ORDER BY unit_id) AS i FROM scored), b AS (SELECT y, row_number() OVER (ORDER BY substr(md5('3:' || unit_id), 1, 13)) AS i FROM scored)
SELECT unit_id, b.y FROM a JOIN b USING (i)""")
def label_permutation(scored):
    """Labels dealt anew in a seeded order."""
    return D.permuted(scored.select("unit_id", "y"), "y", "unit_id", 3)


@query("embeddings")
def kmeans_ranked(embeddings):
    d = D.vectors(embeddings, _vector(embeddings))
    key = embeddings.columns[0]
    return D.clusters(d.withColumn("norm", F.aggregate(_vector(embeddings), F.lit(0.0), lambda a, x: a + x * x)), 4, "norm").groupBy("cluster").agg(F.count(key).alias("n"))


@query("embeddings")
def pca2(embeddings):
    d = D.components(D.vectors(embeddings, _vector(embeddings)), 2)
    return rounded(d.select(embeddings.columns[0], F.get("pcs", F.lit(0)).alias("pc1"), F.get("pcs", F.lit(1)).alias("pc2")), 4)


@query("embeddings")
def pca95(embeddings):
    """How many components hold 95 % of the variance, and how much each of them holds."""
    return rounded(D.explained(D.vectors(embeddings, _vector(embeddings)), 0.95), 4)


def _vector(df) -> str:
    return next(c for c, t in df.dtypes if t.startswith("array"))


def sequences(readings):
    """One row per series and day: three channels of 24 hourly values."""
    d = W.forward_fill(W.complete_grid(readings), {"lvl": 0.0, "sal": 0.0, "target": 0.0})
    g = d.groupBy("series_id", F.date_trunc("day", "ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "target", "lvl", "sal"))).alias("v")).where(F.size("v") == 24)
    field = lambda c: F.transform("v", lambda x: x[c])
    return g.select((F.col("series_id") * 100_000 + F.unix_date(F.col("day").cast("date"))).alias("unit_id"), F.array(field("target"), field("lvl"), field("sal")).alias("seq"))


@query("readings")
def rocket_features(readings):
    return R.transform(R.scale_channels(sequences(readings), "unit_id", "seq"), R.bank(32, 3, 24), "unit_id", "seq").select("unit_id", F.size("rocket").cast("long").alias("n"), F.round(F.get("rocket", F.lit(0)), 4).alias("max0"), F.round(F.get("rocket", F.lit(1)), 4).alias("ppv0"))


@query("scored", sql="""WITH b AS (SELECT y, least(CAST(floor(score * 10) AS BIGINT), 9) AS bin FROM scored), n AS (SELECT count(*)::DOUBLE AS n FROM b),
j AS (SELECT bin, y, count(*)::DOUBLE AS c FROM b GROUP BY 1, 2), p AS (SELECT bin, y, c, sum(c) OVER (PARTITION BY bin) AS cb, sum(c) OVER (PARTITION BY y) AS cy FROM j)
SELECT round(sum(c / n * ln(c * n / (cb * cy))), 5) AS mi FROM p, n""")
def mutual_info_binned(scored):
    j = scored.groupBy(F.least(F.floor(F.col("score") * 10), F.lit(9)).alias("bin"), "y").agg(F.count(F.lit(1)).cast("double").alias("c"))
    p = j.withColumns({"cb": F.sum("c").over(Window.partitionBy("bin")), "cy": F.sum("c").over(Window.partitionBy("y"))})
    p = p.crossJoin(F.broadcast(j.agg(F.sum("c").alias("n"))))  # one row
    return rounded(p.agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cb") * F.col("cy")))).alias("mi")))


PERM = [3, 0, 2, 1]


@query("iv", sql="SELECT interval_id, [interval_id + 3, interval_id + 0, interval_id + 2, interval_id + 1][2] AS second FROM iv")
def time_permutation(iv):
    """One permutation of steps for all units."""
    steps = F.array(*(F.col("interval_id") + i for i in range(4)))
    return iv.select("interval_id", F.get(F.transform(F.array(*(F.lit(p) for p in PERM)), lambda i: F.get(steps, i)), F.lit(1)).alias("second"))


def _psi(n: str) -> str:
    steps = " + ".join(f"1 / (CAST({n} AS DOUBLE) + {i})" for i in range(8))
    return f"(ln({n} + 8) - 1 / (2.0::DOUBLE * ({n} + 8)) - 1 / (12.0::DOUBLE * pow({n} + 8, 2)) + 1 / (120.0::DOUBLE * pow({n} + 8, 4)) - 1 / (252.0::DOUBLE * pow({n} + 8, 6)) - ({steps}))"


@query("orders", sql=f"""WITH u AS (SELECT o_orderstatus AS y, unnest([{{'f': 'price', 'x': CAST(o_totalprice AS DOUBLE)}}, {{'f': 'day', 'x': CAST(dayofyear(o_orderdate) AS DOUBLE)}}, {{'f': 'year', 'x': CAST(year(o_orderdate) AS DOUBLE)}}]) AS p FROM orders),
s AS (SELECT y, p.f AS f, p.x AS x, count(*) OVER (PARTITION BY p.f, y) AS size FROM u), q AS (SELECT * FROM s WHERE size > 1),
d AS (SELECT *, least(3, size - 1) AS k, list_sort(list_filter([{", ".join(f"abs(x - {way}(x, {i}) OVER w)" for way in ("lag", "lead") for i in (1, 2, 3))}], lambda v: v IS NOT NULL)) AS ds FROM q WINDOW w AS (PARTITION BY f, y ORDER BY x)),
r AS (SELECT f, y, x, size, k, ds[k] AS r, count(*) AS c FROM d GROUP BY ALL), v AS (SELECT f, x, count(*) AS c FROM q GROUP BY ALL),
m AS (SELECT r.f, r.y, r.x, r.size, r.k, r.c, CAST(sum(v.c) AS BIGINT) AS m FROM r JOIN v ON v.f = r.f AND v.x >= r.x - r.r AND v.x <= r.x + r.r AND (r.r = 0 OR (v.x > r.x - r.r AND v.x < r.x + r.r)) GROUP BY ALL),
t AS (SELECT f, CAST(sum(c) AS BIGINT) AS n, sum(c * {_psi("k")}) / sum(c) AS a, sum(c * {_psi("size")}) / sum(c) AS b, sum(c * {_psi("m")}) / sum(c) AS e FROM m GROUP BY 1)
SELECT f AS feature, n, round(greatest({_psi("n")} + a - b - e, 0), 5) AS information FROM t""")
def mutual_info_neighbours(orders):
    """Information that price, day of the year and year hold about an order's status, from three neighbours."""
    d = orders.select("o_orderstatus", F.col("o_totalprice").alias("price"), F.dayofyear("o_orderdate").alias("day"), F.year("o_orderdate").alias("year"))
    return rounded(I.neighbour_information(d, ["price", "day", "year"], "o_orderstatus"))


def swept(embeddings):
    d = embeddings.select(F.col(embeddings.columns[0]).alias("id"), F.transform(_vector(embeddings), lambda v: v.cast("double")).alias("x"))
    return d, *C.sweep(d, "x", list(range(2, 9)))


@query("embeddings")
def kmeans_sweep(embeddings):
    """The least cost of 20 starts for each k from 2 to 8."""
    _, costs, _ = swept(embeddings)
    return rounded(costs.groupBy("k").agg(F.min("cost").alias("cost"), F.count(F.lit(1)).alias("starts")), 4)


@query("embeddings")
def kmeans_labels(embeddings):
    """Each vector's cluster for every k, numbered by the median length of its vectors."""
    d, _, best = swept(embeddings)
    return C.assigned(d.withColumn("norm", F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)), "x", best, "norm").select("id", "k", "cluster")


_apart = lambda c: f"list_sum(list_transform(range(1, len(x) + 1), lambda i: pow(x[i] - {c}[i], 2)))"


@query("embeddings", "documents", sql=f"""WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), s AS (SELECT {", ".join(f"max(x) FILTER (WHERE id = (SELECT min(id) + {i} FROM e)) AS c{i}" for i in range(4))} FROM e),
d AS (SELECT id, list_sum(list_transform(x, lambda v: v * v)) AS norm, [{", ".join(_apart(f"c{i}") for i in range(4))}] AS ds FROM e, s), a AS (SELECT id, norm, list_position(ds, list_min(ds)) AS raw FROM d),
r AS (SELECT raw, row_number() OVER (ORDER BY m, raw) - 1 AS cluster FROM (SELECT raw, quantile_disc(norm, 0.5) AS m FROM a GROUP BY 1)), j AS (SELECT CAST(cluster AS BIGINT) AS cluster, source AS cls, count(*) AS n FROM a JOIN r USING (raw) JOIN documents ON doc_id = id GROUP BY ALL)
SELECT cluster, cls, n, round(n / sum(n) OVER (PARTITION BY cluster), 5) AS share FROM j""")
def cluster_classes(embeddings, documents):
    """What sources the documents of each cluster come from; clusters are those nearest to four given vectors."""
    d = embeddings.select(F.col(embeddings.columns[0]).alias("id"), F.transform(_vector(embeddings), lambda v: v.cast("double")).alias("x"))
    four = np.array([list(r.x) for r in d.orderBy("id").limit(4).collect()])
    a = C.assigned(d.withColumn("norm", F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v)), "x", {4: four}, "norm")
    joined = a.select("cluster", F.col("id").alias("doc_id")).join(documents.select("doc_id", F.col("source").alias("cls")), "doc_id")
    return rounded(C.composition(joined, ["cluster"], "cls"))


@query("embeddings", "documents")
def kmeans_classes(embeddings, documents):
    """The same for the best of 20 starts, every k from 2 to 8."""
    d, _, best = swept(embeddings)
    a = C.assigned(d.withColumn("norm", F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v)), "x", best, "norm")
    return rounded(C.composition(a.join(documents.select(F.col("doc_id").alias("id"), F.col("source").alias("cls")), "id"), ["k", "cluster"], "cls"))
