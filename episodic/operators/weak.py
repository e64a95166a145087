"""Weak supervision: quantile-band voters, their agreement, a rank-one label model, weighted votes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

#: voter -> (column, lower share, upper share, vote below, vote above, whether the value's size counts without its sign)
Voters = dict[str, tuple[str, float, float, int, int, bool]]


def votes(df: DataFrame, voters: Voters) -> DataFrame:
    """df with a column per voter: its vote below the lower or above the upper quantile (above wins ties), 0 between and on null; voters without their column are left out."""
    used = {k: v for k, v in voters.items() if v[0] in df.columns}
    value = {k: F.abs(v[0]) if v[5] else F.col(v[0]) for k, v in used.items()}
    ready = df.withColumns({f"__v_{k}": v for k, v in value.items()})
    shares = sorted({p for v in used.values() for p in v[1:3]})
    cuts = exact_quantiles(ready, [f"__v_{k}" for k in used], shares)
    cut = lambda k, p: F.lit(cuts[f"__v_{k}"][shares.index(p)])
    out = {k: F.when(value[k] >= cut(k, v[2]), v[4]).when(value[k] <= cut(k, v[1]), v[3]).otherwise(0) for k, v in used.items()}
    return df.withColumns(out)


def agreement(voted: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, agree, n): mean product of two voters' votes over rows where both vote, all pairs in one pass."""
    both = lambda a, b: (F.col(a) != 0) & (F.col(b) != 0)
    pairs = list(combinations(names, 2))
    one = voted.agg(*(F.avg(F.when(both(a, b), F.col(a) * F.col(b))).alias(f"{a}|{b}") for a, b in pairs), *(F.count_if(both(a, b)).alias(f"#{a}|{b}") for a, b in pairs))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("agree"), F.col(f"`#{a}|{b}`").alias("n")) for a, b in pairs))))


def label_model(agree: DataFrame, names: list[str], rounds: int = 200) -> dict[str, float]:
    """Weights of the voters: the leading factor of their agreement (without that with themselves) by power iteration, scaled to the root of its eigenvalue, sign fixed, held to 0..1; all 1 if it gives nothing. The matrix has one row a voter."""
    m = np.zeros((len(names), len(names)))
    at = {k: i for i, k in enumerate(names)}
    for r in agree.collect():
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["agree"] or 0.0
    v = np.full(len(names), len(names) ** -0.5)
    for _ in range(rounds):
        following = m @ v
        length = np.linalg.norm(following)
        if length < 1e-12:
            break
        v, old = following / length, v
        if np.abs(np.abs(v) - np.abs(old)).max() < 1e-9:
            break
    value = v @ m @ v
    v = np.clip(np.sqrt(max(value, 0)) * (v if v.sum() >= 0 else -v), 0, 1)
    v = v if value > 1e-9 and v.any() else np.ones(len(names))
    return dict(zip(names, v.tolist(), strict=True))


def weighted(voted: DataFrame, weights: dict[str, float]) -> DataFrame:
    """voted with vote_score, vote_label (hot from 0 on) and vote_prob, the confidence in that label."""
    d = voted.withColumn("vote_score", sum((F.lit(w) * F.col(k) for k, w in weights.items()), F.lit(0.0)))
    hot = 1 / (1 + F.exp(-F.col("vote_score")))
    return d.withColumns({"vote_prob": F.when(F.col("vote_score") >= 0, hot).otherwise(1 - hot), "vote_label": F.when(F.col("vote_score") >= 0, "hot").otherwise("pulse")})


def analysis(voted: DataFrame, names: list[str], weights: dict[str, float]) -> DataFrame:
    """(voter, coverage, n_up, n_down, conflict, weight): conflict is the share of rows where it votes and another votes otherwise."""
    rows = []
    for k in names:
        other = F.lit(False)
        for j in names:
            if j != k:
                other = other | ((F.col(j) != 0) & (F.col(j) != F.col(k)))
        rows.append(F.struct(F.lit(k).alias("voter"), F.avg((F.col(k) != 0).cast("int")).alias("coverage"), F.count_if(F.col(k) > 0).alias("n_up"), F.count_if(F.col(k) < 0).alias("n_down"), F.avg(((F.col(k) != 0) & other).cast("int")).alias("conflict"), F.lit(float(weights[k])).alias("weight")))
    return voted.agg(F.array(*rows).alias("r")).select(F.inline("r"))
