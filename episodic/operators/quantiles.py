"""Exact quantiles of a whole column without one task seeing all of it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a slice that are counted out value by value.
SLICE = 10_000


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], accuracy: int = 10_000, held: int = SLICE) -> dict[str, list[float | None]]:
    """Each column's quantiles at shares of its values that are neither null nor NaN, interpolated between neighbours; nulls where there are none.

    Columns of few values are aggregated together. For others a sketch cuts out the slice in which a wanted place must lie, the
    rows below it are counted, and the slice is cut again until it is small or holds one value; only then its values are counted
    out. Every pass adds up in all tasks.
    """
    values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    sizes = df.agg(*(F.count(v).alias(c) for c, v in values.items())).first().asDict()
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    few = [c for c in columns if 0 < sizes[c] <= held]
    if few:
        row = df.agg(*(F.percentile(values[c], F.array(*(F.lit(float(p)) for p in shares))).alias(c) for c in few)).first()
        out |= {c: list(row[c]) for c in few}
    return out | {c: _cut(df.select(values[c].alias("v")).where("v IS NOT NULL"), sizes[c], shares, accuracy, held) for c in columns if sizes[c] > held}


def _cut(d: DataFrame, n: int, shares: list[float], accuracy: int, held: int) -> list[float]:
    places = [p * (n - 1) for p in shares]
    at = {r: None for p in places for r in (math.floor(p), math.ceil(p))}
    slices = {r: (None, None, 0, n) for r in at}  # lowest and highest value, rows below, rows inside
    while True:
        wide = {r: s for r, s in slices.items() if s[3] > held and (s[0] is None or s[0] < s[1])}
        if not wide:
            break
        cuts = []
        for r, (lo, hi, below, inside) in wide.items():
            share, margin = (r - below + 0.5) / inside, 2.0 / accuracy
            ends = F.array(F.lit(max(0.0, share - margin)), F.lit(min(1.0, share + margin)))
            cuts.append(F.percentile_approx(F.when(_within(lo, hi), F.col("v")), ends, accuracy).alias(f"c{r}"))
        found = d.agg(*cuts).first()
        counts = []
        for r in wide:
            a, b = found[f"c{r}"]
            counts += [F.count_if(F.col("v") < a).alias(f"b{r}"), F.count_if(F.col("v").between(a, b)).alias(f"n{r}")]
        counted = d.agg(*counts).first()
        narrowed = False
        for r, old in wide.items():
            a, b = found[f"c{r}"]
            below, inside = counted[f"b{r}"], counted[f"n{r}"]
            if below <= r < below + inside and inside < old[3]:
                slices[r], narrowed = (a, b, below, inside), True
        if not narrowed:  # the sketch cuts no finer: count the slices out as they are
            break
    for r, (lo, hi, below, _) in slices.items():
        if lo is not None and lo == hi:
            at[r] = lo
            continue
        seen = below
        for row in d.where(_within(lo, hi)).groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").toLocalIterator():
            seen += row.n
            if seen > r:
                at[r] = row.v
                break
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]


def _within(lo: float | None, hi: float | None):
    return F.lit(True) if lo is None else F.col("v").between(lo, hi)
