"""Least squares from one pass of sums: harmonic fits, variance bands, ridge forecasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import micros

# Periods in hours of the tides M2, S2, N2, K1 and O1, the solar day, the fortnight, half a year and the year.
HOURS = {"M2": 12.4206, "S2": 12.0, "N2": 12.6583, "K1": 23.9345, "O1": 25.8193, "day": 24.0, "fortnight": 327.86, "half_year": 4383.0, "year": 8766.0}
#: Timescales and their periods; a trend and the rest come besides.
BANDS = {"seasonal": ("half_year", "year"), "fortnightly": ("fortnight",), "diurnal": ("K1", "O1", "day"), "semidiurnal": ("M2", "S2", "N2")}


#: Share of the largest eigenvalue of the scaled products below which columns count as dependent.
DEPENDENT = 1e-9


def harmonics(t_hours: Column, periods: dict[str, float]) -> dict[str, list[Column]]:
    """Block of columns by name: an intercept, and a cosine and a sine per period."""
    out = {"intercept": [F.lit(1.0)]}
    for name, p in periods.items():
        a = 2 * F.pi() * t_hours / F.lit(p)
        out[name] = [F.cos(a), F.sin(a)]
    return out


def solve(df: DataFrame, columns: list[Column], y: Column, ridge: float = 0.0) -> np.ndarray:
    """Coefficients of y on columns from one aggregate of their products; k columns give k * k sums, whatever the rows.

    Directions in which the scaled columns hardly differ from dependent ones get no weight: their share would be the rounding of
    the sums, which changes with the order in which tasks end.
    """
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*(F.sum(columns[i] * columns[j]).alias(f"g{i}_{j}") for i, j in pairs), *(F.sum(c * y).alias(f"b{i}") for i, c in enumerate(columns))).first()
    gram = np.zeros((k, k))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
    size = np.sqrt(np.diag(gram))
    size[size == 0] = 1.0
    cross = np.array([row[f"b{i}"] or 0.0 for i in range(k)]) / size
    return np.linalg.lstsq(gram / np.outer(size, size) + ridge * np.diag(size**-2.0), cross, rcond=DEPENDENT)[0] / size


def harmonic_fit(df: DataFrame, column: str, train: Column, periods: dict[str, float] = HOURS) -> DataFrame:
    """df with fit: the harmonics of time fitted to a column on the rows of train only."""
    t = micros(F.col("ts")) / F.lit(3.6e9)
    terms = [c for block in harmonics(t, periods).values() for c in block]
    w = solve(df.where(train & F.col(column).isNotNull()), terms, F.col(column))
    return df.withColumn("fit", sum((F.lit(float(a)) * c for a, c in zip(w, terms, strict=True)), F.lit(0.0)))


def explained(df: DataFrame, column: str, fit: str = "fit") -> DataFrame:
    """r2: 1 - variance of the rest by variance of the column."""
    d = df.where(F.col(column).isNotNull())
    return d.agg((1 - F.var_pop(F.col(column) - F.col(fit)) / F.var_pop(column)).alias("r2"))


def variance_bands(df: DataFrame, column: str, bands: dict[str, tuple[str, ...]] = BANDS) -> DataFrame:
    """(band, share): share of a column's variance in a trend, in each band of harmonics and in the rest, fitted together."""
    t = micros(F.col("ts")) / F.lit(3.6e9)
    first = df.agg(F.min(t).alias("a")).first()["a"]
    by_period = harmonics(t, HOURS)
    blocks = {"intercept": by_period["intercept"], "trend": [(t - F.lit(first)) / F.lit(1000.0)]}
    blocks |= {band: [c for p in names for c in by_period[p]] for band, names in bands.items()}
    terms = [c for b in blocks.values() for c in b]
    d = df.where(F.col(column).isNotNull())
    w = iter(solve(d, terms, F.col(column)).tolist())
    parts = {name: sum((F.lit(next(w)) * c for c in block), F.lit(0.0)) for name, block in blocks.items()}
    rest = F.col(column) - sum(parts.values(), F.lit(0.0))
    named = {**{k: v for k, v in parts.items() if k != "intercept"}, "rest": rest}
    one = d.agg(*((F.var_pop(v) / F.var_pop(column)).alias(k) for k, v in named.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("band"), F.col(k).alias("share")) for k in named))))


def ridge_forecast(train: DataFrame, test: DataFrame, alpha: float = 10.0, last: int = 48) -> DataFrame:
    """test with forecast: all horizons at once from the last values of each history, by ridge on scaled inputs. Tasks add up their own Gram matrices; only those sums meet."""
    k = last + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                x = np.column_stack([np.stack(b["history"])[:, -last:], np.ones(len(b))])
                y = np.stack(b["future"])
                part = np.hstack([x.T @ x, x.T @ y])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel(), "w": total.shape[1]})

    rows = train.select("history", "future").mapInPandas(sums, "i int, v double, w int").groupBy("i").agg(F.sum("v").alias("v"), F.max("w").alias("w")).orderBy("i").toPandas()
    m = rows["v"].to_numpy().reshape(k, int(rows["w"].iloc[0]))
    gram, cross = m[:, :k], m[:, k:]
    n, mean = gram[-1, -1], gram[:-1, -1] / gram[-1, -1]
    scale = np.sqrt(np.maximum(np.diag(gram)[:-1] / n - mean**2, 1e-12))
    z = np.zeros((k, k))  # raw inputs to scaled ones
    z[:-1, :-1] = np.diag(1 / scale)
    z[-1, :-1] = -mean / scale
    z[-1, -1] = 1
    penalty = alpha * np.diag([1.0] * last + [0.0])
    coefficients = z @ np.linalg.solve(z.T @ gram @ z + penalty, z.T @ cross)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.column_stack([np.stack(b["history"])[:, -last:], np.ones(len(b))])
                yield b.assign(forecast=list(x @ coefficients))

    return test.mapInPandas(predict, ", ".join(f"{c} {t}" for c, t in test.dtypes) + ", forecast array<double>")
